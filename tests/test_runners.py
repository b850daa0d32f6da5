import pytest
from pyspark.sql import functions as F

from kinfold import runners
from kinfold.operators import decide
from kinfold.plans import fixtures as fx
from kinfold.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """TSV files of both splits and of the truth, from the fixtures' records."""
    data, work = (f"file://{tmp_path_factory.mktemp(x)}" for x in ("data", "work"))
    records = fx.records(spark, SF)
    for split in runners.SPLITS:
        for source in (1, 2, 3):
            io.write_tsv(records.where(F.col("source") == f"S{source}").select(list(io.RECORD.names)), io.split_path(data, split, source))
    truth = io.match_lists(records.where("source = 'S1'"), fx.truth(spark, SF), [F.col("cand_id")])
    io.write_tsv(truth, f"{data}/truth.tsv")
    return data, work


def lists(spark, path):
    return {(r.source1_entity_id, c) for r in io.read_tsv(spark, path, io.TRUTH).collect() for c in r.matched_entity_ids.split(",") if c}


def test_all_commands(spark, folders, capsys):
    data, work = folders
    run = lambda *args: runners.main(list(args), spark)
    n = {split: run("block", "--data", data, "--work", work, "--split", split) for split in runners.SPLITS}
    assert n["train"] == n["test"] == fx.candidates(spark, SF).count() > 0
    run("train", "--work", work, "--truth", f"{data}/truth.tsv", "--model", f"{work}/model", "--rounds", "3")
    assert run("score", "--work", work, "--model", f"{work}/model") == n["test"]
    scored = runners.held(spark, work, "test", "scored")
    for name, args, matches in (
        ("expected", (), decide.decode(decide.assign(scored, decide.ASSIGN_FLOOR), decide.GAMMA, decide.FLOOR)),
        ("threshold", ("--threshold", "0.3"), decide.assign(scored, 0.3)),
        ("again", ("--gamma", "1.0", "--floor", "0.2"), decide.decode(decide.assign(scored, decide.ASSIGN_FLOOR), 1.0, 0.2)),
    ):
        told = run("decide", "--work", work, "--out", f"{work}/{name}", *args)
        got = lists(spark, f"{work}/{name}/matching_results.tsv")
        assert got == {(r.s1_id, r.cand_id) for r in matches.collect()} and told["matches"] == len(got) and 0 <= told["share_without"] <= 1
        assert lists(spark, f"{work}/{name}/candidate_pairs.tsv") == {(r.s1_id, r.cand_id) for r in runners.held(spark, work, "test", "candidates").collect()}
    report = run("address", "--work", work, "--truth", f"{data}/truth.tsv", "--out", f"{work}/report")
    assert {r.setting for r in report} <= {"current", "union@10", "union@20"} and report
    with pytest.raises(ValueError):
        run("decide", "--work", work, "--out", f"{work}/output_v3")
    with pytest.raises(SystemExit):
        run("block", "--data", data, "--work", work, "--split", "other")
