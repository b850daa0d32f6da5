"""Whole runs over TSV files, each a function and a command: python -m kinfold.runners COMMAND --help.

A work folder, shared by driver and executors, holds what one run leaves for the next as Parquet: SPLIT_s1, SPLIT_index,
SPLIT_candidates, SPLIT_scored. Results are TSV folders; no run writes over what is there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text
from kinfold.operators import blocking, decide, features, model
from kinfold.sources import io

SPLITS = ("train", "test")


def held(spark: SparkSession, work: str, split: str, name: str) -> DataFrame:
    """A table that an earlier run left."""
    return spark.read.parquet(f"{work}/{split}_{name}")


def block_split(spark: SparkSession, data: str, work: str, split: str = "test", k: int = blocking.K) -> DataFrame:
    """Normalize the three sources of a split and search candidates; all three tables stay in the work folder."""
    s1 = io.checkpoint(io.load_normalized(spark, io.split_path(data, split, 1)), f"{work}/{split}_s1")
    index = io.load_normalized(spark, io.split_path(data, split, 2)).unionByName(io.load_normalized(spark, io.split_path(data, split, 3)))
    index = io.checkpoint(index, f"{work}/{split}_index")
    sides = (x.select("entity_id", "country", text.search_terms(F.col("block_text"), F.col("name_n"), F.col("addr_n")).alias("terms")) for x in (s1, index))
    return io.checkpoint(blocking.block(*sides, k=k), f"{work}/{split}_candidates")


def train_split(spark: SparkSession, work: str, truth: str, model_path: str, split: str = "train", rounds: int = 1000) -> None:
    """Train on the labelled share of a split's S1 records, and save the model."""
    s1, index, candidates = (held(spark, work, split, x) for x in ("s1", "index", "candidates"))
    pairs = features.make_features(candidates, s1, index)
    positions = io.with_position(s1.select("entity_id")).select(F.col("entity_id").alias("s1_id"), "pos")
    rows = io.checkpoint(model.labelled(pairs, io.explode_truth(io.read_tsv(spark, truth, io.TRUTH)), positions), f"{work}/{split}_labelled")
    model.save(model.train(rows, rounds=rounds), io.check_target(model_path))


def score_split(spark: SparkSession, work: str, model_path: str, split: str = "test") -> DataFrame:
    """Probabilities of all candidates by a saved model; they stay in the work folder, so decisions can be changed later."""
    s1, index, candidates = (held(spark, work, split, x) for x in ("s1", "index", "candidates"))
    scored = model.score(model.load(model_path), features.make_features(candidates, s1, index))
    return io.checkpoint(scored, f"{work}/{split}_scored")


def decide_split(spark: SparkSession, work: str, out: str, split: str = "test", threshold: float | None = None, gamma: float = decide.GAMMA, floor: float = decide.FLOOR) -> dict[str, float]:
    """Write candidate_pairs.tsv and matching_results.tsv from saved probabilities; matches and the share of S1 records without one.

    Each candidate goes to its best S1 record. With a threshold, pairs from it up match; without one, the match set with
    the highest expected F0.5.
    """
    io.check_target(out)
    s1, candidates, scored = (held(spark, work, split, x) for x in ("s1", "candidates", "scored"))
    matches = decide.decode(decide.assign(scored, decide.ASSIGN_FLOOR), gamma, floor) if threshold is None else decide.assign(scored, threshold)
    io.write_tsv(io.match_lists(s1, candidates, [F.col("rank")], "candidate_entity_ids"), f"{out}/candidate_pairs.tsv")
    io.write_tsv(io.match_lists(s1, matches, [F.desc("prob")]), f"{out}/matching_results.tsv")
    found = io.read_tsv(spark, f"{out}/matching_results.tsv", io.TRUTH)
    some = F.col("matched_entity_ids") != ""
    one = found.agg(F.coalesce(F.sum(F.when(some, F.size(F.split("matched_entity_ids", ",")))), F.lit(0)).alias("matches"), F.avg((~some).cast("double")).alias("empty")).first()
    return {"matches": one.matches, "share_without": one.empty}


def address_report(spark: SparkSession, work: str, truth: str, out: str, split: str = "train", k: int = 20) -> DataFrame:
    """What a search by addresses alone adds on the validation share: the report and the new pairs, as TSV."""
    s1, index, candidates = (held(spark, work, split, x) for x in ("s1", "index", "candidates"))
    positions = io.with_position(s1.select("entity_id"))
    val = positions.where(F.pmod("pos", F.lit(model.MODULUS)) == model.VALIDATION).select("entity_id")
    s1 = s1.join(val, "entity_id", "left_semi")
    ids = val.select(F.col("entity_id").alias("s1_id"))
    current = candidates.join(ids, "s1_id", "left_semi")
    known = io.explode_truth(io.read_tsv(spark, truth, io.TRUTH)).join(ids, "s1_id", "left_semi")
    sides = (x.select("entity_id", "country", text.address_terms(F.col("addr_n")).alias("terms")) for x in (s1, index))
    found = io.checkpoint(blocking.address_search(*sides, k), f"{work}/{split}_address")
    report = blocking.union_report(current, found, known, index, s1.count())
    io.write_tsv(blocking.new_pairs(found, current, known).select("s1_id", "cand_id", "score", "rank", "is_true"), f"{out}/address_pairs.tsv")
    io.write_tsv(report, f"{out}/address_report.tsv")
    return io.read_tsv(spark, f"{out}/address_report.tsv", report.schema)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> object:
    """Run a command; what it returns is printed."""
    parser = argparse.ArgumentParser(prog="kinfold.runners", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, split: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=about)
        one.add_argument("--work", required=True, help="folder of Parquet tables between runs")
        one.add_argument("--split", default=split, choices=SPLITS)
        return one

    one = command("block", "normalize a split and search candidates", "test")
    one.add_argument("--data", required=True)
    one.add_argument("--k", type=int, default=blocking.K)
    one = command("train", "train the match model", "train")
    one.add_argument("--truth", required=True)
    one.add_argument("--model", required=True)
    one.add_argument("--rounds", type=int, default=1000)
    one = command("score", "score all candidates by a saved model", "test")
    one.add_argument("--model", required=True)
    one = command("decide", "pick matches from saved scores and write both lists", "test")
    one.add_argument("--out", required=True)
    one.add_argument("--threshold", type=float, help="match from this probability up, instead of by expected F0.5")
    one.add_argument("--gamma", type=float, default=decide.GAMMA)
    one.add_argument("--floor", type=float, default=decide.FLOOR)
    one = command("address", "report what a search by addresses adds", "train")
    one.add_argument("--truth", required=True)
    one.add_argument("--out", required=True)
    told = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("kinfold").getOrCreate()
    if told.command == "block":
        result = block_split(spark, told.data, told.work, told.split, told.k).count()
    elif told.command == "train":
        result = train_split(spark, told.work, told.truth, told.model, told.split, told.rounds)
    elif told.command == "score":
        result = score_split(spark, told.work, told.model, told.split).count()
    elif told.command == "decide":
        result = decide_split(spark, told.work, told.out, told.split, told.threshold, told.gamma, told.floor)
    else:
        result = address_report(spark, told.work, told.truth, told.out, told.split).collect()
    print(result)
    return result


if __name__ == "__main__":
    main()
