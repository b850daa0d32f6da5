import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking, decide, features, metrics, model
from kinfold.plans import catalog
from kinfold.plans import fixtures as fx
from kinfold.sources import io

SF = "/root/testdata/sf0.001"


def test_margin(spark):
    rows = [("g", 5.0), ("g", 5.0), ("g", 3.0), ("h", 5.0), ("h", 3.0), ("i", 5.0), ("j", None), ("j", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, v double")
    expected = [0.0, 0.0, -2.0, 2.0, -2.0, None, -2.0, 2.0]
    assert [r.m for r in df.withColumn("m", features.margin(F.col("v"), "k")).orderBy("i").collect()] == expected
    assert [r.m for r in features._margins(df, {"m": "v"}, "k").orderBy("i").collect()] == expected


def test_assign(spark):
    df = spark.createDataFrame([("s1", "c", 0.9), ("s2", "c", 0.8), ("s1", "d", 0.6)], "s1_id string, cand_id string, prob double")
    assert [(r.s1_id, r.cand_id) for r in decide.assign(df, 0.7).collect()] == [("s1", "c")]


def brute_scores(p):
    n = len(p)
    out = [math.prod(1 - x for x in p)]
    for k in range(1, n + 1):
        total = 0.0
        for truth in itertools.product([0, 1], repeat=n):
            chance = math.prod(x if t else 1 - x for x, t in zip(p, truth))
            total += chance * 1.25 * sum(truth[:k]) / (0.25 * sum(truth) + k)
        out.append(total)
    return out


@pytest.mark.parametrize("p", [[0.95], [0.02], [0.9, 0.6, 0.3], [0.8, 0.8, 0.79, 0.1, 0.05, 0.02]])
def test_expected_scores_match_enumeration(p):
    assert np.allclose(decide.expected_scores(np.array([p]))[0], brute_scores(p), atol=1e-12)


def test_best_sizes():
    assert decide.best_sizes([[], [0.02], [0.95], [0.5, 0.5]])[:3] == [0, 0, 1]


def test_decode_keeps_floor_and_order(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.95), ("a", "z", 0.01), ("b", "x", 0.03)], "s1_id string, cand_id string, prob double")
    assert [(r.s1_id, r.cand_id) for r in decide.decode(df, 1.0, 0.02).orderBy("s1_id", "place").collect()] == [("a", "y"), ("a", "x")]


def test_entity_scores(spark):
    s1 = spark.createDataFrame([("n",), ("w",), ("h",)], "s1_id string")
    pred = spark.createDataFrame([("w", "x"), ("h", "p"), ("h", "p")], "s1_id string, cand_id string")
    true = spark.createDataFrame([("h", "p"), ("h", "q")], "s1_id string, cand_id string")
    got = {r.s1_id: r.score for r in metrics.entity_scores(s1, pred, true).collect()}
    assert got["n"] == 1 and got["w"] == 0 and math.isclose(got["h"], 1.25 * 0.5 / 0.75)


def test_match_lists(spark):
    s1 = spark.createDataFrame([("S1_1",), ("S1_2",)], "entity_id string")
    pairs = spark.createDataFrame([("S1_1", "S2_9", 0.9), ("S1_1", "S2_9", 0.8), ("S1_1", "S2_1", 0.95)], "s1_id string, cand_id string, prob double")
    got = {r[0]: r[1] for r in io.match_lists(s1, pairs, [F.desc("prob")]).collect()}
    assert got == {"S1_1": "S2_1,S2_9", "S1_2": ""}


def test_tsv_has_no_nulls_and_guards(spark, tmp_path):
    df = spark.createDataFrame([("S1_1", 'Foo "Bar"', "", "en")], "entity_id string, business_name string, business_address string, country string")
    io.write_tsv(df, f"{tmp_path}/t")
    assert io.read_tsv(spark, f"{tmp_path}/t").collect()[0].asDict() == {"entity_id": "S1_1", "business_name": 'Foo "Bar"', "business_address": "", "country": "en"}
    with pytest.raises(ValueError):
        io.check_target("/x/output_v3/y")


def test_position(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(100)], "entity_id string").repartition(7)
    assert [r.pos for r in io.with_position(df).orderBy("entity_id").collect()] == list(range(100))


def test_reverse_finds_what_forward_crowds_out(spark):
    s1 = spark.createDataFrame([("S1_1", "en", ["a", "b"]), ("S1_2", "en", ["c"])], "entity_id string, country string, terms array<string>")
    index = spark.createDataFrame([(f"S2_{i}", "en", ["a", "b"]) for i in range(4)] + [("S2_9", "en", ["a", "z"]), ("S3_1", "fr", ["a"])], "entity_id string, country string, terms array<string>")
    assert {r.cand_id for r in blocking.block(s1, index, 2, 0).collect()} == {"S2_0", "S2_1"}
    both = blocking.block(s1, index, 2, 1).orderBy("rank").collect()
    assert {r.cand_id for r in both} == {"S2_0", "S2_1", "S2_2", "S2_3", "S2_9"} and [r["rank"] for r in both] == list(range(5))


def test_empty_sides_give_nothing(spark):
    none = spark.createDataFrame([], "entity_id string, country string, terms array<string>")
    assert blocking.block(none, none).count() == 0


def test_features_and_model(spark, tmp_path):
    n = fx.normalized(spark, SF)
    full = features.make_features(fx.candidates(spark, SF), n.where("source = 'S1'"), n.where("source <> 'S1'"))
    assert full.columns[2:] == features.ALL and len(features.ALL) == 46 and len(features.BASE) == 31
    rows = model.labelled(full, fx.truth(spark, SF), fx.positions(spark, SF), sample=20).cache()
    fitted = model.train(rows, rounds=3, depth=3, least=2)
    scored = model.score(fitted, full)
    assert scored.count() == full.count() and scored.where("prob < 0 or prob > 1 or prob is null").count() == 0
    assert len(model.importances(fitted)) == 15
    model.save(fitted, f"{tmp_path}/model")
    again = {(r.s1_id, r.cand_id): r.prob for r in model.score(model.load(f"{tmp_path}/model"), full).collect()}
    assert again == {(r.s1_id, r.cand_id): r.prob for r in scored.collect()}


def test_context_is_of_the_full_candidate_set(spark):
    n = fx.normalized(spark, SF)
    full = features.context(fx.candidates(spark, SF), n.where("source = 'S1'"), n.where("source <> 'S1'"))
    some = full.where(F.pmod(F.xxhash64("s1_id"), F.lit(5)) == 0)
    want = {(r.s1_id, r.cand_id): r.n_s1_competitors for r in full.select("s1_id", "cand_id", "n_s1_competitors").collect()}
    assert all(want[r.s1_id, r.cand_id] == r.n_s1_competitors for r in some.select("s1_id", "cand_id", "n_s1_competitors").collect())


def test_sweep_has_all_settings(spark):
    found = catalog.QUERIES["e06_calibration_sweep"](spark, SF)
    assert found.count() == 18 and metrics.best_setting(found).count() == 1


def test_split_paths():
    assert io.split_path("/d", "train", 2) == "/d/train/train_source2.tsv"
    with pytest.raises(ValueError):
        io.split_path("/d", "dev", 1)


def test_model_queries_train_with_production_parameters(spark):
    fitted = catalog._trained(spark, "/root/testdata/sf0.01").stages[-1]
    assert (fitted.getMaxIter(), fitted.getMaxDepth(), fitted.getMinInstancesPerNode()) == (1000, 6, 50)
    assert 5 < fitted.getNumTrees < 1000  # the validation rows stop the boosting
    assert max(t.depth for t in fitted.trees) > 3


def test_model_queries_train_on_all_records(spark, monkeypatch):
    monkeypatch.setattr(model, "train", lambda rows, **more: rows)
    rows = catalog._trained(spark, SF)
    assert sorted(map(tuple, rows.select("s1_id", "cand_id").collect())) == sorted(map(tuple, fx.candidates(spark, SF).select("s1_id", "cand_id").collect()))
    assert {(int(r.s1_id[3:]) % 20 == 0) == r.is_val for r in rows.select("s1_id", "is_val").collect()} == {True}


def test_thresholds_come_from_all_rows(spark):
    """Each of five columns has one row of 40,000 with another value; a sample of rows would miss most of them."""
    names = [f"x{i}" for i in range(5)]
    rows = spark.range(40000).select(*[(F.col("id") == 7001 * i + 3).cast("double").alias(c) for i, c in enumerate(names)], F.rand(1).alias("y"), (F.col("id") % 4000 == 0).alias("is_val")).withColumn("label", F.greatest(*names))
    fitted = model.train(rows, [*names, "y"], rounds=1, least=1, share="all")
    assert {c for c, gain in model.importances(fitted, [*names, "y"]) if gain > 0} == set(names)


def test_tsv_keeps_spaces_at_the_ends_of_cells(spark, tmp_path):
    """A text without words gives a name such as " Pvt Ltd"; Spark's writer trims cells unless told otherwise."""
    rows = [("S1_1", " Pvt Ltd", "No. 5  Rd ", " "), ("S2_2", "", "  ", "en"), ("S3_3", "a\\", "\\b \"c\" 'd'", "#")]
    io.write_tsv(spark.createDataFrame(rows, io.RECORD), f"{tmp_path}/t")
    assert sorted(tuple(r) for r in io.read_tsv(spark, f"{tmp_path}/t").collect()) == rows


@pytest.mark.parametrize("name", ["s01_tsv_scan", "s03_index_scan", "s04_split_files"])
def test_tsv_of_texts_without_words(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame([(i, text, "en", i) for i, text in enumerate(["...", "", "a b c d e", "¿?", "न"] * 8)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    held = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in held.description]
    assert sorted(tuple(r[c] for c in names) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(held.fetchall())


def shuffle_files(spark):
    """Shuffle files that are on the executors' disks (here the driver's) now."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if "/shuffle_" in x}


def test_stage_leaves_its_table_alone(spark, tmp_path, monkeypatch):
    """What a stage stored on its way and its shuffle files go; before, they stayed on disk beside those of the query."""
    monkeypatch.setattr(fx, "scratch", lambda spark, label: f"{tmp_path}/{label}")
    before = shuffle_files(spark)
    made = fx.stage(spark, "nowhere", "sums", lambda keep: keep(spark.range(100).repartition(3), "rows").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")))
    assert made.agg(F.sum("n")).first()[0] == 4950
    assert [p.name for p in tmp_path.iterdir()] == ["sums"]
    assert len({x for x in shuffle_files(spark) - before if x.endswith(".data")}) <= 1  # of the sum just above


def test_search_stores_its_parts(spark):
    """With keep, what is stored is what the search goes on with, and the candidates are the same."""
    s1, index = (x.select("entity_id", "country", "terms") for x in fx.sides(spark, SF))
    held = {}

    def keep(df, label):
        held[label] = spark.createDataFrame(df.collect(), df.schema)
        return held[label]

    got = {(r.s1_id, r.cand_id, r["rank"]) for r in blocking.block(s1, index, keep=keep).collect()}
    assert got == {(r.s1_id, r.cand_id, r["rank"]) for r in blocking.block(s1, index).collect()} and got
    assert set(held) == {"vocabulary", "s1_postings", "index_postings", "lists"}


@pytest.mark.parametrize("name", ["j06_new_pairs", "s09_new_pairs"])
def test_address_search_is_a_stage(spark, name):
    """The query reads the pairs of the address search; before, it ran the search with all its shuffles beside its own."""
    assert "FlatMapGroupsInArrow" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e04_macro_f05", "e05_entity_scores", "e08_error_summary", "e08_pair_outcomes"])
def test_scores_are_a_stage(spark, name):
    """The query reads scored pairs; before, it joined names to candidates, once or twice, with those shuffles beside its own."""
    assert "name_n" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b14_recall_at_k", "b15_recall_by_country", "e05_entity_scores", "e08_error_summary", "e08_pair_outcomes", "e08_quantiles", "j04_labels", "s09_new_pairs"])
def test_truth_is_a_stage(spark, name):
    """The query reads true pairs; before, it cut all texts into words for either side of each join with them, with those shuffles beside its own."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "first_words" not in plan


def test_features_join_word_shares_before_they_are_wide(spark):
    """The share of known words is on the candidates that are stored first; before, all features were shuffled for it."""
    n, held = fx.normalized(spark, SF), {}

    def keep(df, label):
        held[label] = df
        return df

    features.make_features(fx.candidates(spark, SF), n.where("source = 'S1'"), n.where("source <> 'S1'"), keep)
    assert held["known"].columns == ["cand_id", "s1_id", "score", "rank", "cand_name_vocab_frac"]
    assert held["known"].count() == fx.candidates(spark, SF).count()


def test_labelled_rows_are_a_stage(spark):
    """Training reads its rows several times; before, each pass joined all features again or kept their shuffles on disk."""
    plan = catalog._labelled(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Scan parquet" in plan
