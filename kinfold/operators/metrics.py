"""Metrics, sweeps and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decide

THRESHOLDS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)
GAMMAS, FLOORS = (0.7, 0.85, 1.0, 1.15, 1.3, 1.5), (0.02, 0.05, 0.1)


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity from counts: 1 where nothing is true or predicted, 0 without a hit."""
    p, r = tp / predicted, tp / true
    return F.when((true == 0) & (predicted == 0), F.lit(1.0)).when(tp == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(s1: DataFrame, predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, s1_id, n_true, n_pred, tp, score) of every S1 entity; pairs count once. keys tell settings apart.

    s1 has s1_id (and the keys); predicted has keys, s1_id and cand_id.
    """
    on = [*keys, "s1_id"]
    pred = predicted.select(*on, "cand_id").distinct()
    true = truth.select("s1_id", "cand_id").distinct()
    hit = pred.join(true.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy(*on).agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    n_true = true.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    out = s1.join(n_true, "s1_id", "left").join(hit, on, "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return out.withColumn("score", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(s1: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(score) mean over all entities."""
    return entity_scores(s1.select("s1_id").distinct(), predicted, truth).agg(F.avg("score").alias("score"))


def threshold_sweep(s1: DataFrame, pairs: DataFrame, truth: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, score, empty): all thresholds in one job; empty is the share of S1 entities without a prediction."""
    table = pairs.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    # a candidate's best record doesn't depend on the threshold, only whether it passes
    best = decide.assign(pairs, min(thresholds))
    pred = best.crossJoin(F.broadcast(table)).where("prob >= threshold")
    each = entity_scores(s1.select("s1_id").distinct().crossJoin(F.broadcast(table)), pred, truth, ("threshold",))
    return each.groupBy("threshold").agg(F.avg("score").alias("score"), F.avg((F.col("n_pred") == 0).cast("double")).alias("empty"))


def calibration_sweep(s1: DataFrame, pairs: DataFrame, truth: DataFrame, gammas=GAMMAS, floors=FLOORS) -> DataFrame:
    """(gamma, floor, score) of decoding with each setting, in one job. pairs are assigned ones."""
    table = pairs.sparkSession.createDataFrame([(float(g), float(f)) for g in gammas for f in floors], "gamma double, floor double")
    keys = ("gamma", "floor", "s1_id")
    pred = decide.decode(pairs.crossJoin(F.broadcast(table)), F.col("gamma"), F.col("floor"), keys)
    each = entity_scores(s1.select("s1_id").distinct().crossJoin(F.broadcast(table)), pred, truth, ("gamma", "floor"))
    return each.groupBy("gamma", "floor").agg(F.avg("score").alias("score"))


def best_setting(sweep: DataFrame) -> DataFrame:
    """The first best row of a sweep in the order of its parameters (scores to nine places)."""
    return sweep.orderBy(F.round("score", 9).desc(), "gamma", "floor").limit(1)


def pair_outcomes(candidates: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """E8 per pair: (s1_id, cand_id, outcome, owner, taken, prob), outcome one of tp, fp, fn (a candidate), miss (not one).

    owner is the candidate's true S1 record (J10), taken whether the prediction gave the candidate to any record.
    """
    true, pred = truth.select("s1_id", "cand_id").distinct(), predicted.select("s1_id", "cand_id").distinct()
    cand = candidates.select("s1_id", "cand_id", "prob")
    every = true.withColumn("t", F.lit(1)).join(pred.withColumn("p", F.lit(1)), ["s1_id", "cand_id"], "full").join(cand.withColumn("c", F.lit(1)), ["s1_id", "cand_id"], "left")
    outcome = F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), "tp").when(F.col("p").isNotNull(), "fp").when(F.col("c").isNotNull(), "fn").otherwise("miss")
    owner = true.groupBy("cand_id").agg(F.min("s1_id").alias("owner"))
    taken = pred.select("cand_id").distinct().withColumn("taken", F.lit(True))
    return every.join(owner, "cand_id", "left").join(taken, "cand_id", "left").select("s1_id", "cand_id", outcome.alias("outcome"), "owner", F.coalesce("taken", F.lit(False)).alias("taken"), "prob")


def error_scores(s1: DataFrame, outcomes: DataFrame) -> DataFrame:
    """E8 per entity: counts, score, and the scores with all candidates right, without false positives, without false negatives."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    counts = outcomes.groupBy("s1_id").agg(n("tp"), n("fp"), n("fn"), n("miss"), F.count_if((F.col("outcome") == "fp") & F.col("owner").isNotNull()).alias("fp_stolen"))
    each = s1.join(counts, "s1_id", "left").na.fill(0, ["tp", "fp", "fn", "miss", "fp_stolen"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    true = tp + fn + F.col("miss")
    return each.withColumns({"n_true": true, "score": f05(tp, tp + fp, true), "ceiling": f05(tp + fn, tp + fn, true), "no_fp": f05(tp, tp, true), "no_fn": f05(tp + fn, tp + fn + fp, true)})


def error_summary(scores: DataFrame) -> DataFrame:
    """E8 by country and overall (country null): mean scores and points lost, error counts, singletons."""
    single = F.col("n_true") == 0
    return scores.rollup("country").agg(
        *[F.avg(c).alias(c) for c in ("score", "ceiling", "no_fp", "no_fn")],
        (F.avg("no_fp") - F.avg("score")).alias("lost_fp"),
        (F.avg("no_fn") - F.avg("score")).alias("lost_fn"),
        (1 - F.avg("ceiling")).alias("lost_blocking"),
        *[F.sum(c).alias(f"n_{c}") for c in ("fp", "fp_stolen", "fn", "miss")],
        F.avg(single.cast("double")).alias("singletons"),
        F.avg(F.when(single, F.col("score"))).alias("singleton_score"),
        F.avg(F.when(~single, F.col("score"))).alias("other_score"),
    )


def outcome_quantiles(outcomes: DataFrame, shares=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(outcome, q10, ...) quantiles of the probabilities of false positives and false negatives; nulls don't count."""
    name = lambda q: f"q{int(q * 100)}"
    return outcomes.where(F.col("outcome").isin("fp", "fn")).groupBy("outcome").agg(*[F.percentile("prob", F.lit(q)).alias(name(q)) for q in shares], F.count_if(F.col("taken")).alias("n_taken"), F.count("*").alias("n"))


def empty_address_shares(outcomes: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, share, median_prob): share of empty addresses among all records, predicted pairs, and each error kind."""
    empty = index.select(F.col("entity_id").alias("cand_id"), (F.trim("addr_n") == "").alias("empty"))
    each = outcomes.join(empty, "cand_id")
    kinds = each.select(F.explode(F.when(F.col("outcome").isin("tp", "fp"), F.array(F.lit("predicted"), F.col("outcome"))).otherwise(F.array("outcome"))).alias("kind"), "empty", "prob").where("kind <> 'tp'")
    every = empty.select(F.lit("all").alias("kind"), "empty", F.lit(None).cast("double").alias("prob"))
    return kinds.unionByName(every).groupBy("kind").agg(F.avg(F.col("empty").cast("double")).alias("share"), F.percentile(F.when(F.col("empty"), F.col("prob")), F.lit(0.5)).alias("median_prob"))


def stolen_same_name(outcomes: DataFrame, s1: DataFrame) -> DataFrame:
    """(share) of stolen false positives whose wrong S1 record has the exact name of the true one."""
    name = s1.select("entity_id", "name_n")
    stolen = outcomes.where("outcome = 'fp' and owner is not null")
    both = stolen.join(name.withColumnsRenamed({"entity_id": "s1_id", "name_n": "wrong"}), "s1_id").join(name.withColumnsRenamed({"entity_id": "owner", "name_n": "right"}), "owner")
    return both.agg(F.avg((F.col("wrong") == F.col("right")).cast("double")).alias("share"))


def error_examples(outcomes: DataFrame, s1: DataFrame, index: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """N pairs of each error kind in a fixed pseudo-random order, with both texts and the true owner."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("outcome").orderBy(F.md5(F.concat_ws("|", "s1_id", "cand_id", F.lit(str(seed)))), "s1_id", "cand_id")
    some = outcomes.where("outcome <> 'tp'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    text = lambda df, k: df.select(F.col("entity_id").alias(f"{k}_id"), F.col("block_text").alias(f"{k}_text"))
    return some.join(text(s1, "s1"), "s1_id").join(text(index, "cand"), "cand_id")


def rank_correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(rho) Spearman correlation of two columns: Pearson correlation of average ranks.

    Ranks come from counts by value, so what is ordered as a whole are distinct values with their counts.
    """
    from pyspark.sql.window import Window

    def ranked(df: DataFrame, c: str) -> DataFrame:
        counts = df.groupBy(c).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.join(counts.select(c, (before + (F.col("n") + 1) / 2).alias(f"{c}_rank")), c)

    return ranked(ranked(pairs, x), y).agg(F.corr(f"{x}_rank", f"{y}_rank").alias("rho"))
