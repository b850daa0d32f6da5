"""The match model: gradient-boosted trees on the 46 features (M1 to M6)."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

#: What stands for a missing value; an indicator column tells it apart.
MISSING = -999.0
#: Features that can be missing.
NULLABLE = ["score_margin_in_cand", *[f"{c}_margin_in_s1" for c in features.RANKED], "postal_conflict", "house_first_equal", "cand_name_vocab_frac", "sib_name_sim", "sib_addr_sim", "sib_best_sim", "sib_score"]
MODULUS, SAMPLE, VALIDATION = 20, 3, 0
#: Bins of an input, as Spark's trees have them by default.
BINS = 32


def inputs(columns: list[str]) -> list[str]:
    """Input columns of the model: the features, and an indicator for each that can be missing."""
    return [*columns, *[f"{c}_missing" for c in columns if c in NULLABLE]]


def fill_missing(df: DataFrame, columns: list[str] = features.ALL) -> DataFrame:
    """M4: the trees take no NaN: missing values become MISSING, with an indicator."""
    some = [c for c in columns if c in NULLABLE]
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in some} | {c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in columns})


def labelled(pairs: DataFrame, truth: DataFrame, positions: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Pairs of a share of S1 records by position, with label and is_val. Features must be complete before.

    positions has s1_id and pos.
    """
    part = positions.where(F.pmod("pos", F.lit(MODULUS)) < sample).select("s1_id", (F.pmod("pos", F.lit(MODULUS)) == VALIDATION).alias("is_val"))
    hit = truth.select("s1_id", "cand_id").distinct().withColumn("__t", F.lit(1.0))
    return pairs.join(part, "s1_id").join(hit, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("__t", F.lit(0.0))).drop("__t")


def train(rows: DataFrame, columns: list[str] = features.ALL, rounds: int = 40, rate: float = 0.1, depth: int = 6, least: int = 50, share: str = "0.8", seed: int = 0) -> PipelineModel:
    """M1, M2: log-loss boosting that stops when the validation rows (is_val) no longer gain."""
    names, rows = inputs(columns), fill_missing(rows, columns)
    splits, n = bounds(rows.where("not is_val"), names)
    binned = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"{c}_bin" for c in names], handleInvalid="keep")
    # trees look for thresholds in a sample of maxBins squared rows; inputs have BINS values, so more bins only make it all rows
    most = min(max(BINS, math.isqrt(n) + 1), 46340)
    trees = GBTClassifier(featuresCol="features", labelCol="label", lossType="logistic", maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy=share, validationIndicatorCol="is_val", validationTol=0.001, maxBins=most, seed=seed)
    return Pipeline(stages=[binned, VectorAssembler(inputCols=binned.getOutputCols(), outputCol="features"), trees]).fit(rows)


def bounds(rows: DataFrame, names: list[str]) -> tuple[list[list[float]], int]:
    """Bounds of each input's bins, from all rows, and their number: between all values where there are up to BINS, else at quantiles."""
    share = [i / BINS for i in range(1, BINS)]
    held = rows.agg(F.count("*"), *[F.approx_count_distinct(c) for c in names], *[F.percentile_approx(c, share) for c in names]).first()
    few = [c for c, m in zip(names, held[1:]) if m <= 2 * BINS]
    values = dict(zip(few, rows.agg(*[F.collect_set(c) for c in few]).first())) if few else {}
    out = []
    for name, quantiles in zip(names, held[1 + len(names) :]):
        all_values = sorted(x for x in values.get(name, []) if math.isfinite(x))
        if name in values and len(all_values) <= BINS:
            cuts = [(x + y) / 2 for x, y in zip(all_values, all_values[1:])]
        else:
            cuts = sorted({x for x in quantiles or [] if math.isfinite(x)})
        out.append([-math.inf, *(cuts or [0.0]), math.inf])
    return out, held[0]


def score(model: PipelineModel, pairs: DataFrame, columns: list[str] = features.ALL) -> DataFrame:
    """(s1_id, cand_id, prob)."""
    return model.transform(fill_missing(pairs, columns)).select("s1_id", "cand_id", vector_to_array("probability")[1].alias("prob"))


def importances(model: PipelineModel, columns: list[str] = features.ALL, n: int = 15) -> list[tuple[str, float]]:
    """M5: the n most important inputs."""
    found = zip(inputs(columns), model.stages[-1].featureImportances.toArray().tolist())
    return sorted(found, key=lambda x: (-x[1], x[0]))[:n]


def save(model: PipelineModel, path: str) -> None:
    """S11."""
    model.write().save(path)


def load(path: str) -> PipelineModel:
    """S11."""
    return PipelineModel.load(path)
