"""Decisions: one S1 record per candidate, and the match set with the best expected F0.5."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weight of recall in F0.5 (beta squared), and defaults of thresholds.
BETA2 = 0.25
THRESHOLD, ASSIGN_FLOOR = 0.7, 0.02
GAMMA, FLOOR = 1.15, 0.05
CLIP = 1e-6


def assign(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs with at least this probability, each candidate with its best S1 record (ties: smaller id)."""
    best = Window.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id")
    return pairs.where(F.col("prob") >= threshold).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def expected_scores(p: np.ndarray, beta2: float = BETA2) -> np.ndarray:
    """Expected F of the k first candidates, k = 0..n, for rows of descending probabilities (padded with 0).

    With independent matches, the true ones among the first k and among the rest have Poisson-binomial distributions,
    so the expectation is a finite double sum; no sampling is needed. For k = 0 it is the chance of no match at all.
    """
    rows, n = p.shape
    # tail[k]: distribution of matches among candidates k and after
    tail = np.zeros((n + 1, rows, n + 1))
    tail[n, :, 0] = 1
    for k in range(n - 1, -1, -1):
        q = p[:, k, None]
        tail[k] = tail[k + 1] * (1 - q)
        tail[k, :, 1:] += tail[k + 1, :, :-1] * q
    out = np.empty((rows, n + 1))
    out[:, 0] = tail[0, :, 0]
    head = np.zeros((rows, n + 1))
    head[:, 0] = 1
    t = np.arange(n + 1)
    for k in range(1, n + 1):
        q = p[:, k - 1, None]
        head[:, 1:] = head[:, 1:] * (1 - q) + head[:, :-1] * q
        head[:, 0] *= 1 - q[:, 0]
        gain = (1 + beta2) * t[:, None] / (beta2 * (t[:, None] + t[None, :]) + k)
        out[:, k] = np.einsum("rt,tu,ru->r", head, gain, tail[k])
    return out


def best_sizes(lists: list[list[float]]) -> list[int]:
    """How many of the best candidates to predict, for each list of descending probabilities; none wins ties."""
    out = [0] * len(lists)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(lists):
        if x:
            by_size.setdefault(len(x), []).append(i)
    for size, rows in by_size.items():
        step = max(1, 2_000_000 // (size + 1) ** 2)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            score = np.round(expected_scores(np.array([lists[i] for i in some])), 12)
            k = score[:, 1:].argmax(axis=1) + 1
            k = np.where(score[:, 0] >= score[np.arange(len(some)), k], 0, k)
            for i, x in zip(some, k.tolist()):
                out[i] = x
    return out


@functools.lru_cache(maxsize=1)
def _best_size():
    @F.arrow_udf("int")
    def size(lists: pa.Array) -> pa.Array:
        return pa.array(best_sizes([x or [] for x in lists.to_pylist()]), pa.int32())

    return size


def best_size(probabilities: Column) -> Column:
    """E2 on a column of descending probabilities."""
    return _best_size()(probabilities)


def decode(pairs: DataFrame, gamma: float | Column = 1.0, floor: float | Column = ASSIGN_FLOOR, keys: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """(keys, cand_id, prob, place) of predicted pairs: probabilities from floor up, raised to gamma and clipped, then E2.

    An S1 record's list is as long as its candidates. gamma and floor may be columns, with their parameters among keys.
    """
    raised = F.least(F.greatest(F.pow("prob", F.lit(gamma) if isinstance(gamma, float) else gamma), F.lit(CLIP)), F.lit(1 - CLIP))
    rows = pairs.where(F.col("prob") >= floor).withColumn("__p", raised)
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("__p")).alias("n"), "cand_id", "prob"))).alias("l"))
    sized = lists.withColumn("k", best_size(F.transform("l", lambda x: -x["n"])))
    return sized.where("k > 0").select(*keys, F.posexplode(F.slice("l", F.lit(1), F.col("k")))).select(*keys, "col.cand_id", "col.prob", F.col("pos").alias("place"))
