"""Connected components by alternating large-star and small-star steps, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

#: Shares that the rows of one node are dealt into.
SHARES = 64


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """edges with m, the least other of each key.

    The least comes back by way of the least of each of SHARES shares of a key's rows, so a key with a third of all rows
    is at most SHARES rows in the window by key, and its rows are dealt over SHARES tasks.
    """
    dealt = edges.withColumn("share", F.pmod(F.xxhash64(other), F.lit(SHARES)).cast("int"))
    parts = dealt.groupBy(key, "share").agg(F.min(other).alias("part"))
    least = parts.select(key, "share", F.min("part").over(Window.partitionBy(key)).alias("m"))
    return dealt.join(least.hint("merge"), [key, "share"]).select(key, other, "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the least of its component; edges has long columns a and b.

    Large-star joins each node's larger neighbours to its least neighbour, small-star its smaller ones; after a
    logarithmic number of rounds every component is a star around its least node. Each round is written to the shared
    folder, and the one before it dropped.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    seen = _fingerprint(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        small = _with_least(large, "hi", "lo").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        before, now = now, materialize(small, "edges")
        discard(before)
        if (found := _fingerprint(now)) == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = found
