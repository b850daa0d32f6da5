"""Mixing sources to target weights (operator 3): Pfair scheduling by DataFrame functions alone.

Time runs in slots of one block (block_rows documents) each. Weights are whole numbers; Q is their sum, and a source's
target share is its weight q over Q. Its k-th block (from 0) is released at slot floor(k * Q / q) and due by the end of
slot ceil((k + 1) * Q / q). In every slot the released block with the earliest deadline runs (ties: the larger weight,
then source order). As shares add up to 1, all deadlines are met, so up to any slot t each source has had more than
t * q / Q - 1 and fewer than t * q / Q + 1 blocks: less than one block from its target, however long the run is.

The schedule repeats after Q slots. It is folded once, over a one-row table, up to Q or to the slot at which the first
source runs out, whichever comes first; every block looks its slot up. Sources of equal weight have equal windows and
run one after another, so the fold keeps one number for each distinct weight, and sources may be many.

Targets are given as numbers and taken as exact fractions. Only where their common sum would exceed GRAIN they are
rounded to parts of GRAIN, which moves a share by less than 1 / GRAIN. Without targets, the target weights are the
sources' rows to the power of temper in parts of PARTS (largest remainders).
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Weights of op3_mixing and of the pipeline: the sources of the corpus, and every other source.
TARGETS = {f"src{i}": 30 - i for i in range(20)}
OTHER = 5
GRAIN = 10**9
PARTS = 10**5
BLOCK_ROWS = 4
TEMPER = 0.7
BUCKET_ROWS, SUPER = 256, 1024
#: Slots of a schedule that is broadcast (about 25 MB); longer ones are joined by shuffle, over as many keys.
BROADCAST_SLOTS = 1 << 20


def source_key(c: Column) -> Column:
    """A key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def whole_weights(targets: Mapping[str | None, float], other: float) -> tuple[dict[str | None, int], int]:
    """The targets and the weight of other sources as whole numbers of the same proportions, smallest ones first tried."""
    given = {k: Fraction(str(v)) for k, v in targets.items()} | {Ellipsis: Fraction(str(other))}
    if any(v < 0 for v in given.values()):
        raise ValueError("a target weight is negative")
    scale = Fraction(math.lcm(*(v.denominator for v in given.values())), math.gcd(*(int(v * math.lcm(*(x.denominator for x in given.values()))) for v in given.values())) or 1)
    whole = {k: int(v * scale) for k, v in given.items()}
    if (total := sum(whole.values())) > GRAIN:
        whole = {k: max(1, round(Fraction(v * GRAIN, total))) if v else 0 for k, v in whole.items()}
    return {k: v for k, v in whole.items() if k is not Ellipsis}, whole[Ellipsis]


def weights_of(counts: DataFrame, targets: Mapping[str | None, float] | None, other: float, temper: float) -> DataFrame:
    """counts (key, n) with q, its whole weight."""
    if targets is not None:
        whole, rest = whole_weights(targets, other)
        table = F.from_json(F.lit(json.dumps({"null" if k is None else "=" + k: v for k, v in whole.items()})), "map<string,bigint>")
        return counts.withColumn("q", F.coalesce(F.try_element_at(table, F.col("key")), F.lit(rest).cast("long")))
    every = Window.partitionBy(F.lit(0))
    return (
        counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temper))))
        .withColumn("share", F.round(F.col("w") / F.sum("w").over(every) * PARTS, 9))
        .withColumn("base", F.floor("share"))
        .withColumn("left", PARTS - F.sum("base").over(every))
        .withColumn("place", F.row_number().over(every.orderBy(F.round(F.col("share") - F.col("base"), 9).desc(), "key")))
        .select("key", "n", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).cast("long").alias("q"))
    )


#: Folds one slot: the earliest deadline among the weights whose next block is released, as block * weights + weight.
_SLOT = """aggregate(sequence(c * size, least(c * size + size, slots) - 1), struct(state.had AS had, cast(array() AS array<bigint>) AS picks), (s, t) ->
  transform(array(cast(array_min(transform(s.had, (h, i) -> CASE WHEN h div ms[i] * total div qs[i] <= t
    THEN ((h div ms[i] + 1) * total + qs[i] - 1) div qs[i] * size(qs) + i END)) % size(qs) AS int)), p ->
    struct(transform(s.had, (h, i) -> CASE WHEN i = p THEN h + 1 ELSE h END) AS had, concat(s.picks, array(s.had[p] * size(qs) + p)) AS picks))[0])"""
#: Folds the run in chunks of about the square root of its slots, so that no long list is copied slot by slot.
_RUN = f"""aggregate(sequence(0L, (slots - 1) div size), struct(transform(qs, q -> 0L) AS had, cast(array() AS array<array<bigint>>) AS chunks), (state, c) ->
  transform(array({_SLOT}), x -> struct(x.had AS had, concat(state.chunks, array(x.picks)) AS chunks))[0], state -> state.chunks)"""


def schedule(weights: DataFrame, block_rows: int) -> DataFrame:
    """c, n, slot: the slot of the n-th block of the sources of the c-th weight, up to a period or the first dry source.

    weights has one row per source: n, q, c (place of its weight among the distinct ones, from 0) and m (sources of that
    weight). Of those sources, each has its k-th block before any has its next one.
    """
    live = weights.where("q > 0")
    classes = F.array_sort(F.collect_set(F.struct("c", "q", "m")))
    one = (
        live.groupBy()
        .agg(classes.alias("classes"), F.sum("q").alias("total"), F.min(F.expr(f"(n + {block_rows - 1}) div {block_rows} + 1").alias("b")).alias("least"), F.collect_set(F.struct(F.expr(f"(n + {block_rows - 1}) div {block_rows} + 1").alias("b"), "q")).alias("ends"))
        .where("total is not null")
        .selectExpr("transform(classes, x -> x.q) AS qs", "transform(classes, x -> x.m) AS ms", "total", "least(total, array_min(transform(ends, x -> cast(least(cast(x.b AS decimal(38, 0)) * total + x.q - 1, 9e18BD) AS bigint) div x.q))) AS slots")
        .withColumn("size", F.ceil(F.sqrt("slots")).cast("long"))
    )
    chunks = one.select("size", F.size("qs").alias("weights"), F.expr(_RUN).alias("chunks")).select("size", "weights", F.posexplode("chunks").alias("at", "picks"))
    return chunks.select((F.col("at") * F.col("size")).alias("first"), "weights", F.posexplode("picks").alias("step", "pick")).selectExpr("cast(pick % weights AS int) AS c", "pick div weights AS n", "first + step AS slot")


def positions(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """rows (key, h, id, ...) with source_pos, and counts (key, n): rows of a key numbered by (h, id).

    A hot source is dealt over buckets of about BUCKET_ROWS rows by a prefix of h. Each bucket is numbered by itself and
    moved on by the counts before it, which are summed first by SUPER buckets and then within those.
    """
    buckets = max(1, total // BUCKET_ROWS)
    prefix = F.coalesce(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit((1 << 32) - 1))
    rows = rows.withColumn("bucket", F.floor(prefix * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    per = rows.groupBy("key", "bucket").agg(F.count("*").alias("m")).withColumn("super", F.expr(f"bucket div {SUPER}"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    supers = per.groupBy("key", "super").agg(F.sum("m").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(ahead("key").orderBy("super")), F.lit(0)))
    inner = per.withColumn("inner", F.coalesce(F.sum("m").over(ahead("key", "super").orderBy("bucket")), F.lit(0)))
    before = inner.join(supers.select("key", "super", "ahead"), ["key", "super"]).select("key", "bucket", (F.col("ahead") + F.col("inner")).alias("before"))
    local = Window.partitionBy("key", "bucket").orderBy("h", F.asc_nulls_last("id"))
    numbered = rows.withColumn("rn", F.row_number().over(local)).join(before, ["key", "bucket"]).withColumn("source_pos", (F.col("before") + F.col("rn")).cast("long"))
    return numbered, supers.groupBy("key").agg(F.sum("m").alias("n"))


def mix(
    df: DataFrame,
    targets: Mapping[str | None, float] | None = None,
    *,
    other: float = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    temper: float = TEMPER,
    carry: bool = False,
) -> DataFrame:
    """Place every row in the mixture: id, source, source_pos, block, slot_release, slot_due, slot, pos_in_block, in_mix.

    Rows of a source follow each other by (md5 of the id, id), a fixed shuffle. slot is the time of the row's block;
    ordering by (slot, pos_in_block) is the interleaved order. No row is dropped. in_mix tells whether all sources that
    the table has still had blocks at the row's slot, so that shares hold; later blocks follow by deadline, each with a
    slot of its own, so the sources that are left keep their proportions. targets gives weights by source (None for the
    null source), other that of sources it doesn't name; a target of 0 puts a source after all others, without release
    or deadline, and targets of sources that the table lacks have no effect.

    A null source is a source of its own; null ids are ordered last; repeated rows get places of their own; an empty
    table gives none; other columns are not looked at. With carry, a struct column `row` holds all columns.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("key"), F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("g")).alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []))
    numbered, counts = positions(rows, df.select(F.lit(1)).count())
    every = Window.partitionBy(F.lit(0))
    # one row per source: its place i by key, that of its weight c, and its place j among the m sources of that weight
    weights = materialize(
        weights_of(counts, targets, other, temper)
        .withColumn("i", (F.row_number().over(every.orderBy("key")) - 1).cast("long"))
        .withColumn("c", F.dense_rank().over(every.orderBy(F.desc("q"))) - 1)
        .withColumn("j", (F.row_number().over(Window.partitionBy("q").orderBy("key")) - 1).cast("long"))
        .withColumn("m", F.count("*").over(Window.partitionBy("q")))
        .withColumn("blocks", F.expr(f"(n + {block_rows - 1}) div {block_rows}")),
        "mix_weights",
    )
    slots = materialize(schedule(weights, block_rows), "mix_slots")
    held = F.broadcast(slots) if slots.count() <= BROADCAST_SLOTS else slots
    whole = weights.groupBy().agg(F.sum("q").alias("total"), F.count("*").alias("sources"))
    turn = "CASE WHEN q > 0 THEN block % q * m + j END"
    lacking = weights.withColumn("block", F.col("blocks")).withColumn("n", F.expr(turn)).join(slots.withColumnRenamed("slot", "held"), ["c", "n"]).crossJoin(F.broadcast(whole.select("total")))
    dry = lacking.agg(F.min(F.expr("block div q * total + held")).alias("dry"))
    last = weights.crossJoin(F.broadcast(whole)).agg(F.max("total").alias("total"), F.max("sources").alias("sources"), F.max(F.expr("CASE WHEN q > 0 THEN (blocks * total + q - 1) div q END")).alias("last"))
    plan = weights.select("key", "i", "q", "c", "j", "m").crossJoin(F.broadcast(dry)).crossJoin(F.broadcast(last))
    # sources are components of a mixture: their table is broadcast only where Spark finds it small
    placed = numbered.withColumn("block", F.expr(f"(source_pos - 1) div {block_rows}")).join(plan, "key").withColumn("n", F.expr(turn)).join(held.withColumnRenamed("slot", "held"), ["c", "n"], "left")
    late = "CASE WHEN q > 0 THEN dry + (slot_due - dry - 1) * sources + i ELSE coalesce(dry + greatest(last - dry, 0) * sources, 0) + block * sources + i END"
    return (
        placed.withColumn("held", F.expr("CASE WHEN q > 0 THEN block div q * total + held END"))
        .withColumn("slot_release", F.expr("CASE WHEN q > 0 THEN block * total div q END"))
        .withColumn("slot_due", F.expr("CASE WHEN q > 0 THEN ((block + 1) * total + q - 1) div q END"))
        .withColumn("in_mix", F.coalesce(F.col("held") < F.col("dry"), F.lit(False)))
        .withColumn("slot", F.when(F.col("in_mix"), F.col("held")).otherwise(F.expr(late)).cast("long"))
        .select(F.col("id").alias(id_col), "source", "source_pos", "block", "slot_release", "slot_due", "slot", ((F.col("source_pos") - 1) % block_rows).cast("long").alias("pos_in_block"), "in_mix", *(["row"] if carry else []))
    )


def mixed(df: DataFrame, targets: Mapping[str | None, float] | None = None, *, other: float = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of df in mixture order: partitions and the rows in them follow (slot, pos_in_block)."""
    placed = mix(df, targets, other=other, id_col=id_col, source_col=source_col, carry=True).select("slot", "pos_in_block", "row")
    return placed.repartitionByRange("slot", "pos_in_block").sortWithinPartitions("slot", "pos_in_block").select("row.*")


#: By the definition: the windows of every source, a slot at a time over one period, repeated.
ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce('=' || source, 'null') AS key, count(*) AS n FROM documents GROUP BY 1
), weights AS (
  SELECT key, n, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS sources, ceil(n / {BLOCK_ROWS})::BIGINT AS blocks,
         coalesce(map({[f'={k}' for k in TARGETS]}, {list(TARGETS.values())})[key], {OTHER})::BIGINT AS q
  FROM counts
), qs AS (
  SELECT list(q ORDER BY i) AS qs, sum(q)::BIGINT AS total FROM weights
), steps(slot, pick, had) AS (
  SELECT -1, -1, list_transform(qs, lambda x: 0::BIGINT) FROM qs
  UNION ALL
  SELECT slot + 1, pick2, list_transform(had, lambda h, j: CASE WHEN j - 1 = pick2 THEN h + 1 ELSE h END)
  FROM (
    SELECT slot, had, list_min(list_transform(had, lambda h, j: CASE WHEN h * total // qs[j] <= slot + 1
             THEN [((h + 1) * total + qs[j] - 1) // qs[j], -qs[j], j - 1] END))[3] AS pick2
    FROM steps, qs WHERE slot + 1 < total
  )
), slots AS (
  SELECT pick AS i, list(slot ORDER BY slot) AS slots FROM steps WHERE slot >= 0 GROUP BY pick
), plan AS (
  SELECT key, q, i, slots, total, sources, min(blocks // q * total + slots[blocks % q + 1]) OVER () AS dry
  FROM weights JOIN slots USING (i), qs
), ranked AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS source_pos
  FROM documents
), placed AS (
  SELECT *, (source_pos - 1) // {BLOCK_ROWS} AS block FROM ranked JOIN plan USING (key)
), timed AS (
  SELECT *, block * total // q AS slot_release, ((block + 1) * total + q - 1) // q AS slot_due, block // q * total + slots[block % q + 1] AS held FROM placed
)
SELECT doc_id, source, source_pos, block::BIGINT AS block, slot_release::BIGINT AS slot_release, slot_due::BIGINT AS slot_due,
       (CASE WHEN held < dry THEN held ELSE dry + (slot_due - dry - 1) * sources + i END)::BIGINT AS slot,
       CAST((source_pos - 1) % {BLOCK_ROWS} AS BIGINT) AS pos_in_block, held < dry AS in_mix
FROM timed
"""
