"""Reading records and ground truth, writing match lists and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
#: Columns of normalized records that later stages use.
KEEP = ["entity_id", "country", "name_n", "addr_n", "block_text"]
#: Path components that outputs never go to.
GUARDED = ("output_v3",)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A TSV file with a header, all columns text, empty cells as "". Quotes are ordinary characters."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("encoding", "UTF-8").csv(path).na.fill("")


def split_path(base: str, split: str, source: int) -> str:
    """The file of a source in a split (train or test)."""
    if split not in ("train", "test"):
        raise ValueError(f"no such split: {split}")
    return f"{base}/{split}/{split}_source{source}.tsv"


def read_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S3: several sources as one, with the source that the id's prefix names."""
    first, *rest = [read_tsv(spark, p) for p in paths]
    for other in rest:
        first = first.unionByName(other)
    return first.withColumn("source", F.substring("entity_id", 1, 2))


def load_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Read and normalize; partitions take the place of chunks."""
    from kinfold.functions.text import add_normalized

    return add_normalized(read_tsv(spark, path)).select(KEEP)


def explode_truth(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of comma lists; empty items go, repeated ones stay one."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("cand_id")).where("cand_id <> ''").distinct()


def match_lists(s1: DataFrame, pairs: DataFrame, order: list, header: str = "matched_entity_ids") -> DataFrame:
    """One row per S1 entity with its ids joined by commas, in the given order, each once; empty where there is none.

    s1 has entity_id, pairs s1_id and cand_id. An entity's list is as long as its candidates, which the search bounds.
    """
    first = Window.partitionBy("s1_id", "cand_id").orderBy(*order)
    once = pairs.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    place = Window.partitionBy("s1_id").orderBy(*order, "cand_id")
    listed = once.withColumn("__n", F.row_number().over(place)).groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "cand_id"))), lambda x: x["cand_id"]), ",").alias(header))
    return s1.select(F.col("entity_id").alias("source1_entity_id")).join(listed.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left").na.fill("", [header])


def check_target(path: str) -> str:
    """Refuse guarded folders; Spark's writer refuses existing ones by itself."""
    if any(part.lower() in GUARDED for part in path.replace("\\", "/").split("/")):
        raise ValueError(f"refusing to write to {path}")
    return path


def write_tsv(df: DataFrame, path: str) -> None:
    """A TSV with a header and plain newlines, spaces at the ends of cells kept; fails if the target exists."""
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", "").option("emptyValue", "").option("lineSep", "\n").csv(check_target(path))


def checkpoint(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write as Parquet and read back; columns are pruned on reading."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(check_target(path))
    return df.sparkSession.read.parquet(path)


#: Whether an execution's shuffle files go when it ends, rather than when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """S5 for a table within a run: as checkpoint(), but the shuffle files that made it go at once, as it stands for them now."""
    session = df.sparkSession
    before = session.conf.get(CLEANUP, "false")
    session.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(check_target(path))
    finally:
        session.conf.set(CLEANUP, before)
    return session.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() has written and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_position(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """A position pos from 0 in the order of key.

    Ranks are counted in two steps, so no single task sorts all rows: within ranges of the key, then over the ranges'
    sizes. Ranges come from a range partitioning of the key.
    """
    ranged = df.repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn("pos", (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__part", "__rank", "__before")
