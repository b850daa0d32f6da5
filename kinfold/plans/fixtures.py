"""Records, truth and scores derived from the documents table, for queries and tests.

Every document is a record: its words give a name and an address, doc_id its source, lang its country.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import similarity, text
from kinfold.operators import blocking
from kinfold.sources import io

#: Stage tables of this process: (application, sf_dir, stage) -> path.
_STAGES: dict[tuple[str, str, str], str] = {}


@functools.lru_cache(maxsize=1)
def own_dir() -> str:
    """A folder of this process, for local masters."""
    return "file://" + tempfile.mkdtemp(prefix="kinfold-")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder (spark.checkpoint.dir). Only a local master may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = own_dir()
    return f"{base.rstrip('/')}/scratch/{label}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[blocking.Keep], DataFrame]) -> DataFrame:
    """The table of a stage, written once per application when it is first needed (S5). Later stages read columns of it.

    build may store tables on its way (by the function that it gets); they and all shuffle files go once the stage is written.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        path, parts = scratch(spark, name), []

        def keep(df: DataFrame, label: str) -> DataFrame:
            parts.append(scratch(spark, label))
            return io.stored(df, parts[-1])

        try:
            io.stored(build(keep), path)
        finally:
            for part in parts:
                io.drop(spark, part)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, entity_id, source, country, business_name, business_address."""
    d = documents(spark, sf_dir).withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    source = F.expr("CASE WHEN doc_id % 10 < 3 THEN 'S1' WHEN doc_id % 2 = 0 THEN 'S2' ELSE 'S3' END")
    ending = F.element_at(F.array(*map(F.lit, [" Pvt Ltd", " L.L.C.", "", " & Co", " Inc."])), (F.col("doc_id") % 5 + 1).cast("int"))
    road = F.element_at(F.array(*map(F.lit, [" Rd", " Road", " Nr Opp St"])), (F.col("doc_id") % 3 + 1).cast("int"))
    place = F.concat(F.lit("No. "), (F.col("n_chars") % 997).cast("string"), F.lit(" "), F.array_join(F.slice("w", 5, 12), " "), road, F.lit(", "), (10000 + F.col("n_chars") * 37 % 89999).cast("string"))
    return d.select("doc_id", F.concat(source, F.lit("_"), F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"), F.col("lang").alias("country"), F.concat(F.array_join(F.slice("w", 1, 4), " "), ending).alias("business_name"), F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(place).alias("business_address"), F.array_join(F.slice("w", 1, 4), " ").alias("first_words"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are fewer: what follows costs more than moving narrow rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with name_n, addr_n, block_text; they are ASCII by how they are made."""
    return stage(spark, sf_dir, "normalized", lambda keep: text.add_normalized(spread(records(spark, sf_dir)), ascii_only=True))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """S1 records and the index (S2 and S3), normalized, with search terms."""
    n = normalized(spark, sf_dir).withColumn("terms", text.search_terms(F.col("block_text"), F.col("name_n"), F.col("addr_n")))
    return n.where("source = 'S1'"), n.where("source <> 'S1'")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, index = sides(spark, sf_dir)
    return stage(spark, sf_dir, "candidates", lambda keep: blocking.block(s1.select("entity_id", "country", "terms"), index.select("entity_id", "country", "terms"), keep=keep))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, cand_id): a candidate belongs to the first S1 record of its country with the same four first words.

    A stage: the first words of all texts are made once, not by each side of each join that reads it.
    """
    def build(keep: blocking.Keep) -> DataFrame:
        r = keep(records(spark, sf_dir).select("doc_id", "entity_id", "source", "country", "first_words"), "first_words")
        owners = r.where("source = 'S1'").groupBy("country", "first_words").agg(F.min("doc_id").alias("owner"))
        return r.where("source <> 'S1'").join(owners, ["country", "first_words"]).select(F.concat(F.lit("S1_"), F.col("owner").cast("string")).alias("s1_id"), F.col("entity_id").alias("cand_id"))

    return stage(spark, sf_dir, "truth", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, cand_id, prob, rank): a fixed stand-in for a model's probability, half search score, half name overlap."""
    def build(keep: blocking.Keep) -> DataFrame:
        s1, index = sides(spark, sf_dir)
        pairs = candidates(spark, sf_dir)
        pairs = pairs.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("name_n").alias("n1")), "s1_id").join(index.select(F.col("entity_id").alias("cand_id"), F.col("name_n").alias("n2")), "cand_id")
        overlap = similarity.jaccard(similarity.distinct_words(F.col("n1")), similarity.distinct_words(F.col("n2")))
        return pairs.select("s1_id", "cand_id", F.round(0.5 * F.col("score") + 0.5 * F.greatest(overlap, F.lit(0.0)), 6).alias("prob"), "rank")

    return stage(spark, sf_dir, "scored", build)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, pos): a fixed position of each S1 record, by its document."""
    return records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.col("doc_id").alias("pos"))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all candidates."""
    from kinfold.operators import features

    n = normalized(spark, sf_dir)
    return stage(spark, sf_dir, "features", lambda keep: features.make_features(candidates(spark, sf_dir), n.where("source = 'S1'"), n.where("source <> 'S1'"), keep))
