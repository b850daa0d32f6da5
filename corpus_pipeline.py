"""The corpus pipeline: language ID, near-dedup, suffix dedup, mixing and BPE encoding of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and
read back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, langid, minhash, mixing, suffix_dedup
from kinfold.llm.common import BATCH, ROWS, fresh, materialize, table

#: A text is taken for no language where its cosine with the nearest one is under what a text of its length should have:
#: LEAST_COSINE for long texts, less by sqrt(n / (n + HALF)) for n letter triples, as short texts hold few of a language's
#: triples. Random letters of any length lie under 0.14; single words of a learnt language lie above their bound.
LEAST_COSINE, HALF = 0.14, 300

#: Documents of which that many percent of their shingles are shared are near duplicates. The 85 of op9_minhash is that
#: query's own.
NEAR_PERCENT = 80

#: Words whose ids a Python worker of the last stage holds, and bytes of text that it works on at a time: less than the
#: operator's own, as whole rows pass beside them. Ids don't depend on either.
WORDS, SLICE = 50_000, 4 << 20

#: The language model and the near-duplicate search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ROWS rows, as whole documents pass through Python beside large arrays.

    The caller runs what a stage returns, so this stays set; it is one value for all stages and never raises a lower one.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= int(ROWS):
        spark.conf.set(BATCH, ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learnt language; those without letters or like none of the languages go.

    Null and empty texts go; repeated rows stay or go together; an empty table, or one without labels, keeps nothing.
    Columns of any name stay as they are.
    """
    small_batches(spark)
    columns = docs.columns
    model = langid.fit(langid.held_out(docs.select("doc_id", "text", "lang")).where(~F.col("held_out")))
    lang, score, n = (fresh(x, columns) for x in ("told", "cosine", "triples"))
    told = langid.predict(docs, model, keep=tuple(columns), names=(lang, score, n))
    least = LEAST_COSINE * F.sqrt(F.col(n) / (F.col(n) + HALF))
    return told.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least)).select(*[f"`{c}`" for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).

    Documents without words, and those without an id, stay. Rows that repeat an id are one document and go or stay
    together. An empty table stays empty; columns of any name stay as they are.
    """
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut from each text the strings of 50 bytes that a document with a smaller id has; n_chars follows.

    All rows stay: null texts are null, and texts that others hold whole become empty. A character of which a byte goes
    goes as a whole. Rows that repeat an id are one document; an empty table stays empty; other columns stay.
    """
    small_batches(spark)
    cut = suffix_dedup.deduplicated(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order all documents by the schedule of the stated target weights, file by file and row by row.

    All rows stay, a null source being one of its own; an empty table stays empty; columns of any name stay.
    """
    return mixing.mixed(docs, mixing.TARGETS, other=mixing.OTHER).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's ids and their number n_tokens, and its place in the mixture: mix_file and mix_row, the file
    and row of what mixing wrote (null where docs don't come from files).

    Null and empty texts have no ids. Columns of docs that have one of these four names get an underscore after it.
    """
    small_batches(spark)
    taken = [c.lower() for c in docs.columns]
    renamed = {c: fresh(c + "_", docs.columns) for c in docs.columns if c.lower() in ("ids", "n_tokens", "mix_file", "mix_row")}
    try:
        placed = docs.withColumn(fresh("mix_file", taken), F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")).withColumn(fresh("mix_row", taken), F.col("_metadata.row_index"))
    except AnalysisException:  # docs don't come from files
        placed = docs.withColumn(fresh("mix_file", taken), F.lit(None).cast("int")).withColumn(fresh("mix_row", taken), F.lit(None).cast("long"))
    held = placed.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in docs.columns], F.col(fresh("mix_file", taken)).alias("mix_file"), F.col(fresh("mix_row", taken)).alias("mix_row"))
    return bpe.encoded(held, public_tokenizers.path("byte_bpe_50k.json"), words=WORDS, slice_bytes=SLICE).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", exact_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
