"""Candidates for index records that arrive later, against a fixed S1 side and a fixed vocabulary.

A batch of arrivals is searched in the reverse direction: each new record gets its best S1 records. The vocabulary and
its weights stay those of the last full search, so earlier scores keep their meaning until the next one. The stream
itself keeps no state: a replayed batch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions import text
from kinfold.operators import blocking


def candidates_of(arrivals: DataFrame, s1_weights: DataFrame, terms: DataFrame, reverse_k: int = blocking.REVERSE_K) -> DataFrame:
    """(s1_id, cand_id, score, rank) of raw records (entity_id, country, business_name, business_address)."""
    clean = text.add_normalized(arrivals.na.fill(""))
    records = clean.select("entity_id", "country", text.search_terms(F.col("block_text"), F.col("name_n"), F.col("addr_n")).alias("terms"))
    weighted = blocking.weights(blocking.term_counts(records), terms)
    return blocking.top_k(blocking.similarities(s1_weights, weighted), reverse_k, "cand_id", "s1_id")


def match_arrivals(stream: DataFrame, s1_weights: DataFrame, terms: DataFrame, path: str, checkpoint: str, reverse_k: int = blocking.REVERSE_K) -> StreamingQuery:
    """Write the candidates of each micro-batch to path/batch=<id>. s1_weights and terms should be stage tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        candidates_of(batch, s1_weights, terms, reverse_k).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
