"""The registered queries of the corpus operators, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, cover_tree, html_labeller, langid, media, minhash, mixing, suffix_dedup, token_counts, token_files
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with byte_bpe_50k."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place every document in the mixture of the sources with the stated target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.TARGETS, other=mixing.OTHER)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_labeller.extract(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to token files and read them back."""
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings that smaller ones have."""
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a video file and read it back."""
    return media.media_digest(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_token_files": op5_token_files,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_media": op7_media,
    "op8_language": op8_language,
    "op9_minhash": op9_minhash,
    "op10_cover_tree": op10_cover_tree,
}

#: Components by reachability: every node with all it reaches, then the least.
_REACH = "reach(x, root) AS (SELECT x, x FROM nodes UNION SELECT l.x, r.root FROM reach r JOIN links l ON l.y = r.x), comp AS (SELECT x, min(root) AS root FROM reach GROUP BY x)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_TEXTS = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id AS x, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ 	-
]+') AS w FROM documents
), sets AS (
  SELECT x, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), nodes AS (SELECT x FROM sets
), items AS MATERIALIZED (SELECT x, len(s) AS n, unnest(s) AS i FROM sets
), links AS MATERIALIZED (
  SELECT a.x, b.x AS y FROM items a JOIN items b ON a.i = b.i AND a.x <> b.x GROUP BY a.x, b.x, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), {_REACH}
SELECT sets.x AS doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, root = sets.x AS kept FROM sets JOIN comp USING (x)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS x, embedding::DOUBLE[] AS e FROM embeddings
), good AS (SELECT x, e FROM nodes WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), links AS MATERIALIZED (SELECT a.x, b.x AS y FROM good a JOIN good b ON a.x <> b.x AND list_cosine_similarity(a.e, b.e) >= 0.95
), {_REACH.replace('SELECT x, x FROM nodes', 'SELECT x, x FROM (SELECT x FROM nodes)')}
SELECT x AS vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, root = x AS kept
FROM comp LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) USING (x)
"""

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op9_minhash": NEAR_TEXTS,
    "op10_cover_tree": NEAR_VECTORS,
}
