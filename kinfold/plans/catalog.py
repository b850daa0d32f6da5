"""Registered queries, one or more for each operator, and their DuckDB oracles.

Names start with the operator's id. Scores are shown to six places, as sums differ in their last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions import similarity, tables, text
from kinfold.operators import blocking, decide, features, metrics, model
from kinfold.plans import fixtures as fx
from kinfold.plans import oracle as o
from kinfold.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


scratch = fx.scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str):
    return F.round(c, 6).alias(c)


# ---- string functions (N): each step on its own over strings made to exercise it

_MESSY = "lower(coalesce(w[1], 'x')) || '-' || coalesce(w[2], 'y') || '/' || coalesce(w[3], 'z') || ' & a/k/a d.b.a. dba u.s.a. l.l.p. a.b.cd ' || n_chars || '/' || (n_chars + 7) || ' 00' || n_chars || ' x-1 12-a - / -- c0mp4ny 2nd 109th 2eme e18 abc-1 New York, new delhi; tamil nadu 000 k3rala-' || coalesce(w[2], 'q') || '-'"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.documents(spark, sf_dir).withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    w = lambda i, x: F.coalesce(F.get("w", F.lit(i - 1)), F.lit(x))
    n = F.col("n_chars")
    return d.select(
        "doc_id",
        F.concat(F.lower(w(1, "x")), F.lit("-"), w(2, "y"), F.lit("/"), w(3, "z"), F.lit(" & a/k/a d.b.a. dba u.s.a. l.l.p. a.b.cd "), n.cast("string"), F.lit("/"), (n + 7).cast("string"), F.lit(" 00"), n.cast("string"), F.lit(" x-1 12-a - / -- c0mp4ny 2nd 109th 2eme e18 abc-1 New York, new delhi; tamil nadu 000 k3rala-"), w(2, "q"), F.lit("-")).alias("s"),
    )


_SOURCE = f"messy AS (SELECT doc_id, {_MESSY} AS s FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))"


def _step(name: str, f, g) -> None:
    register(name, lambda spark, d, f=f: messy(spark, d).select("doc_id", f(F.col("s")).alias("out")), f"WITH {_SOURCE} SELECT doc_id, {g('s')} AS out FROM messy")


_step("n02_lowercase", F.lower, lambda x: f"lower({x})")
_step("n03_aliases", lambda c: text.drop_aliases(F.lower(c)), lambda x: o.aliases(f"lower({x})"))
_step("n04_acronyms", lambda c: text.collapse_acronyms(F.lower(c)), lambda x: o.acronyms(f"lower({x})"))
_step("n05_ampersand", text.spell_ampersand, o.ampersand)
_step("n06_split_joined", lambda c: text.split_joined(F.lower(c)), lambda x: o.joined(f"lower({x})"))
_step("n07_punctuation", lambda c: text.drop_punctuation(F.lower(c)), lambda x: o.punctuation(f"lower({x})"))
_step("n08_stray", lambda c: text.prune_stray(F.lower(c)), lambda x: o.stray(f"lower({x})"))
_step("n09_phrases", lambda c: text.shorten_phrases(F.lower(c)), lambda x: o.phrases(f"lower({x})"))
_joined = lambda c: F.array_join(c, " ")
_step("n10_words", lambda c: _joined(text.split_words(c)), lambda x: f"array_to_string({o.words(x)}, ' ')")
_step("n11_zeros", lambda c: _joined(F.transform(text.split_words(c), text.strip_zeros)), lambda x: f"array_to_string(list_transform({o.words(x)}, lambda t: {o.zeros('t')}), ' ')")
_step("n12_leet", lambda c: _joined(F.transform(text.split_words(c), text.undo_leet)), lambda x: f"array_to_string(list_transform({o.words(x)}, lambda t: {o.leet('t')}), ' ')")
_step("n13_ordinals", lambda c: _joined(F.filter(text.split_words(c), text.is_ordinal)), lambda x: f"array_to_string(list_filter({o.words(x)}, lambda t: regexp_matches(t, '{tables.ORDINAL}')), ' ')")
_step("n15_address_words", lambda c: _joined(F.transform(F.array(F.lit("rd"), F.lit("ct"), F.lit("bengaluru"), F.substring(c, 1, 1)), text.expand_address_word)), lambda x: f"array_to_string(list_transform(['rd', 'ct', 'bengaluru', substr({x}, 1, 1)], lambda t: {o.mapped(tables.ADDRESS_WORDS, 't')}), ' ')")
_step("n16_states", lambda c: _joined(F.transform(F.array(F.lit("connecticut"), F.lit("ts"), F.lit("goa"), F.lit("kerala"), F.substring(c, 1, 2)), text.shorten_state)), lambda x: f"array_to_string(list_transform(['connecticut', 'ts', 'goa', 'kerala', substr({x}, 1, 2)], lambda t: {o.mapped(tables.STATES, 't')}), ' ')")
_step("n17_address_tail", lambda c: _joined(text.address_words(F.split(F.concat(F.lit("shop no 4 mg rd ste 5 apt alabama the "), F.substring(c, 1, 4)), " "))), lambda x: f"array_to_string({o.address_words('string_split(' + chr(39) + 'shop no 4 mg rd ste 5 apt alabama the ' + chr(39) + f' || substr({x}, 1, 4), ' + chr(39) + ' ' + chr(39) + ')')}, ' ')")

# non-ASCII text of the corpus holds accents only, which DuckDB can strip; the rest of what isn't ASCII goes
register(
    "n01_ascii",
    lambda spark, d: fx.documents(spark, d).select("doc_id", text.to_ascii(F.regexp_replace("text", "[^\\x00-\\x7f\\u00c0-\\u00ff]", "")).alias("out")),
    r"SELECT doc_id, regexp_replace(strip_accents(regexp_replace(text, '[^\x00-\x7f\x{c0}-\x{ff}]', '', 'g')), '[^\x00-\x7f]', '', 'g') AS out FROM documents",
)
register("n14_names", lambda spark, d: fx.normalized(spark, d).select("entity_id", "name_n"), o.sql("SELECT entity_id, name_n FROM norm", "norm"))
register("n18_addresses", lambda spark, d: fx.normalized(spark, d).select("entity_id", "addr_n"), o.sql("SELECT entity_id, addr_n FROM norm", "norm"))
register("n19_number_parts", lambda spark, d: messy(spark, d).select("doc_id", _joined(text.number_parts(text.drop_punctuation(F.lower("s")))).alias("out")), f"WITH {_SOURCE} SELECT doc_id, array_to_string({o.parts(o.split(o.punctuation('lower(s)')))}, ' ') AS out FROM messy")
register("n20_block_text", lambda spark, d: fx.normalized(spark, d).select("entity_id", "block_text"), o.sql("SELECT entity_id, block_text FROM norm", "norm"))
register("n21_add_normalized", lambda spark, d: fx.normalized(spark, d).select("entity_id", "country", "name_n", "addr_n", "block_text"), o.sql("SELECT entity_id, country, name_n, addr_n, block_text FROM norm", "norm"))
_WHOLE = r"ascii AS (SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')) AS t FROM documents)"
register("n01_ascii_documents", lambda spark, d: fx.documents(spark, d).select("doc_id", F.lower(text.to_ascii(F.col("text"))).alias("out")), f"WITH {_WHOLE} SELECT doc_id, t AS out FROM ascii")
register(
    "n21_documents",
    lambda spark, d: fx.documents(spark, d).select("doc_id", text.normalize_name(F.col("text")).alias("name_n")),
    f"WITH {_WHOLE}, based AS MATERIALIZED (SELECT doc_id, {o.base('t')} AS b FROM ascii), parted AS MATERIALIZED (SELECT doc_id, list_transform(list_transform({o.words('b')}, lambda t: {o.zeros('t')}), lambda t: {o.leet('t')}) AS w FROM based) SELECT doc_id, array_to_string({o.name_words('w')}, ' ') AS name_n FROM parted",
)

# ---- sources and sinks (S)

_RECORDS = ["entity_id", "business_name", "business_address", "country"]


def _tsv(spark: SparkSession, d: str, where: str = "true") -> str:
    path = scratch(spark, "records")
    io.write_tsv(fx.records(spark, d).where(where).select(_RECORDS), path)
    return path


register("s01_tsv_scan", lambda spark, d: io.read_tsv(spark, _tsv(spark, d)), o.sql(f"SELECT {', '.join(_RECORDS)} FROM records", "records"))
register("s02_load_normalized", lambda spark, d: io.load_normalized(spark, _tsv(spark, d)), o.sql("SELECT entity_id, country, name_n, addr_n, block_text FROM norm", "norm"))
register("s03_index_scan", lambda spark, d: io.read_index(spark, [_tsv(spark, d, "source = 'S2'"), _tsv(spark, d, "source = 'S3'")]), o.sql(f"SELECT {', '.join(_RECORDS)}, source FROM records WHERE source <> 'S1'", "records"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    """Records written as the files of both splits, and read back by way of the selector."""
    base, found = scratch(spark, "splits"), None
    for split, rest in (("train", 0), ("test", 1)):
        for source in (1, 2, 3):
            path = io.split_path(base, split, source)
            io.write_tsv(fx.records(spark, d).where(f"source = 'S{source}' and doc_id % 2 = {rest}").select(_RECORDS), path)
            rows = io.read_tsv(spark, path).withColumns({"split": F.lit(split), "source": F.lit(source)})
            found = rows if found is None else found.unionByName(rows)
    return found


register("s04_split_files", _splits, o.sql(f"SELECT {', '.join(_RECORDS)}, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, substr(source, 2)::INT AS source FROM records", "records"))
register("s05_checkpoint", lambda spark, d: io.checkpoint(fx.records(spark, d).select("country", *_RECORDS[:3]), scratch(spark, "checkpoint"), ["country"]).select("entity_id", "country"), o.sql("SELECT entity_id, country FROM records", "records"))
register("s06_column_pruned_read", lambda spark, d: fx.normalized(spark, d).select("entity_id", "addr_n"), o.sql("SELECT entity_id, addr_n FROM norm", "norm"))


def _truth_lists(spark: SparkSession, d: str) -> DataFrame:
    s1 = fx.records(spark, d).where("source = 'S1'")
    return io.match_lists(s1, fx.truth(spark, d), [F.col("cand_id")])


_TRUTH_LISTS = "SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY ALL"
register("s07_truth_explode", lambda spark, d: io.explode_truth(_truth_lists(spark, d)), o.sql("SELECT s1_id, cand_id FROM truth", "truth"))
register("s08_truth_lists", _truth_lists, o.sql(_TRUTH_LISTS, "s1", "truth"))
register(
    "s08_match_lists",
    lambda spark, d: io.match_lists(fx.records(spark, d).where("source = 'S1'"), decide.assign(fx.scored(spark, d)), [F.desc("prob")]),
    o.sql("SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY prob DESC, cand_id), '') AS matched_entity_ids FROM s1 LEFT JOIN assigned USING (s1_id) GROUP BY ALL", "s1", "assigned"),
)
register(
    "s08_candidate_lists",
    lambda spark, d: io.match_lists(fx.records(spark, d).where("source = 'S1'"), fx.candidates(spark, d), [F.col("rank")], "candidate_entity_ids"),
    o.sql("SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY rank), '') AS candidate_entity_ids FROM s1 LEFT JOIN cand USING (s1_id) GROUP BY ALL", "s1", "cand"),
)



def _guarded(spark: SparkSession, d: str) -> DataFrame:
    """Which targets a writer refuses: those in guarded folders, and ones that exist."""
    rows = fx.records(spark, d).select("entity_id")
    base, out = scratch(spark, "guard"), []
    for case, path in (("fresh", f"{base}/out"), ("again", f"{base}/out"), ("guarded", f"{base}/output_v3/out"), ("guarded_upper", f"{base}/OUTPUT_V3"), ("like_guarded", f"{base}/output_v31")):
        try:
            io.write_tsv(rows, path)
            out.append((case, False))
        except (ValueError, AnalysisException):
            out.append((case, True))
    return spark.createDataFrame(out, "target string, refused boolean")


register("s10_output_guard", _guarded, "SELECT * FROM (VALUES ('fresh', FALSE), ('again', TRUE), ('guarded', TRUE), ('guarded_upper', TRUE), ('like_guarded', FALSE)) t(target, refused)")

# ---- candidate search (B)


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s1, index = fx.sides(spark, d)
    return s1.select("entity_id", "country", "terms"), index.select("entity_id", "country", "terms")


def _address_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = fx.normalized(spark, d).withColumn("terms", text.address_terms(F.col("addr_n")))
    return n.where("source = 'S1' and doc_id % 20 = 0"), n.where("source <> 'S1'")


def _address_pairs(spark: SparkSession, d: str) -> DataFrame:
    s1, index = (x.select("entity_id", "country", "terms") for x in _address_sides(spark, d))
    return fx.stage(spark, d, "address_pairs", lambda keep: blocking.address_search(s1, index, 20, keep=keep))


def _vocabulary(spark: SparkSession, d: str, max_df: int = blocking.MAX_DF) -> DataFrame:
    index = _terms(spark, d)[1]
    return blocking.vocabulary(index, blocking.term_counts(index), max_df)


def _weights(spark: SparkSession, d: str, which: int) -> DataFrame:
    sides = _terms(spark, d)
    return blocking.weights(blocking.term_counts(sides[which]), _vocabulary(spark, d))


register("b01_word_pairs", lambda spark, d: fx.sides(spark, d)[1].select("entity_id", F.array_join("terms", " ").alias("terms")), o.sql("SELECT entity_id, array_to_string(terms, ' ') AS terms FROM terms WHERE source <> 'S1'", "terms"))
register("b02_term_counts", lambda spark, d: blocking.term_counts(_terms(spark, d)[1]), o.sql("SELECT country, entity_id, term, tf FROM m_tf WHERE source <> 'S1'", "m_tf"))
register("b03_vocabulary", lambda spark, d: _vocabulary(spark, d).select("country", "term", "df", r6("idf")), o.sql("SELECT country, term, df, round(idf, 6) AS idf FROM m_vocab", "m_vocab"))
o.CTES |= o.search("t", "terms", max_df=40)
register("b03_pruned_vocabulary", lambda spark, d: _vocabulary(spark, d, 40).select("country", "term", "df"), o.sql("SELECT country, term, df FROM t_vocab", "t_vocab"))
o.CTES |= o.search("z", "terms", max_df=0)
register("b04_fallback", lambda spark, d: _vocabulary(spark, d, 0).select("country", "term", "df"), o.sql("SELECT country, term, df FROM z_vocab", "z_vocab"))
register("b05_index_weights", lambda spark, d: _weights(spark, d, 1).select("country", "entity_id", "term", r6("w")), o.sql("SELECT country, entity_id, term, round(w, 6) AS w FROM m_w WHERE source <> 'S1'", "m_w"))
register("b06_s1_weights", lambda spark, d: _weights(spark, d, 0).select("country", "entity_id", "term", r6("w")), o.sql("SELECT country, entity_id, term, round(w, 6) AS w FROM m_w WHERE source = 'S1'", "m_w"))
register("b07_similarities", lambda spark, d: blocking.scored_pairs(*_terms(spark, d)).select("s1_id", "cand_id", r6("score")), o.sql("SELECT s1_id, cand_id, round(score, 6) AS score FROM m_score", "m_score"))
_TOP = "SELECT s1_id, cand_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {a} ORDER BY round(score, 9) DESC, {b}) - 1 AS rank FROM m_score) WHERE rank < {k}"
register("b08_top_k", lambda spark, d: blocking.forward_top_k(*_terms(spark, d), 5).select("s1_id", "cand_id", r6("score"), "rank"), o.sql(_TOP.format(a="s1_id", b="cand_id", k=5), "m_score"))
register("b09_forward_topk", lambda spark, d: blocking.forward_top_k(*_terms(spark, d), blocking.K).select("s1_id", "cand_id", r6("score"), "rank"), o.sql(_TOP.format(a="s1_id", b="cand_id", k=20), "m_score"))
register("b10_reverse_topk", lambda spark, d: blocking.reverse_top_k(*_terms(spark, d), blocking.REVERSE_K).select("s1_id", "cand_id", r6("score"), "rank"), o.sql(_TOP.format(a="cand_id", b="s1_id", k=3), "m_score"))
register("b11_union_of_directions", lambda spark, d: blocking.block(*_terms(spark, d), 5, 2).select("s1_id", "cand_id"), o.sql(f"SELECT s1_id, cand_id FROM ({o.ranked('m_score', 5, 2)})", "m_score"))
register("b12_rerank", lambda spark, d: blocking.block(*_terms(spark, d), 5, 2).select("s1_id", "cand_id", "rank"), o.sql(f"SELECT s1_id, cand_id, rank FROM ({o.ranked('m_score', 5, 2)})", "m_score"))
register("b13_block", lambda spark, d: fx.candidates(spark, d).select("s1_id", "cand_id", r6("score"), "rank"), o.sql("SELECT s1_id, cand_id, round(score, 6) AS score, rank FROM cand", "cand"))
_RECALL = " UNION ALL ".join(f"SELECT '{k}' AS k, avg(CASE WHEN c.rank < {k if k != 'all' else 'rank + 1'} THEN 1.0 ELSE 0.0 END) AS recall FROM truth LEFT JOIN cand c USING (s1_id, cand_id)" for k in (5, 10, 20, 30, "all"))
register("b14_recall_at_k", lambda spark, d: blocking.recall_at_k(fx.candidates(spark, d), fx.truth(spark, d)), o.sql(_RECALL, "truth", "cand"))
register("b15_recall_by_country", lambda spark, d: blocking.recall_by_country(fx.candidates(spark, d), fx.truth(spark, d), fx.normalized(spark, d)), o.sql("SELECT s1.country, avg(CASE WHEN c.cand_id IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM truth JOIN s1 USING (s1_id) LEFT JOIN cand c USING (s1_id, cand_id) GROUP BY ROLLUP (s1.country)", "truth", "s1", "cand"))
register("b15_mean_competitors", lambda spark, d: blocking.mean_competitors(fx.candidates(spark, d)), o.sql("SELECT avg(n) AS mean_competitors FROM (SELECT count(*) AS n FROM cand GROUP BY cand_id)", "cand"))
register("b16_address_terms", lambda spark, d: _address_sides(spark, d)[1].where("addr_n <> ''").select("entity_id", F.array_join("terms", " ").alias("terms")), o.sql("SELECT entity_id, array_to_string(terms, ' ') AS terms FROM addr_terms WHERE source <> 'S1'", "addr_terms"))
register("b17_address_search", lambda spark, d: _address_pairs(spark, d).select("s1_id", "cand_id", r6("score"), "rank"), o.sql("SELECT s1_id, cand_id, round(score, 6) AS score, rank FROM addr_cand", "addr_cand"))


def _validation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1 records of the validation split, its candidates and its truth."""
    val = fx.positions(spark, d).where("pos % 20 = 0").select("s1_id")
    return val, fx.candidates(spark, d).join(val, "s1_id", "left_semi"), fx.truth(spark, d).join(val, "s1_id", "left_semi")


def _union_report(spark: SparkSession, d: str) -> DataFrame:
    val, current, truth = _validation(spark, d)
    n = val.count()
    return blocking.union_report(current, _address_pairs(spark, d), truth, fx.normalized(spark, d), n).select("setting", "pairs", r6("extra_per_s1"), r6("pair_recall"), r6("entity_full_recall"), "recovered", "rec_addr_nonempty", "rec_addr_empty")


_VAL = {
    "val": "SELECT s1_id FROM s1 WHERE pos % 20 = 0",
    "cur": "SELECT c.s1_id, c.cand_id FROM cand c JOIN val USING (s1_id)",
    "tru": "SELECT t.s1_id, t.cand_id FROM truth t JOIN val USING (s1_id)",
}
_SETTINGS = "SELECT 'current' AS setting, s1_id, cand_id FROM cur" + "".join(f" UNION SELECT 'union@{k}', s1_id, cand_id FROM cur UNION SELECT 'union@{k}', s1_id, cand_id FROM addr_cand WHERE rank < {k}" for k in (10, 20))
register(
    "b18_union_report",
    _union_report,
    o.sql(
        """SELECT setting, p.pairs, round((p.pairs - (SELECT count(*) FROM cur)) / (SELECT count(*) FROM val)::DOUBLE, 6) AS extra_per_s1, round(r.pair_recall, 6) AS pair_recall, round(r.entity_full_recall, 6) AS entity_full_recall, r.recovered, r.recovered - r.e AS rec_addr_nonempty, r.e AS rec_addr_empty
        FROM (SELECT setting, count(*) AS pairs FROM sets GROUP BY ALL) p JOIN (
          SELECT setting, sum(h) / sum(n) AS pair_recall, avg(f) AS entity_full_recall, sum(g)::BIGINT AS recovered, sum(ge)::BIGINT AS e FROM (
            SELECT setting, s1_id, sum(hit::INT) AS h, count(*) AS n, min(hit::INT) AS f, sum((hit AND NOT had)::INT) AS g, sum((hit AND NOT had AND empty)::INT) AS ge FROM (
              SELECT x.setting, t.s1_id, t.cand_id, s.cand_id IS NOT NULL AS hit, c.cand_id IS NOT NULL AS had, n.addr_n = '' AS empty
              FROM tru t CROSS JOIN (SELECT DISTINCT setting FROM sets) x LEFT JOIN sets s ON s.setting = x.setting AND s.s1_id = t.s1_id AND s.cand_id = t.cand_id
              LEFT JOIN cur c ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id JOIN norm n ON n.entity_id = t.cand_id) GROUP BY ALL) GROUP BY ALL) r USING (setting)""",
        "s1", "cand", "truth", "norm", "addr_cand", **_VAL, sets=_SETTINGS,
    ),
)
register(
    "s09_new_pairs",
    lambda spark, d: blocking.new_pairs(_address_pairs(spark, d), fx.candidates(spark, d), fx.truth(spark, d)).select("s1_id", "cand_id", "rank", "is_true"),
    o.sql("SELECT a.s1_id, a.cand_id, a.rank, CASE WHEN t.cand_id IS NULL THEN 0 ELSE 1 END AS is_true FROM addr_cand a ANTI JOIN cand USING (s1_id, cand_id) LEFT JOIN truth t ON t.s1_id = a.s1_id AND t.cand_id = a.cand_id", "addr_cand", "cand", "truth"),
)



def _pairs_file(spark: SparkSession, d: str) -> DataFrame:
    """The sink of new pairs: written as TSV and read back."""
    rows, path = QUERIES["s09_new_pairs"](spark, d), scratch(spark, "pairs")
    io.write_tsv(rows, path)
    return io.read_tsv(spark, path, rows.schema)


register("s09_pairs_file", _pairs_file, ORACLES["s09_new_pairs"])

# ---- features (features 1 to 46, W1 to W7, F1 to F6, J2, J9, J12)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = fx.normalized(spark, d)
    return n.where("source = 'S1'"), n.where("source <> 'S1'")


def _context(spark: SparkSession, d: str) -> DataFrame:
    return features.context(fx.candidates(spark, d), *_halves(spark, d))


o.CTES["ctx"] = (
    ("cand", "norm"),
    """SELECT c.s1_id, c.cand_id, c.score, c.rank, a.name_n AS n1, b.name_n AS n2, a.addr_n AS a1, b.addr_n AS a2,
    (a.name_n = b.name_n AND a.name_n <> '')::INT AS name_exact, (starts_with(c.cand_id, 'S3'))::INT AS cand_is_s3
    FROM cand c JOIN norm a ON a.entity_id = c.s1_id JOIN norm b ON b.entity_id = c.cand_id""",
)


def margin_sql(value: str, key: str, source: str, more: str = "") -> str:
    """W6 by the two best rows of each group."""
    v = f"coalesce({value}, -1)"
    return f"""SELECT x.* , CASE WHEN rn = 1 THEN v - second ELSE v - first END AS margin{more} FROM (
        SELECT *, {v} AS v, row_number() OVER w AS rn, first_value({v}) OVER w AS first, nth_value({v}, 2) OVER (PARTITION BY {key} ORDER BY {v} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
        FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {v} DESC)) x"""


register("w01_score_ratio", lambda spark, d: _context(spark, d).select("s1_id", "cand_id", r6("score_ratio_to_top")), o.sql("SELECT s1_id, cand_id, round(score / max(score) OVER (PARTITION BY s1_id), 6) AS score_ratio_to_top FROM ctx", "ctx"))
register("w02_competitors", lambda spark, d: _context(spark, d).select("s1_id", "cand_id", "n_s1_competitors"), o.sql("SELECT s1_id, cand_id, count(*) OVER (PARTITION BY cand_id) AS n_s1_competitors FROM ctx", "ctx"))
# ties at the top are told on rounded scores in both engines
register(
    "w03_best_s1",
    lambda spark, d: features.context(fx.candidates(spark, d).withColumn("score", F.round("score", 6)), *_halves(spark, d)).select("s1_id", "cand_id", "is_best_s1_for_cand"),
    o.sql("SELECT s1_id, cand_id, (round(score, 6) >= max(round(score, 6)) OVER (PARTITION BY cand_id))::INT AS is_best_s1_for_cand FROM ctx", "ctx"),
)
register("w04_rank_from_zero", lambda spark, d: fx.candidates(spark, d).select("s1_id", "cand_id", "rank"), o.sql("SELECT s1_id, cand_id, rank FROM cand", "cand"))
register(
    "w05_rank_min",
    lambda spark, d: _sets(spark, d).select("s1_id", "cand_id", F.rank().over(Window.partitionBy("s1_id").orderBy(F.desc("name_jaccard"))).alias("place")),
    o.sql("SELECT s1_id, cand_id, rank() OVER (PARTITION BY s1_id ORDER BY name_jaccard DESC) AS place FROM sets", "sets") if "sets" in o.CTES else None,
)
register(
    "w06_margin",
    lambda spark, d: features.context(fx.candidates(spark, d).withColumn("score", F.round("score", 6)), *_halves(spark, d)).select("s1_id", "cand_id", r6("score_margin_in_cand")),
    o.sql(f"SELECT s1_id, cand_id, round(margin, 6) AS score_margin_in_cand FROM ({margin_sql('score', 'cand_id', '(SELECT s1_id, cand_id, round(score, 6) AS score FROM ctx)')})", "ctx"),
)
register("w09_first_per_key", lambda spark, d: decide.assign(fx.scored(spark, d), 0.0).select("s1_id", "cand_id"), o.sql("SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS n FROM scored) WHERE n = 1", "scored"))
register(
    "w08_running_sum",
    lambda spark, d: fx.scored(spark, d).select("s1_id", "cand_id", F.round(F.sum("prob").over(Window.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("total")),
    o.sql("SELECT s1_id, cand_id, round(sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM scored", "scored"),
)
register(
    "feat_context",
    lambda spark, d: _context(spark, d).select("s1_id", "cand_id", r6("score"), "rank", "n_s1_competitors", "cand_is_s3", "name_exact", "cand_n_same_name_s1", "s1_n_same_name_cands"),
    o.sql("SELECT s1_id, cand_id, round(score, 6) AS score, rank, count(*) OVER (PARTITION BY cand_id) AS n_s1_competitors, cand_is_s3, name_exact, sum(name_exact) OVER (PARTITION BY cand_id)::BIGINT AS cand_n_same_name_s1, sum(name_exact) OVER (PARTITION BY s1_id)::BIGINT AS s1_n_same_name_cands FROM ctx", "ctx"),
)


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return features.set_features(_context(spark, d))


_RUNS = "regexp_extract_all({}, '[0-9]+')"
o.CTES["ctx2"] = (("ctx",), f"SELECT *, list_distinct({o.split('n1')}) AS nw1, list_distinct({o.split('n2')}) AS nw2, list_distinct({o.split('a1')}) AS aw1, list_distinct({o.split('a2')}) AS aw2, {_RUNS.format('a1')} AS r1, {_RUNS.format('a2')} AS r2 FROM ctx")
o.CTES["sets"] = (
    ("ctx2",),
    f"""SELECT s1_id, cand_id, {o.jaccard('nw1', 'nw2')} AS name_jaccard, (n1 = '')::INT AS name_empty_s1, (n2 = '')::INT AS name_empty_cand, abs(length(n1) - length(n2)) AS name_len_diff,
    {o.jaccard('aw1', 'aw2')} AS addr_jaccard, (a1 = '')::INT AS addr_empty_s1, (a2 = '')::INT AS addr_empty_cand, len(aw1) AS addr_len_s1, len(aw2) AS addr_len_cand,
    {o.jaccard('list_distinct(r1)', 'list_distinct(r2)')} AS num_jaccard, len(list_intersect(list_distinct(r1), r2)) AS num_shared, len(list_distinct(r1)) - len(list_intersect(list_distinct(r1), r2)) AS num_only_s1, len(list_distinct(r2)) - len(list_intersect(list_distinct(r2), r1)) AS num_only_cand,
    CASE WHEN len(r1) = 0 OR len(r2) = 0 THEN -1 ELSE (r1[1] = r2[1])::INT END AS first_num_equal FROM ctx2""",
)
_SETS = ["name_jaccard", "name_empty_s1", "name_empty_cand", "name_len_diff", "addr_jaccard", "addr_empty_s1", "addr_empty_cand", "addr_len_s1", "addr_len_cand", "num_jaccard", "num_shared", "num_only_s1", "num_only_cand", "first_num_equal"]
_ROUNDED = {"name_jaccard", "addr_jaccard", "num_jaccard"}
register("feat_sets", lambda spark, d: _sets(spark, d).select("s1_id", "cand_id", *[r6(c) if c in _ROUNDED else c for c in _SETS]), o.sql("SELECT s1_id, cand_id, " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in _SETS) + " FROM sets", "sets"))
ORACLES["w05_rank_min"] = o.sql("SELECT s1_id, cand_id, rank() OVER (PARTITION BY s1_id ORDER BY round(name_jaccard, 9) DESC) AS place FROM sets", "sets")
register("f05_jaccard", lambda spark, d: _sets(spark, d).select("s1_id", "cand_id", r6("name_jaccard")), o.sql("SELECT s1_id, cand_id, round(name_jaccard, 6) AS name_jaccard FROM sets", "sets"))


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each S1 record's best candidate, with both names: what the SQL of f01 to f04 can hold; *_whole run on all pairs."""
    return _context(spark, d).where("rank = 0").select("s1_id", "cand_id", "s1_name", "cand_name", "s1_addr", "cand_addr")


_RATIO = "CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE round(200.0 * {l} / (length({a}) + length({b})), 6) END"
register("f01_ratio", lambda spark, d: _name_pairs(spark, d).select("s1_id", F.round(similarity.ratio(F.substring("s1_name", 1, 24), F.substring("cand_name", 1, 24)), 6).alias("ratio")), o.sql("SELECT s1_id, " + _RATIO.format(a="a", b="b", l=o.lcs("a", "b")) + " AS ratio FROM (SELECT s1_id, substr(n1, 1, 24) AS a, substr(n2, 1, 24) AS b FROM ctx WHERE rank = 0)", "ctx"))
_TIDY = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
register("f02_token_sort", lambda spark, d: _name_pairs(spark, d).select("s1_id", F.round(similarity.token_sort_ratio(F.substring("s1_name", 1, 24), F.trim(F.substring("cand_name", 1, 24))), 6).alias("ratio")), o.sql("SELECT s1_id, " + _RATIO.format(a="a", b="b", l=o.lcs("a", "b")) + f" AS ratio FROM (SELECT s1_id, {_TIDY.format('trim(substr(n1, 1, 24))')} AS a, {_TIDY.format('trim(substr(n2, 1, 24))')} AS b FROM ctx WHERE rank = 0)", "ctx"))
_REST = "array_to_string(list_sort(list_filter({}, lambda t: NOT list_contains({}, t))), ' ')"
register(
    "f03_token_set",
    lambda spark, d: _name_pairs(spark, d).select("s1_id", F.round(similarity.token_set_ratio(F.col("s1_name"), F.col("cand_name")), 6).alias("ratio")),
    o.sql(
        f"SELECT s1_id, round({o.token_set('nw1', 'nw2')}, 6) AS ratio FROM (SELECT *, (shared > 0)::INT AS g FROM (SELECT s1_id, nw1, nw2, len(list_intersect(nw1, nw2)) AS shared, length(array_to_string(list_intersect(nw1, nw2), ' ')) AS sl, {_REST.format('nw1', 'nw2')} AS p, {_REST.format('nw2', 'nw1')} AS q FROM ctx2 WHERE rank = 0))",
        "ctx2",
    ),
)
# windows of the longer string by their start, from before its first character on; both orders for equal lengths
_WINDOWS = f"SELECT s1_id, max(CASE WHEN length(x) + length(y) = 0 THEN 100.0 WHEN length(x) = 0 THEN 0.0 ELSE 200.0 * {o.lcs('x', 'y')} / (length(x) + length(y)) END) AS best FROM (SELECT s1_id, x, substr(y, greatest(i, 0) + 1, length(x) + least(i, 0)) AS y FROM (SELECT s1_id, x, y, unnest(range(1 - length(x), greatest(length(y), 1))) AS i FROM sides)) GROUP BY s1_id"
register(
    "f04_partial",
    lambda spark, d: _name_pairs(spark, d).select("s1_id", F.round(similarity.partial_ratio(F.substring("s1_name", 1, 9), F.substring("cand_name", 1, 14)), 6).alias("ratio")),
    o.sql(f"SELECT s1_id, round(best, 6) AS ratio FROM ({_WINDOWS})", "ctx", sides="SELECT s1_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM (SELECT s1_id, substr(n1, 1, 9) AS a, substr(n2, 1, 14) AS b FROM ctx WHERE rank = 0) UNION ALL SELECT s1_id, b, a FROM (SELECT s1_id, substr(n1, 1, 9) AS a, substr(n2, 1, 14) AS b FROM ctx WHERE rank = 0) WHERE length(a) = length(b)"),
)


# whole names of all candidate pairs; LCS in SQL is too slow for them, so tests hold these against the plain definitions
def _whole(name: str, f) -> None:
    register(name, lambda spark, d, f=f: _context(spark, d).select("s1_id", "cand_id", F.round(f(F.col("s1_name"), F.col("cand_name")), 6).alias("ratio")))


_whole("f01_ratio_whole", similarity.ratio)
_whole("f02_token_sort_whole", similarity.token_sort_ratio)
_whole("f03_token_set_whole", similarity.token_set_ratio)
_whole("f04_partial_whole", similarity.partial_ratio)
_POSTAL = "list_filter(r, lambda x: length(x) IN (5, 6))[-1]"
register(
    "f06_postal_house",
    lambda spark, d: fx.normalized(spark, d).select("entity_id", similarity.postal(similarity.digit_runs(F.col("addr_n"))).alias("postal"), similarity.house(similarity.digit_runs(F.col("addr_n"))).alias("house")),
    o.sql(f"SELECT entity_id, postal, substr(list_filter(r, lambda x: postal IS NULL OR x <> postal)[1], 1, 15)::BIGINT AS house FROM (SELECT entity_id, r, {_POSTAL} AS postal FROM (SELECT entity_id, {_RUNS.format('addr_n')} AS r FROM norm))", "norm"),
)
register(
    "feat_vocabulary_share",
    lambda spark, d: features.vocabulary_share(*reversed(_halves(spark, d))).select("cand_id", r6("cand_name_vocab_frac")),
    o.sql(f"SELECT w.entity_id AS cand_id, round(avg(CASE WHEN v.t IS NULL THEN 0.0 ELSE 1.0 END), 6) AS cand_name_vocab_frac FROM (SELECT entity_id, unnest({o.split('name_n')}) AS t FROM norm WHERE source <> 'S1') w LEFT JOIN (SELECT DISTINCT t FROM (SELECT unnest({o.split('name_n')}) AS t FROM norm WHERE source = 'S1')) v USING (t) WHERE length(w.t) >= 2 GROUP BY ALL", "norm"),
)
register(
    "w07_siblings",
    lambda spark, d: features.siblings(_context(spark, d)).select("s1_id", "cand_id", "sib_id", r6("sib_score")),
    o.sql("SELECT s1_id, cand_id, CASE WHEN rank = 0 THEN id2 ELSE id1 END AS sib_id, round(CASE WHEN rank = 0 THEN s2 ELSE s1 END, 6) AS sib_score FROM (SELECT *, max(CASE WHEN rank = 0 THEN cand_id END) OVER w AS id1, max(CASE WHEN rank = 1 THEN cand_id END) OVER w AS id2, max(CASE WHEN rank = 0 THEN score END) OVER w AS s1, max(CASE WHEN rank = 1 THEN score END) OVER w AS s2 FROM cand WINDOW w AS (PARTITION BY s1_id))", "cand"),
)
register("feat_all", lambda spark, d: fx.featured(spark, d))
# what the neighbourhood columns of the whole feature table give without string ratios
_BEST = "row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id)"
register(
    "feat_neighbours",
    lambda spark, d: fx.featured(spark, d).select("s1_id", "cand_id", "n_cands_of_s1", r6("sib_score")),
    o.sql(f"SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id) AS n_cands_of_s1, round(CASE WHEN place = 1 THEN max(score) FILTER (place = 2) OVER (PARTITION BY s1_id) ELSE max(score) FILTER (place = 1) OVER (PARTITION BY s1_id) END, 6) AS sib_score FROM (SELECT s1_id, cand_id, score, {_BEST} AS place FROM cand)", "cand"),
)
_OF_RECORDS = f"SELECT entity_id, {_POSTAL} AS postal, r FROM (SELECT entity_id, {_RUNS.format('addr_n')} AS r FROM norm)"
register(
    "feat_conflicts",
    lambda spark, d: fx.featured(spark, d).select("s1_id", "cand_id", "n_cands_of_s1", "postal_conflict", "house_first_equal"),
    o.sql(
        "SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id) AS n_cands_of_s1, (a.postal <> b.postal)::INT AS postal_conflict, (a.house = b.house)::INT AS house_first_equal FROM cand JOIN hs a ON a.entity_id = s1_id JOIN hs b ON b.entity_id = cand_id",
        "cand", "norm", hs=f"SELECT entity_id, postal, substr(list_filter(r, lambda x: postal IS NULL OR x <> postal)[1], 1, 15)::BIGINT AS house FROM ({_OF_RECORDS})",
    ),
)

# ---- joins (J)


def _cand(spark: SparkSession, d: str) -> DataFrame:
    return fx.candidates(spark, d).select("s1_id", "cand_id", "rank")


def _of(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.select(F.col("entity_id").alias(key), *columns)


register("j01_shared_terms", lambda spark, d: blocking.scored_pairs(*_terms(spark, d)).select("s1_id", "cand_id"), o.sql("SELECT s1_id, cand_id FROM m_score", "m_score"))
register("j02_pair_attributes", lambda spark, d: _cand(spark, d).join(_of(fx.normalized(spark, d), "s1_id", F.col("name_n").alias("n1")), "s1_id").join(_of(fx.normalized(spark, d), "cand_id", F.col("name_n").alias("n2")), "cand_id").select("s1_id", "cand_id", "n1", "n2"), o.sql("SELECT s1_id, cand_id, n1, n2 FROM ctx", "ctx"))
register("j03_positions", lambda spark, d: fx.truth(spark, d).join(fx.positions(spark, d), "s1_id"), o.sql("SELECT s1_id, cand_id, pos FROM truth JOIN s1 USING (s1_id)", "truth", "s1"))
register("j04_labels", lambda spark, d: _cand(spark, d).join(fx.truth(spark, d).distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left").select("s1_id", "cand_id", F.coalesce("t", F.lit(0)).alias("label")), o.sql("SELECT s1_id, cand_id, (t.s IS NOT NULL)::INT AS label FROM cand LEFT JOIN (SELECT s1_id, cand_id, s1_id AS s FROM truth) t USING (s1_id, cand_id)", "cand", "truth"))
register("j05_missed_truths", lambda spark, d: fx.truth(spark, d).join(_cand(spark, d), ["s1_id", "cand_id"], "left_anti"), o.sql("SELECT s1_id, cand_id FROM truth ANTI JOIN cand USING (s1_id, cand_id)", "truth", "cand"))
register("j06_new_pairs", lambda spark, d: _address_pairs(spark, d).join(_cand(spark, d), ["s1_id", "cand_id"], "left_anti").select("s1_id", "cand_id"), o.sql("SELECT s1_id, cand_id FROM addr_cand ANTI JOIN cand USING (s1_id, cand_id)", "addr_cand", "cand"))
register("j07_left_default", lambda spark, d: fx.positions(spark, d).select("s1_id").join(decide.assign(fx.scored(spark, d)), "s1_id", "left").select("s1_id", F.coalesce("cand_id", F.lit("")).alias("cand_id")), o.sql("SELECT s1_id, coalesce(cand_id, '') AS cand_id FROM s1 LEFT JOIN assigned USING (s1_id)", "s1", "assigned"))
register("j08_counts_with_zero", lambda spark, d: fx.positions(spark, d).select("s1_id").join(fx.truth(spark, d).groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").na.fill(0), o.sql("SELECT s1_id, coalesce(n, 0) AS n FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY ALL) USING (s1_id)", "s1", "truth"))
register("j09_known_words", lambda spark, d: features.name_vocabulary(_halves(spark, d)[0]), o.sql(f"SELECT DISTINCT word FROM (SELECT unnest({o.split('name_n')}) AS word FROM norm WHERE source = 'S1') WHERE length(word) >= 2", "norm"))
register("j10_owner", lambda spark, d: _halves(spark, d)[1].select(F.col("entity_id").alias("cand_id")).join(fx.truth(spark, d), "cand_id", "left").select("cand_id", F.col("s1_id").alias("owner")), o.sql("SELECT r.entity_id AS cand_id, t.s1_id AS owner FROM records r LEFT JOIN truth t ON t.cand_id = r.entity_id WHERE r.source <> 'S1'", "records", "truth"))
register("j11_display", lambda spark, d: fx.truth(spark, d).join(_of(fx.records(spark, d), "s1_id", F.col("business_name").alias("name1")), "s1_id").join(_of(fx.records(spark, d), "cand_id", F.col("business_name").alias("name2")), "cand_id").select("s1_id", "cand_id", "name1", "name2"), o.sql("SELECT s1_id, cand_id, a.business_name AS name1, b.business_name AS name2 FROM truth JOIN records a ON a.entity_id = s1_id JOIN records b ON b.entity_id = cand_id", "truth", "records"))
register("j13_unmatched", lambda spark, d: fx.records(spark, d).where("source <> 'S1'").select("source", F.col("entity_id").alias("cand_id")).join(fx.truth(spark, d).select("cand_id").distinct().withColumn("m", F.lit(1.0)), "cand_id", "left").groupBy("source").agg(F.round(1 - F.avg(F.coalesce("m", F.lit(0.0))), 6).alias("unmatched")), o.sql("SELECT source, round(1 - avg(CASE WHEN t.cand_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS unmatched FROM records r LEFT JOIN truth t ON t.cand_id = r.entity_id WHERE source <> 'S1' GROUP BY ALL", "records", "truth"))

# ---- aggregates (A), projections, filters, sorts, sets (P, O, U)

register("a01_group_count", lambda spark, d: table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
register("a02_repeated_groups", lambda spark, d: fx.truth(spark, d).groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")), o.sql("SELECT count(*) AS n FROM (SELECT s1_id FROM truth GROUP BY ALL HAVING count(*) > 1)", "truth"))
register("a03_singletons", lambda spark, d: fx.positions(spark, d).select("s1_id").join(fx.truth(spark, d).groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").agg(F.round(F.avg(F.col("n").isNull().cast("double")), 6).alias("share")), o.sql("SELECT round(avg((n IS NULL)::INT), 6) AS share FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY ALL) USING (s1_id)", "s1", "truth"))
register("a04_count_distinct", lambda spark, d: table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n")), "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL")
register("a05_max", lambda spark, d: table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("best")), "SELECT l_suppkey, max(l_extendedprice) AS best FROM lineitem GROUP BY ALL")
register("a06_second_max", lambda spark, d: table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice")))).where("n <= 2").groupBy("l_suppkey").agg(F.max(F.when(F.col("n") == 2, F.col("l_extendedprice"))).alias("second")), "SELECT l_suppkey, max(p) FILTER (n = 2) AS second FROM (SELECT l_suppkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS n FROM lineitem) GROUP BY ALL")
register("a07_count_if", lambda spark, d: table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count_if(F.col("l_returnflag") == "R").alias("n")), "SELECT l_shipdate, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY ALL")
register("a08_mean", lambda spark, d: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 3).alias("mean")), "SELECT o_orderstatus, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY ALL")
register("a09_all", lambda spark, d: table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("every")), "SELECT l_orderkey, bool_and(l_quantity > 5) AS every FROM lineitem GROUP BY ALL")
register("a10_collect_set", lambda spark, d: fx.truth(spark, d).groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias("ids")), o.sql("SELECT s1_id, string_agg(DISTINCT cand_id, ',' ORDER BY cand_id) AS ids FROM truth GROUP BY ALL", "truth"))
register("a11_ordered_list", lambda spark, d: fx.candidates(spark, d).groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]), ",").alias("ids")), o.sql("SELECT s1_id, string_agg(cand_id, ',' ORDER BY rank) AS ids FROM cand GROUP BY ALL", "cand"))
register("a12_quantiles", lambda spark, d: table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.round(F.percentile("o_totalprice", F.lit(q)), 4).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.9)]), "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.9)) + " FROM orders GROUP BY ALL")
_NUMBERS = "SELECT regexp_replace(s1_id, '[^0-9]', '', 'g')::BIGINT % 1000 AS x, regexp_replace(cand_id, '[^0-9]', '', 'g')::BIGINT % 1000 AS y FROM cand"
register("a13_spearman", lambda spark, d: metrics.rank_correlation(_cand(spark, d).select(*[(F.regexp_replace(c, r"\D", "").cast("long") % 1000).alias(k) for c, k in (("s1_id", "x"), ("cand_id", "y"))]), "x", "y").select(r6("rho")), o.sql("SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM numbers)", "cand", numbers=_NUMBERS))
register("a14_product", lambda spark, d: fx.scored(spark, d).groupBy("s1_id").agg(F.round(F.exp(F.sum(F.ln(1 - F.least("prob", F.lit(0.999999))))), 6).alias("none")), o.sql("SELECT s1_id, round(product(1 - least(prob, 0.999999)), 6) AS none FROM scored GROUP BY ALL", "scored"))
register("a15_global_mean", lambda spark, d: table(spark, d, "orders").agg(F.round(F.avg("o_totalprice"), 3).alias("mean")), "SELECT round(avg(o_totalprice), 3) AS mean FROM orders")
register("a16_distinct", lambda spark, d: table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
register("a17_same_names", lambda spark, d: _context(spark, d).where("name_exact = 1").select("s1_id", "cand_id"), o.sql("SELECT s1_id, cand_id FROM ctx WHERE name_exact = 1", "ctx"))
register("p01_projection", lambda spark, d: table(spark, d, "customer").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
register("p02_country_split", lambda spark, d: fx.records(spark, d).where("country = 'en'").select("entity_id"), o.sql("SELECT entity_id FROM records WHERE country = 'en'", "records"))
register("p03_position_range", lambda spark, d: fx.positions(spark, d).where("pos >= 100 and pos < 400").select("s1_id"), o.sql("SELECT s1_id FROM s1 WHERE pos >= 100 AND pos < 400", "s1"))
register("p04_threshold", lambda spark, d: fx.scored(spark, d).where("prob >= 0.7").select("s1_id", "cand_id"), o.sql("SELECT s1_id, cand_id FROM scored WHERE prob >= 0.7", "scored"))
register("p05_floor_then_power", lambda spark, d: fx.scored(spark, d).where("prob >= 0.05").select("s1_id", "cand_id", F.round(F.pow("prob", F.lit(1.15)), 6).alias("p")), o.sql("SELECT s1_id, cand_id, round(pow(prob, 1.15), 6) AS p FROM scored WHERE prob >= 0.05", "scored"))
register("p06_modulo_split", lambda spark, d: fx.positions(spark, d).where("pos % 20 < 3").select("s1_id", (F.col("pos") % 20 == 0).alias("is_val")), o.sql("SELECT s1_id, pos % 20 = 0 AS is_val FROM s1 WHERE pos % 20 < 3", "s1"))
register("p07_prefix", lambda spark, d: fx.records(spark, d).select("entity_id", F.substring("entity_id", 1, 2).alias("prefix"), F.col("entity_id").startswith("S3").alias("is_s3")), o.sql("SELECT entity_id, substr(entity_id, 1, 2) AS prefix, starts_with(entity_id, 'S3') AS is_s3 FROM records", "records"))
register("p08_digits", lambda spark, d: fx.records(spark, d).select("entity_id", F.regexp_replace("entity_id", r"\D", "").cast("long").alias("n")), o.sql(r"SELECT entity_id, regexp_replace(entity_id, '[^0-9]', '', 'g')::BIGINT AS n FROM records", "records"))
register("p09_clip_power", lambda spark, d: fx.scored(spark, d).select("s1_id", "cand_id", F.round(F.least(F.greatest(F.pow("prob", F.lit(1.3)), F.lit(1e-6)), F.lit(1 - 1e-6)), 6).alias("p")), o.sql("SELECT s1_id, cand_id, round(least(greatest(pow(prob, 1.3), 1e-6), 1 - 1e-6), 6) AS p FROM scored", "scored"))
register("p10_empty_flags", lambda spark, d: fx.normalized(spark, d).select("entity_id", (F.trim("addr_n") == "").alias("empty")), o.sql("SELECT entity_id, trim(addr_n) = '' AS empty FROM norm", "norm"))
register("o01_sort", lambda spark, d: fx.candidates(spark, d).orderBy("s1_id", "rank").select("s1_id", "cand_id", "rank"), o.sql("SELECT s1_id, cand_id, rank FROM cand ORDER BY s1_id, rank", "cand"))
register("o03_head", lambda spark, d: table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
register(
    "o04_sample",
    lambda spark, d: fx.truth(spark, d).orderBy(F.md5(F.concat_ws("|", "s1_id", "cand_id", F.lit("0"))), "s1_id", "cand_id").limit(25),
    o.sql("SELECT s1_id, cand_id FROM truth ORDER BY md5(s1_id || '|' || cand_id || '|0'), s1_id, cand_id LIMIT 25", "truth"),
)
register("u01_union_all", lambda spark, d: fx.records(spark, d).where("source = 'S2'").select("entity_id").unionByName(fx.records(spark, d).where("source = 'S3'").select("entity_id")), o.sql("SELECT entity_id FROM records WHERE source = 'S2' UNION ALL SELECT entity_id FROM records WHERE source = 'S3'", "records"))
register("u02_union_distinct", lambda spark, d: _cand(spark, d).select("s1_id", "cand_id").union(_address_pairs(spark, d).select("s1_id", "cand_id")).distinct(), o.sql("SELECT s1_id, cand_id FROM cand UNION SELECT s1_id, cand_id FROM addr_cand", "cand", "addr_cand"))
register("u03_difference", lambda spark, d: decide.assign(fx.scored(spark, d)).select("s1_id", "cand_id").exceptAll(fx.truth(spark, d)), o.sql("SELECT s1_id, cand_id FROM assigned EXCEPT SELECT s1_id, cand_id FROM truth", "assigned", "truth"))
register("u04_intersection", lambda spark, d: decide.assign(fx.scored(spark, d)).select("s1_id", "cand_id").intersect(fx.truth(spark, d)), o.sql("SELECT s1_id, cand_id FROM assigned INTERSECT SELECT s1_id, cand_id FROM truth", "assigned", "truth"))

# ---- decisions and metrics (E)


def _s1(spark: SparkSession, d: str) -> DataFrame:
    return fx.positions(spark, d).select("s1_id")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    scored = fx.scored(spark, d)
    return metrics.pair_outcomes(scored, decide.assign(scored), fx.truth(spark, d))


register("e01_assign", lambda spark, d: decide.assign(fx.scored(spark, d)).select("s1_id", "cand_id", "prob"), o.sql("SELECT s1_id, cand_id, prob FROM assigned", "assigned"))
register(
    "e02_best_subset",
    lambda spark, d: fx.scored(spark, d).groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(-F.col("prob"))), lambda x: -x).alias("p")).select("s1_id", decide.best_size(F.col("p")).alias("k")),
    o.sql(f"SELECT s1_id, count(d.cand_id)::INT AS k FROM (SELECT DISTINCT s1_id FROM scored) LEFT JOIN ({o.decoded('plain')}) d USING (s1_id) GROUP BY ALL", "scored", plain="SELECT s1_id, cand_id, prob, prob AS p FROM scored"),
)
_RAISED = "least(greatest(pow(prob, {g}), 1e-6), 1 - 1e-6)"
_PLAYED = "SELECT s1_id, cand_id, prob, " + _RAISED.format(g=decide.GAMMA) + f" AS p FROM assigned02 WHERE prob >= {decide.FLOOR}"
_DECODED = o.decoded("played")
register("e03_decode", lambda spark, d: decide.decode(decide.assign(fx.scored(spark, d), decide.ASSIGN_FLOOR), decide.GAMMA, decide.FLOOR), o.sql(_DECODED, "assigned02", played=_PLAYED))
register("e04_macro_f05", lambda spark, d: metrics.macro_f05(_s1(spark, d), decide.assign(fx.scored(spark, d)), fx.truth(spark, d)).select(r6("score")), o.sql("SELECT round(avg(score), 6) AS score FROM ent", "ent"))
register("e05_entity_scores", lambda spark, d: metrics.entity_scores(_s1(spark, d), decide.assign(fx.scored(spark, d)), fx.truth(spark, d)).select("s1_id", "n_true", "n_pred", "tp", r6("score")), o.sql("SELECT s1_id, n_true, n_pred, tp, round(score, 6) AS score FROM ent", "ent"))
_GRID = " UNION ALL ".join(f"SELECT {g}::DOUBLE AS gamma, {f}::DOUBLE AS floor" for g in metrics.GAMMAS for f in metrics.FLOORS)
_SWEPT = o.sql(
    f"""SELECT gamma, floor, round(avg(score), 6) AS score FROM (
      SELECT g.gamma, g.floor, s1.s1_id, {o.f05('coalesce(p.tp, 0)', 'coalesce(p.n, 0)', 'coalesce(t.n, 0)')} AS score FROM grid g CROSS JOIN s1
      LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY ALL) t USING (s1_id)
      LEFT JOIN (SELECT a.gamma, a.floor, a.s1_id, count(*) AS n, count(t.cand_id) AS tp FROM dec a LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY ALL) p ON p.gamma = g.gamma AND p.floor = g.floor AND p.s1_id = s1.s1_id) GROUP BY ALL""",
    "assigned02", "s1", "truth", grid=_GRID, played="SELECT gamma, floor, s1_id, cand_id, prob, " + _RAISED.format(g="gamma") + " AS p FROM assigned02 CROSS JOIN grid WHERE prob >= floor", dec=o.decoded("played", "gamma, floor, s1_id"),
)
register("e06_calibration_sweep", lambda spark, d: metrics.calibration_sweep(_s1(spark, d), decide.assign(fx.scored(spark, d), decide.ASSIGN_FLOOR), fx.truth(spark, d)).select("gamma", "floor", r6("score")), _SWEPT)
_AT = " UNION ALL ".join(
    f"SELECT {t} AS threshold, round(avg(score), 6) AS score, round(avg((n_pred = 0)::INT), 6) AS empty FROM (SELECT s1.s1_id, coalesce(p.n, 0) AS n_pred, {o.f05('coalesce(p.tp, 0)', 'coalesce(p.n, 0)', 'coalesce(t.n, 0)')} AS score FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY ALL) t USING (s1_id) LEFT JOIN (SELECT a.s1_id, count(*) AS n, count(t.cand_id) AS tp FROM best a LEFT JOIN truth t USING (s1_id, cand_id) WHERE prob >= {t} GROUP BY ALL) p USING (s1_id))"
    for t in metrics.THRESHOLDS
)
register("e07_threshold_sweep", lambda spark, d: metrics.threshold_sweep(_s1(spark, d), fx.scored(spark, d), fx.truth(spark, d)).select("threshold", r6("score"), r6("empty")), o.sql(_AT.replace("SELECT 0.5 AS", "SELECT 0.5::DOUBLE AS"), "s1", "truth", "scored", best="SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS n FROM scored WHERE prob >= 0.5) WHERE n = 1"))
register("e08_pair_outcomes", _outcomes, o.sql("SELECT s1_id, cand_id, outcome, owner, taken, prob FROM outcomes", "outcomes"))
_SCORES = ["score", "ceiling", "no_fp", "no_fn"]
register("e08_entity_errors", lambda spark, d: metrics.error_scores(fx.positions(spark, d).join(_of(fx.records(spark, d), "s1_id", "country"), "s1_id").select("s1_id", "country"), _outcomes(spark, d)).select("s1_id", "country", "tp", "fp", "fn", "miss", "fp_stolen", "n_true", *map(r6, _SCORES)), o.sql("SELECT s1_id, country, tp, fp, fn, miss, fp_stolen, n_true, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES) + " FROM err_scores", "err_scores"))
_MEANS = [*_SCORES, "lost_fp", "lost_fn", "lost_blocking", "singletons", "singleton_score", "other_score"]
register(
    "e08_error_summary",
    lambda spark, d: metrics.error_summary(metrics.error_scores(fx.positions(spark, d).join(_of(fx.records(spark, d), "s1_id", "country"), "s1_id").select("s1_id", "country"), _outcomes(spark, d))).select("country", *map(r6, _MEANS), "n_fp", "n_fp_stolen", "n_fn", "n_miss"),
    o.sql("SELECT country, round(avg(score), 6) AS score, round(avg(ceiling), 6) AS ceiling, round(avg(no_fp), 6) AS no_fp, round(avg(no_fn), 6) AS no_fn, round(avg(no_fp) - avg(score), 6) AS lost_fp, round(avg(no_fn) - avg(score), 6) AS lost_fn, round(1 - avg(ceiling), 6) AS lost_blocking, round(avg((n_true = 0)::INT), 6) AS singletons, round(avg(score) FILTER (n_true = 0), 6) AS singleton_score, round(avg(score) FILTER (n_true <> 0), 6) AS other_score, sum(fp)::BIGINT AS n_fp, sum(fp_stolen)::BIGINT AS n_fp_stolen, sum(fn)::BIGINT AS n_fn, sum(miss)::BIGINT AS n_miss FROM err_scores GROUP BY ROLLUP (country)", "err_scores"),
)
_QS = (0.1, 0.25, 0.5, 0.75, 0.9)
register("e08_quantiles", lambda spark, d: metrics.outcome_quantiles(_outcomes(spark, d)).select("outcome", *[r6(f"q{int(q * 100)}") for q in _QS], "n_taken", "n"), o.sql("SELECT outcome, " + ", ".join(f"round(quantile_cont(prob, {q}), 6) AS q{int(q * 100)}" for q in _QS) + ", count(*) FILTER (taken) AS n_taken, count(*) AS n FROM outcomes WHERE outcome IN ('fp', 'fn') GROUP BY ALL", "outcomes"))
register("e09_empty_addresses", lambda spark, d: metrics.empty_address_shares(_outcomes(spark, d), _halves(spark, d)[1]).select("kind", r6("share"), r6("median_prob")), o.sql("SELECT kind, round(avg(empty::INT), 6) AS share, round(quantile_cont(prob, 0.5) FILTER (empty), 6) AS median_prob FROM (SELECT outcome AS kind, addr_n = '' AS empty, prob FROM outcomes JOIN norm ON entity_id = cand_id WHERE outcome <> 'tp' UNION ALL SELECT 'predicted', addr_n = '', prob FROM outcomes JOIN norm ON entity_id = cand_id WHERE outcome IN ('tp', 'fp') UNION ALL SELECT 'all', addr_n = '', NULL FROM norm WHERE source <> 'S1') GROUP BY ALL", "outcomes", "norm"))
register("e09_stolen_same_name", lambda spark, d: metrics.stolen_same_name(_outcomes(spark, d), _halves(spark, d)[0]).select(r6("share")), o.sql("SELECT round(avg((a.name_n = b.name_n)::INT), 6) AS share FROM outcomes JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = owner WHERE outcome = 'fp'", "outcomes", "norm"))
register(
    "e10_error_examples",
    lambda spark, d: metrics.error_examples(_outcomes(spark, d), *_halves(spark, d)),
    o.sql(
        "SELECT e.*, a.block_text AS s1_text, b.block_text AS cand_text FROM (SELECT s1_id, cand_id, outcome, owner, taken, prob, row_number() OVER (PARTITION BY outcome ORDER BY md5(s1_id || '|' || cand_id || '|0'), s1_id, cand_id) AS n FROM outcomes WHERE outcome <> 'tp') e JOIN norm a ON a.entity_id = e.s1_id JOIN norm b ON b.entity_id = e.cand_id WHERE n <= 10",
        "outcomes",
        "norm",
    ),
)
register("e11_countries", lambda spark, d: fx.records(spark, d).groupBy("source", "country").agg(F.count("*").alias("n")), o.sql("SELECT source, country, count(*) AS n FROM records GROUP BY ALL", "records"))
register("e11_match_histogram", lambda spark, d: _s1(spark, d).join(fx.truth(spark, d).groupBy("s1_id").agg(F.count("*").alias("k")), "s1_id", "left").na.fill(0).groupBy("k").agg(F.count("*").alias("n")), o.sql("SELECT coalesce(k, 0) AS k, count(*) AS n FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS k FROM truth GROUP BY ALL) USING (s1_id) GROUP BY ALL", "s1", "truth"))
register("e11_source_mix", lambda spark, d: fx.truth(spark, d).groupBy(F.substring("cand_id", 1, 2).alias("source")).agg(F.count("*").alias("n")), o.sql("SELECT substr(cand_id, 1, 2) AS source, count(*) AS n FROM truth GROUP BY ALL", "truth"))


def _redecode(spark: SparkSession, d: str) -> DataFrame:
    saved = io.checkpoint(fx.scored(spark, d).select("s1_id", "cand_id", "prob"), scratch(spark, "scored"))
    found = decide.decode(decide.assign(saved, decide.ASSIGN_FLOOR), decide.GAMMA, decide.FLOOR)
    return io.match_lists(fx.records(spark, d).where("source = 'S1'"), found, [F.col("place")])


register("e12_redecode", _redecode, o.sql(f"SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY place), '') AS matched_entity_ids FROM s1 LEFT JOIN ({_DECODED}) USING (s1_id) GROUP BY ALL", "s1", "assigned02", played=_PLAYED))

# ---- model (M)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """A stage: training reads its rows several times."""
    return fx.stage(spark, d, "labelled", lambda keep: model.labelled(fx.featured(spark, d), fx.truth(spark, d), fx.positions(spark, d)))


register("m06_labelled", lambda spark, d: _labelled(spark, d).select("s1_id", "cand_id", "is_val", F.col("label").cast("int").alias("label")), o.sql("SELECT s1_id, cand_id, pos % 20 = 0 AS is_val, (t.s IS NOT NULL)::INT AS label FROM cand JOIN s1 USING (s1_id) LEFT JOIN (SELECT s1_id, cand_id, s1_id AS s FROM truth) t USING (s1_id, cand_id) WHERE pos % 20 < 3", "cand", "s1", "truth"))


#: The reference's limit of rounds; the validation rows stop the boosting before.
ROUNDS = 1000


def _trained(spark: SparkSession, d: str):
    """The model of all S1 records: those of the validation stop the boosting, all others train it."""
    rows = fx.stage(spark, d, "labelled_all", lambda keep: model.labelled(fx.featured(spark, d), fx.truth(spark, d), fx.positions(spark, d), sample=model.MODULUS))
    return model.train(rows, rounds=ROUNDS)


register("m01_train_and_score", lambda spark, d: model.score(_trained(spark, d), fx.featured(spark, d)))
register("m05_importances", lambda spark, d: spark.createDataFrame(model.importances(_trained(spark, d)), "feature string, gain double"))


def _reloaded(spark: SparkSession, d: str) -> DataFrame:
    """Whether a saved and loaded model gives each pair the score that the model gave; a few rounds are enough for that."""
    before, path = model.train(_labelled(spark, d), rounds=3), scratch(spark, "model")
    model.save(before, path)
    pairs = fx.featured(spark, d)
    after = model.score(model.load(path), pairs).withColumnRenamed("prob", "loaded")
    return model.score(before, pairs).join(after, ["s1_id", "cand_id"]).select("s1_id", "cand_id", (F.col("prob") == F.col("loaded")).alias("same"))


register("s11_model_reload", _reloaded, o.sql("SELECT s1_id, cand_id, TRUE AS same FROM cand", "cand"))
