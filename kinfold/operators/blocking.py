"""Candidate search: TF-IDF postings, similarity by an equi-join on terms, top lists in both directions.

Records have entity_id, country and terms (an array). The similarity of a pair is summed once and serves both
directions. Names and addresses don't move with the postings; they are joined to surviving pairs later. Top lists come
from blocks of S1 records against blocks of the index (cells.py), so the pairs themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.operators import cells

#: Stores a table under a label and gives it back, so that the shuffles that made it can go.
Keep = Callable[[DataFrame, str], DataFrame]


def as_it_is(df: DataFrame, label: str) -> DataFrame:
    """Stores nothing."""
    return df


#: Defaults of the search.
K, REVERSE_K, MAX_DF = 20, 3, 2000
RECALL_AT = (5, 10, 20, 30)
#: S1 rows of a term that are joined in one task.
SHARE = 8192
#: S1 and index records of a cell: what one task compares at a time.
S1_BLOCK, INDEX_BLOCK = 32768, 65536


def term_counts(records: DataFrame) -> DataFrame:
    """B2: (country, entity_id, term, tf). Records are dealt out before their terms are counted, as they are fewer than postings."""
    dealt = records.select("country", "entity_id", "terms").repartition("country", "entity_id")
    return dealt.select("country", "entity_id", F.explode("terms").alias("term")).groupBy("country", "entity_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(index: DataFrame, index_counts: DataFrame, max_df: int | None = MAX_DF, fallback: bool = True) -> DataFrame:
    """(country, term, df, idf) of the index side.

    Terms in more than min(max_df, records of the country) records are left out; where that leaves a country none, all
    of its terms stay (fallback).
    """
    sizes = index.groupBy("country").agg(F.count("*").alias("n"))
    terms = index_counts.groupBy("country", "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "country")
    if max_df is not None:
        few = F.col("df") <= F.least(F.lit(max_df), F.col("n"))
        if fallback:
            kept = terms.groupBy("country").agg(F.count_if(few).alias("kept"))
            terms = terms.join(F.broadcast(kept), "country").where(few | (F.col("kept") == 0))
        else:
            terms = terms.where(few)
    return terms.select("country", "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    """Smooth inverse document frequency."""
    return F.ln((1 + n) / (1 + df)) + 1


def weights(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(country, entity_id, term, w): (1 + ln tf) * idf, each record scaled to length 1 over known terms."""
    raw = counts.join(terms.select("country", "term", "idf"), ["country", "term"]).select("country", "entity_id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("country", "entity_id")))
    return raw.select("country", "entity_id", "term", (F.col("raw") / norm).alias("w"))


def similarities(s1_weights: DataFrame, index_weights: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score) of all pairs in a country with a term in common.

    max_df bounds the index rows of a term. Terms that are frequent on the S1 side are dealt into shares of about SHARE
    rows, each with the term's index rows. A few postings make many pairs, so the join's partitions are not left to be
    made few by the size of its input.
    """
    a = s1_weights.select("country", "term", F.col("entity_id").alias("s1_id"), F.col("w").alias("wa"))
    b = index_weights.select("country", "term", F.col("entity_id").alias("cand_id"), F.col("w").alias("wb"))
    shares = a.groupBy("country", "term").agg(F.ceil(F.count("*") / F.lit(SHARE)).cast("int").alias("shares"))
    a = a.join(shares, ["country", "term"]).withColumn("share", F.pmod(F.xxhash64("s1_id"), F.col("shares")).cast("int")).drop("shares")
    b = b.join(shares, ["country", "term"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    parts, on = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["country", "term", "share"]
    pairs = a.repartition(parts, *on).join(b.repartition(parts, *on), on)
    return pairs.groupBy("s1_id", "cand_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def _best(key: str, other: str) -> Window:
    """Rank by the score to nine places (as whole numbers), so that summing order can't change it; ties by id."""
    return Window.partitionBy(key).orderBy(_rounded(), other)


def _rounded() -> Column:
    return F.floor(F.col("score") * 1e9 + 0.5).desc()


def _limited(pairs: DataFrame, k: int, key: str, other: str) -> DataFrame:
    """The k best pairs of each key with their place from 1; the limit holds before the shuffle by key, too."""
    return pairs.withColumn("place", F.row_number().over(_best(key, other))).where(F.col("place") <= k)


def top_k(pairs: DataFrame, k: int, key: str = "s1_id", other: str = "cand_id") -> DataFrame:
    """The k best pairs of each key with their rank from 0."""
    return _limited(pairs, k, key, other).withColumn("rank", F.col("place") - 1).drop("place")


def both_ways(pairs: DataFrame, k: int = K, reverse_k: int = REVERSE_K) -> DataFrame:
    """Pairs among the k best of their S1 record or the reverse_k best of their candidate, ranked again."""
    kept = _limited(pairs, k, "s1_id", "cand_id").drop("place")
    if reverse_k > 0:
        # both lists are short, and the similarities below them are summed once (a reused exchange)
        kept = kept.unionByName(_limited(pairs, reverse_k, "cand_id", "s1_id").drop("place")).groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"))
    return kept.select("s1_id", "cand_id", "score", (F.row_number().over(_best("s1_id", "cand_id")) - 1).alias("rank"))


def scored_pairs(s1: DataFrame, index: DataFrame, max_df: int | None = MAX_DF, fallback: bool = True) -> DataFrame:
    """B2 to B7 on records with terms; countries that one side lacks give nothing, as nothing joins there."""
    counts = term_counts(index)
    terms = vocabulary(index, counts, max_df, fallback)
    return similarities(weights(term_counts(s1), terms), weights(counts, terms))


def _packed(weighted: DataFrame, records: DataFrame, block: str, size: int, prefix: str) -> DataFrame:
    """Postings by term and block of records, each with its ids and their weights; a country has as many blocks as hold size records."""
    n = records.groupBy("country").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"))
    dealt = weighted.join(F.broadcast(n), "country").withColumn(block, F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"))
    held = dealt.groupBy("country", "term", block).agg(F.collect_list(F.struct("entity_id", "w")).alias("x"))
    return held.select("country", "term", block, F.col("x.entity_id").alias(f"{prefix}_ids"), F.col("x.w").alias(f"{prefix}_ws"))


def best_pairs(s1: DataFrame, index: DataFrame, k: int = K, reverse_k: int = REVERSE_K, max_df: int | None = MAX_DF, fallback: bool = True, keep: Keep = as_it_is) -> DataFrame:
    """B7 to B10 in one: (way, s1_id, cand_id, score, place): the k best pairs of each S1 record (way 0) and the reverse_k best of each candidate (way 1).

    A country's S1 records and index are dealt into blocks. A cell is a block of each: it gets the postings of the terms
    that both have, sums all its pairs and gives the best of either direction, of which the best over all cells are
    taken. So what is shuffled are postings, once for each block of the other side with that term, and short lists.
    With keep, the vocabulary, the postings of either side and the cells' lists are stored on the way.
    """
    counts = term_counts(index)
    terms = keep(vocabulary(index, counts, max_df, fallback), "vocabulary")
    a = keep(_packed(weights(term_counts(s1), terms), s1, "s1_block", S1_BLOCK, "s1"), "s1_postings")
    b = keep(_packed(weights(counts, terms), index, "index_block", INDEX_BLOCK, "cand"), "index_postings")
    cell = a.join(b, ["country", "term"]).drop("term").groupBy("country", "s1_block", "index_block")
    found = keep(cell.applyInArrow(cells.best(k, reverse_k), cells.SCHEMA), "lists")
    forward = F.col("way") == 0
    key, other = F.when(forward, F.col("s1_id")).otherwise(F.col("cand_id")), F.when(forward, F.col("cand_id")).otherwise(F.col("s1_id"))
    lists = found.select("*", key.alias("__key"), other.alias("__other"))
    place = F.row_number().over(Window.partitionBy("way", "__key").orderBy(_rounded(), "__other"))
    return lists.withColumn("place", place).where(F.col("place") <= F.when(forward, F.lit(k)).otherwise(F.lit(reverse_k))).drop("__key", "__other")


def forward_top_k(s1: DataFrame, index: DataFrame, k: int = K, max_df: int | None = MAX_DF, fallback: bool = True, keep: Keep = as_it_is) -> DataFrame:
    """The k best candidates of each S1 record with their rank from 0."""
    return best_pairs(s1, index, k, 0, max_df, fallback, keep).select("s1_id", "cand_id", "score", (F.col("place") - 1).alias("rank"))


def reverse_top_k(s1: DataFrame, index: DataFrame, k: int = REVERSE_K, max_df: int | None = MAX_DF) -> DataFrame:
    """The k best S1 records of each candidate with their rank from 0."""
    return best_pairs(s1, index, 0, k, max_df).select("s1_id", "cand_id", "score", (F.col("place") - 1).alias("rank"))


def block(s1: DataFrame, index: DataFrame, k: int = K, reverse_k: int = REVERSE_K, max_df: int = MAX_DF, keep: Keep = as_it_is) -> DataFrame:
    """Candidates (s1_id, cand_id, score, rank) of all countries, without a loop over them: both lists, ranked again."""
    kept = best_pairs(s1, index, k, reverse_k, max_df, keep=keep)
    if reverse_k > 0:
        kept = kept.groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"))
    return kept.select("s1_id", "cand_id", "score", (F.row_number().over(_best("s1_id", "cand_id")) - 1).alias("rank"))


def recall_at_k(candidates: DataFrame, truth: DataFrame, ks=RECALL_AT) -> DataFrame:
    """(k, recall): share of true pairs with a rank below k, and among all candidates (k = "all")."""
    found = truth.join(candidates.select("s1_id", "cand_id", "rank"), ["s1_id", "cand_id"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    one = found.agg(*[share(F.col("rank") < k).alias(f"k{k}") for k in ks], share(F.col("rank").isNotNull()).alias("kall"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.col(f"k{k}").alias("recall")) for k in [*ks, "all"]])).alias("x")).select("x.*")


def recall_by_country(candidates: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, recall), with a row for all countries together (country null)."""
    found = truth.join(candidates.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left").join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return found.rollup("country").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def mean_competitors(candidates: DataFrame) -> DataFrame:
    """Mean number of S1 records per candidate."""
    return candidates.groupBy("cand_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_competitors"))


def address_search(s1: DataFrame, index: DataFrame, k: int, max_df: int = MAX_DF, keep: Keep = as_it_is) -> DataFrame:
    """Forward search by addresses alone; terms are address terms, records without an address are left out."""
    some = lambda df: df.where(F.size("terms") > 0)
    return forward_top_k(some(s1), some(index), k, max_df, fallback=False, keep=keep)


def union_report(current: DataFrame, address: DataFrame, truth: DataFrame, index: DataFrame, n_s1: int, ks=(10, 20)) -> DataFrame:
    """Per setting (current, union@k): pairs, extra per S1, recall of pairs and of whole entities, recovered pairs by empty address."""
    empty = index.select(F.col("entity_id").alias("cand_id"), (F.col("addr_n") == "").alias("empty"))
    settings = [("current", current.select("s1_id", "cand_id"))] + [(f"union@{k}", current.select("s1_id", "cand_id").union(address.where(F.col("rank") < k).select("s1_id", "cand_id")).distinct()) for k in ks]
    tagged = None
    for name, pairs in settings:
        rows = pairs.withColumn("setting", F.lit(name))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    sizes = tagged.groupBy("setting").agg(F.count("*").alias("pairs"))
    names = truth.sparkSession.createDataFrame([(name,) for name, _ in settings], "setting string")
    hits = tagged.join(truth, ["s1_id", "cand_id"]).withColumn("hit", F.lit(True))
    base = truth.join(current.select("s1_id", "cand_id", F.lit(True).alias("had")), ["s1_id", "cand_id"], "left").join(empty, "cand_id")
    each = base.crossJoin(F.broadcast(names)).join(hits.select("setting", "s1_id", "cand_id", "hit"), ["setting", "s1_id", "cand_id"], "left").select("setting", "s1_id", "empty", F.coalesce("had", F.lit(False)).alias("had"), F.coalesce("hit", F.lit(False)).alias("hit"))
    new = F.col("hit") & ~F.col("had")
    per_s1 = each.groupBy("setting", "s1_id").agg(F.bool_and("hit").cast("double").alias("full"), F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"), F.count_if(new).alias("got"), F.count_if(new & F.col("empty")).alias("got_empty"))
    out = per_s1.groupBy("setting").agg((F.sum("hits") / F.sum("n")).alias("pair_recall"), F.avg("full").alias("entity_full_recall"), F.sum("got").alias("recovered"), (F.sum("got") - F.sum("got_empty")).alias("rec_addr_nonempty"), F.sum("got_empty").alias("rec_addr_empty"))
    now = sizes.where("setting = 'current'").select(F.col("pairs").alias("base"))
    return sizes.crossJoin(F.broadcast(now)).join(out, "setting").select("setting", "pairs", ((F.col("pairs") - F.col("base")) / F.lit(n_s1)).alias("extra_per_s1"), "pair_recall", "entity_full_recall", "recovered", "rec_addr_nonempty", "rec_addr_empty")


def new_pairs(address: DataFrame, current: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of the address search that the current one lacks, and whether they are true."""
    fresh = address.join(current.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    return fresh.join(truth.select("s1_id", "cand_id", F.lit(1).alias("is_true")), ["s1_id", "cand_id"], "left").na.fill(0, ["is_true"])
