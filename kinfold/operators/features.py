"""The 46 features of candidate pairs.

Context features and margins are windows over the full candidate set: filters on pairs come after them. Values of a
record (postal code, house number, share of known name words) are computed once per record, before the pair joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions import similarity as sim
from kinfold.functions.text import words_of
from kinfold.operators.blocking import Keep, as_it_is

# The names and the order of the model's columns.
CONTEXT = ["score", "rank", "score_ratio_to_top", "n_s1_competitors", "is_best_s1_for_cand", "cand_is_s3", "name_exact", "cand_n_same_name_s1", "s1_n_same_name_cands"]
STRINGS = [
    "name_ratio", "name_token_sort", "name_token_set", "name_partial", "name_nospace",
    "name_jaccard", "name_empty_s1", "name_empty_cand", "name_len_diff",
    "addr_ratio", "addr_token_set", "addr_partial", "addr_jaccard",
    "addr_empty_s1", "addr_empty_cand", "addr_len_s1", "addr_len_cand",
    "num_jaccard", "num_shared", "num_only_s1", "num_only_cand", "first_num_equal",
]
RANKED = ["name_token_set", "addr_token_set", "name_ratio"]
NEIGHBOURS = ["score_margin_in_cand", *[f"{c}_{k}_in_s1" for c in RANKED for k in ("rank", "margin")], "n_cands_of_s1", "postal_conflict", "house_first_equal", "cand_name_vocab_frac", "sib_name_sim", "sib_addr_sim", "sib_best_sim", "sib_score"]
#: Model columns in order: the base set, and all of them.
BASE = [*CONTEXT, *STRINGS]
ALL = [*BASE, *NEIGHBOURS]


def margin(value: Column, key: str) -> Column:
    """A value minus the best of the other rows with its key; 0 for a tie at the top, null when alone; null counts as -1."""
    v = F.coalesce(value, F.lit(-1.0))
    w = Window.partitionBy(key)
    # the two largest values of the group, as a pair that only keeps two
    best = F.max(v).over(w)
    ties = F.sum((v == best).cast("int")).over(w)
    second = F.max(F.when(v < best, v)).over(w)
    return F.when(v < best, v - best).when(ties >= 2, F.lit(0.0)).otherwise(v - second)


def _margins(df: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    """W6 for several columns (result name -> value column) over one partitioning."""
    w = Window.partitionBy(key)
    names = {out: f"__best_{out}" for out in columns}
    value = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    df = df.withColumns({names[out]: F.max(value(c)).over(w) for out, c in columns.items()})
    df = df.withColumns({f"__ties_{out}": F.sum((value(c) == F.col(names[out])).cast("int")).over(w) for out, c in columns.items()} | {f"__next_{out}": F.max(F.when(value(c) < F.col(names[out]), value(c))).over(w) for out, c in columns.items()})
    df = df.withColumns({out: F.when(value(c) < F.col(names[out]), value(c) - F.col(names[out])).when(F.col(f"__ties_{out}") >= 2, F.lit(0.0)).otherwise(value(c) - F.col(f"__next_{out}")) for out, c in columns.items()})
    return df.drop(*[f"__{k}_{out}" for out in columns for k in ("best", "ties", "next")])


def side(records: DataFrame, prefix: str) -> DataFrame:
    """Columns of one side of a pair: prefix_id, and name, address and per-record values."""
    runs = sim.digit_runs(F.col("addr_n"))
    return records.select(F.col("entity_id").alias(f"{prefix}_id"), F.col("name_n").alias(f"{prefix}_name"), F.col("addr_n").alias(f"{prefix}_addr"), sim.postal(runs).cast("long").alias(f"{prefix}_postal"), sim.house(runs).alias(f"{prefix}_house"))


def context(candidates: DataFrame, s1: DataFrame, index: DataFrame) -> DataFrame:
    """Features 1 to 9 and 32 on the full candidate set; keeps names and addresses of both sides."""
    pairs = candidates.join(side(s1, "s1"), "s1_id").join(side(index, "cand"), "cand_id")
    by_s1, by_cand = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    pairs = pairs.withColumn("name_exact", ((F.col("s1_name") == F.col("cand_name")) & (F.col("s1_name") != "")).cast("int")).withColumn("cand_is_s3", F.col("cand_id").startswith("S3").cast("int"))
    pairs = pairs.withColumns({"n_s1_competitors": F.count("*").over(by_cand), "is_best_s1_for_cand": (F.col("score") >= F.max("score").over(by_cand)).cast("int"), "cand_n_same_name_s1": F.sum("name_exact").over(by_cand)})
    pairs = _margins(pairs, {"score_margin_in_cand": "score"}, "cand_id")
    return pairs.withColumns({"score_ratio_to_top": F.col("score") / F.max("score").over(by_s1), "s1_n_same_name_cands": F.sum("name_exact").over(by_s1)})


def set_features(pairs: DataFrame) -> DataFrame:
    """Features 15 to 18 and 22 to 31: sets of words and numbers, all in the JVM."""
    n1, n2, a1, a2 = (F.col(c) for c in ("s1_name", "cand_name", "s1_addr", "cand_addr"))
    w1, w2 = sim.distinct_words(a1), sim.distinct_words(a2)
    d1, d2 = F.array_distinct(sim.digit_runs(a1)), F.array_distinct(sim.digit_runs(a2))
    f1, f2 = F.get(sim.digit_runs(a1), F.lit(0)), F.get(sim.digit_runs(a2), F.lit(0))
    return pairs.withColumns(
        {
            "name_jaccard": sim.jaccard(sim.distinct_words(n1), sim.distinct_words(n2)),
            "name_empty_s1": (n1 == "").cast("int"),
            "name_empty_cand": (n2 == "").cast("int"),
            "name_len_diff": F.abs(F.length(n1) - F.length(n2)),
            "addr_jaccard": sim.jaccard(w1, w2),
            "addr_empty_s1": (a1 == "").cast("int"),
            "addr_empty_cand": (a2 == "").cast("int"),
            "addr_len_s1": F.size(w1),
            "addr_len_cand": F.size(w2),
            "num_jaccard": sim.jaccard(d1, d2),
            "num_shared": F.size(F.array_intersect(d1, d2)),
            "num_only_s1": F.size(F.array_except(d1, d2)),
            "num_only_cand": F.size(F.array_except(d2, d1)),
            "first_num_equal": F.when(f1.isNull() | f2.isNull(), F.lit(-1)).otherwise((f1 == f2).cast("int")),
        }
    )


def string_features(pairs: DataFrame) -> DataFrame:
    """Features 10 to 31."""
    held = pairs.withColumn("__k", sim.pair_kernels(F.col("s1_name"), F.col("s1_addr"), F.col("cand_name"), F.col("cand_addr")))
    names = [x.split(":")[0] for x in sim.KERNELS[7:-1].split(",")]
    return set_features(held.withColumns({c: F.col("__k")[c] for c in names}).drop("__k"))


def name_vocabulary(s1: DataFrame) -> DataFrame:
    """Distinct words of two letters or more in S1 names, over all countries."""
    return s1.select(F.explode(words_of(F.col("name_n"))).alias("word")).where(F.length("word") >= 2).distinct()


def vocabulary_share(index: DataFrame, s1: DataFrame) -> DataFrame:
    """J9, feature 42 per record: (cand_id, cand_name_vocab_frac); null for names without such words.

    The vocabulary grows with the data, so it is joined by the word and not shipped whole.
    """
    words = index.select(F.col("entity_id").alias("cand_id"), F.explode(words_of(F.col("name_n"))).alias("word")).where(F.length("word") >= 2)
    known = words.join(name_vocabulary(s1).withColumn("known", F.lit(1.0)), "word", "left")
    return known.groupBy("cand_id").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("cand_name_vocab_frac"))


def siblings(pairs: DataFrame) -> DataFrame:
    """Adds sib_id, sib_name, sib_addr and sib_score: the S1's best candidate, or for it the second best."""
    order = Window.partitionBy("s1_id").orderBy(F.round("score", 9).desc(), "cand_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("cand_id", "cand_name", "cand_addr", "score")
    # the first two rows of the window carry all that a sibling is asked for
    held = pairs.withColumn("__1", F.first(row).over(whole)).withColumn("__2", F.nth_value(row, 2).over(whole))
    sib = F.when(F.col("cand_id") == F.col("__1.cand_id"), F.col("__2")).otherwise(F.col("__1"))
    return held.withColumn("__s", sib).withColumns({"sib_id": F.col("__s.cand_id"), "sib_name": F.col("__s.cand_name"), "sib_addr": F.col("__s.cand_addr"), "sib_score": F.col("__s.score")}).drop("__1", "__2", "__s")


def _known_similarity(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != "") & (F.col(b) != "")
    return F.when(both, sim.token_set_ratio(F.col(a), F.col(b)) / 100)


def neighbour_features(pairs: DataFrame) -> DataFrame:
    """Features 33 to 46 but for 42, on string features; all candidates of an S1 record must be there."""
    by_s1 = Window.partitionBy("s1_id")
    pairs = _margins(pairs, {f"{c}_margin_in_s1": c for c in RANKED}, "s1_id")
    pairs = pairs.withColumns({f"{c}_rank_in_s1": F.rank().over(by_s1.orderBy(F.desc(c))) for c in RANKED})
    pairs = pairs.withColumn("n_cands_of_s1", F.count("*").over(by_s1))
    pairs = siblings(pairs)
    both = lambda k: F.col(f"s1_{k}").isNotNull() & F.col(f"cand_{k}").isNotNull()
    pairs = pairs.withColumns({"postal_conflict": F.when(both("postal"), (F.col("s1_postal") != F.col("cand_postal")).cast("int")), "house_first_equal": F.when(both("house"), (F.col("s1_house") == F.col("cand_house")).cast("int"))})
    pairs = pairs.withColumns({"sib_name_sim": _known_similarity("cand_name", "sib_name"), "sib_addr_sim": _known_similarity("cand_addr", "sib_addr")})
    return pairs.withColumn("sib_best_sim", F.greatest("sib_name_sim", "sib_addr_sim"))


def make_features(candidates: DataFrame, s1: DataFrame, index: DataFrame, keep: Keep = as_it_is) -> DataFrame:
    """All 46 features of all pairs: s1_id, cand_id and the columns of ALL in order.

    What is told per record joins narrow pairs, so that wide ones are shuffled once by either side. With keep, the
    candidates with the shares of known words are stored on the way.
    """
    known = keep(candidates.join(vocabulary_share(index, s1), "cand_id", "left"), "known")
    full = neighbour_features(string_features(context(known, s1, index)))
    return full.select("s1_id", "cand_id", *ALL)
