import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.plans import catalog
from kinfold.plans import fixtures as fx


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def slow_ratio(a, b):
    return 100.0 if not a and not b else 200.0 * slow_lcs(a, b) / (len(a) + len(b))


def slow_partial(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for x, y in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        for i in range(-len(x) + 1, len(y)):
            best = max(best, slow_ratio(x, y[max(0, i) : i + len(x)]))
    return best


WORDS = st.text(alphabet="abc é", max_size=90)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=6))
def test_kernels_match_the_plain_definitions(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert list(sim.lcs(a, b)) == [slow_lcs(x, y) for x, y in pairs]
    assert all(math.isclose(p, slow_ratio(x, y)) for p, (x, y) in zip(sim.ratios(a, b), pairs))
    assert all(math.isclose(p, slow_partial(x, y)) for p, (x, y) in zip(sim.partial_ratios(a, b), pairs))
    assert all(math.isclose(p, q) for p, q in zip(sim.ratios(a, b), sim.ratios(b, a)))
    assert all(math.isclose(p, q) for p, q in zip(sim.token_set_ratios(a, b), sim.token_set_ratios(b, a)))


def test_windows_cut_short_cost_one_scan_at_either_end(monkeypatch):
    """Only windows within the longer string are rows of their own; before, cut ones were too."""
    rows, scan = [], sim.Masks._states
    monkeypatch.setattr(sim.Masks, "_states", lambda self, pair, places: rows.append(len(pair)) or scan(self, pair, places))
    x, y = "no 12 mg road west end 560001", "12 mg rd near west end park 560001"
    assert math.isclose(sim.partial_ratios([x], [y])[0], slow_partial(x, y))
    assert rows == [len(y) - len(x) + 1, 1, 1]


def test_known_values():
    assert math.isclose(sim.ratios(["sharma traders"], ["sharma trading"])[0], 100 * 22 / 28)
    assert list(sim.token_set_ratios(["a b", "", "a b c", "fuzzy was a bear"], ["b a x", "a", "a", "fuzzy fuzzy was a bear"])) == [100.0, 0.0, 100.0, 100.0]
    assert list(sim.token_sort_ratios(["b a"], ["a b"])) == [100.0]
    assert list(sim.partial_ratios(["road"], ["mg road west"])) == [100.0]


def test_long_strings_need_several_words():
    r = random.Random(3)
    a = ["".join(r.choice("abcd ") for _ in range(r.randint(60, 200))) for _ in range(20)]
    b = ["".join(r.choice("abcd ") for _ in range(r.randint(60, 200))) for _ in range(20)]
    assert list(sim.lcs(a, b)) == [slow_lcs(x, y) for x, y in zip(a, b)]


def test_sets_and_numbers(spark):
    df = spark.createDataFrame([("12 main 400601",), ("400601 9 400601",), ("",), ("7 9",)], "a string")
    runs = sim.digit_runs(F.col("a"))
    rows = df.select(sim.postal(runs).alias("p"), sim.house(runs).alias("h")).collect()
    assert [(r.p, r.h) for r in rows] == [("400601", 12), ("400601", 9), (None, None), (None, 7)]
    sets = spark.createDataFrame([([], ["a"]), (["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert [r.j for r in sets.select(sim.jaccard(F.col("x"), F.col("y")).alias("j")).collect()] == [-1.0, 1 / 3]


def slow_token_sort(a, b):
    return slow_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def slow_token_set(a, b):
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    shared, one, two = (sorted(x) for x in (s & t, s - t, t - s))
    if shared and (not one or not two):
        return 100.0
    base, one, two = " ".join(shared), " ".join(shared + one), " ".join(shared + two)
    return max(slow_ratio(one, two), *([slow_ratio(base, one), slow_ratio(base, two)] if shared else [0.0]))


WHOLE = {"f01_ratio_whole": slow_ratio, "f02_token_sort_whole": slow_token_sort, "f03_token_set_whole": slow_token_set, "f04_partial_whole": slow_partial}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_ratio_queries_take_whole_names_of_all_pairs(spark, name):
    sf = "/root/testdata/sf0.001"
    names = {r.entity_id: r.name_n for r in fx.normalized(spark, sf).collect()}
    pairs = [(r.s1_id, r.cand_id) for r in fx.candidates(spark, sf).collect()]
    got = {(r.s1_id, r.cand_id): r.ratio for r in catalog.QUERIES[name](spark, sf).collect()}
    assert len(pairs) == len(got) and max(len(names[c]) for _, c in pairs) > 24
    assert all(math.isclose(got[s, c], WHOLE[name](names[s], names[c]), abs_tol=1e-6) for s, c in pairs)
