"""Top lists by cells against all pairs, summed one by one."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from kinfold.operators import blocking, cells

RECORD = "entity_id string, country string, terms array<string>"


def sides(spark, n=60, seed=3):
    """Records of two countries with few words, so that many scores tie; one country has no S1 records."""
    pick = random.Random(seed)
    rows = [(f"S{1 if i % 3 == 0 else 2}_{i}", pick.choice(["en", "fr"]), [pick.choice("abcdefgh") for _ in range(pick.randint(0, 4))]) for i in range(n)]
    rows += [(f"S2_x{i}", "de", ["a", "b"]) for i in range(3)] + [("S2_y", None, ["a"]), ("S1_y", None, ["a"])]
    return tuple(spark.createDataFrame([r for r in rows if (r[0][:2] == "S1") == first], RECORD) for first in (True, False))


def brute(pairs, k, key, other):
    """{key: its k best others in order} of (s1_id, cand_id, score)."""
    found = collections.defaultdict(list)
    for r in pairs:
        found[r[key]].append((-math.floor(r["score"] * 1e9 + 0.5), r[other]))
    return {x: [y for _, y in sorted(ys)[:k]] for x, ys in found.items()}


def listed(df, key, other):
    found = collections.defaultdict(dict)
    for r in df.collect():
        found[r[key]][r["rank"]] = r[other]
    return {x: [ys[i] for i in range(len(ys))] for x, ys in found.items()}


@pytest.mark.parametrize("blocks", [(32768, 65536), (3, 5)])
def test_lists_are_those_of_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(blocking, "S1_BLOCK", blocks[0])
    monkeypatch.setattr(blocking, "INDEX_BLOCK", blocks[1])
    s1, index = sides(spark)
    pairs = blocking.scored_pairs(s1, index).collect()
    assert listed(blocking.forward_top_k(s1, index, 4), "s1_id", "cand_id") == brute(pairs, 4, "s1_id", "cand_id")
    assert listed(blocking.reverse_top_k(s1, index, 2), "cand_id", "s1_id") == brute(pairs, 2, "cand_id", "s1_id")
    forward = {(x, y) for x, ys in brute(pairs, 4, "s1_id", "cand_id").items() for y in ys}
    backward = {(y, x) for x, ys in brute(pairs, 2, "cand_id", "s1_id").items() for y in ys}
    got = {(r.s1_id, r.cand_id): r.score for r in blocking.block(s1, index, 4, 2).collect()}
    assert set(got) == forward | backward
    scores = {(r.s1_id, r.cand_id): r.score for r in pairs}
    assert all(math.isclose(v, scores[x], rel_tol=1e-12) for x, v in got.items())


def test_pairs_are_not_shuffled(spark):
    """Lists are short and come from cells; before, products of all pairs were joined and summed by a shuffle."""
    for found in (blocking.block(*sides(spark)), blocking.forward_top_k(*sides(spark)), blocking.address_search(*sides(spark), 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "wa#" not in plan


def test_cell_in_small_batches(monkeypatch):
    monkeypatch.setattr(cells, "HITS", 7)
    pick = np.random.default_rng(5)
    rows, scores = [], collections.defaultdict(float)
    for _ in range(30):
        a, b = (sorted(pick.choice(12, pick.integers(1, 6), replace=False).tolist()) for _ in range(2))
        u, v = pick.random(len(a)) / 30, pick.random(len(b))
        rows.append({"s1_ids": [f"S1_{x:02d}" for x in a], "s1_ws": u.tolist(), "cand_ids": [f"S2_{x:02d}" for x in b], "cand_ws": v.tolist()})
        for x, p in zip(a, u):
            for y, q in zip(b, v):
                scores[f"S1_{x:02d}", f"S2_{y:02d}"] += p * q
    pairs = [{"s1_id": x, "cand_id": y, "score": s} for (x, y), s in scores.items()]
    found = cells.best(3, 2)(pa.Table.from_pylist(rows)).to_pylist()
    for way, k, key, other in ((0, 3, "s1_id", "cand_id"), (1, 2, "cand_id", "s1_id")):
        want = {(x, y) for x, ys in brute(pairs, k, key, other).items() for y in ys}
        assert {(r[key], r[other]) for r in found if r["way"] == way} == want
    assert all(math.isclose(r["score"], scores[r["s1_id"], r["cand_id"]], rel_tol=1e-12) for r in found)


def test_empty_cell():
    assert cells.best(3, 2)(pa.table({"s1_ids": pa.array([], pa.list_(pa.string())), "s1_ws": pa.array([], pa.list_(pa.float64())), "cand_ids": pa.array([], pa.list_(pa.string())), "cand_ws": pa.array([], pa.list_(pa.float64()))})).num_rows == 0
