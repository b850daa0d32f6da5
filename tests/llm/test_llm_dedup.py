"""Suffix-array, MinHash and embedding dedup against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from kinfold.llm import components, cover_tree, minhash, suffix_dedup


def corpus(n=120, seed=3):
    """Documents with copies, near copies, common lines at many places, short and odd texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(400)]
    line = " ".join(r.choice(words) for _ in range(14)) + "."
    docs = []
    for i in range(n):
        kind = r.random()
        text = [r.choice(words) for _ in range(r.randint(1, 120))]
        if kind < 0.2 and docs:
            docs.append(r.choice(docs))
            continue
        if kind < 0.5 and docs:
            text = (r.choice(docs) or "x").split(" ")
            for _ in range(r.randint(1, 3)):
                text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.3:
            text.insert(r.randrange(len(text) + 1), "\n" + line + "\n")
        docs.append(" ".join(text))
    return docs + [None, "", " ", "é" * 60, "é" * 60, "a" * 500, "a" * 400, "Word", "word", "x y z", line, None]


def table(spark, docs, shuffle=True):
    rows = [(i * 3 + 1, t) for i, t in enumerate(docs)]
    if shuffle:
        random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return df.selectExpr("*", "text as mark", "doc_id as doc", "1 as n", "2 as unit", "3 as cluster", "4 as bucket")


def union(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- components


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 1000 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- suffix arrays


def brute_spans(docs):
    first, out = {}, {}
    for i, text in docs:
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                mark[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(raw, mark) if not m)
        out[i] = (len(raw), sum(mark), sum(1 for k in range(len(raw)) if mark[k] and (k == 0 or not mark[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_is_exact(spark):
    for seed in (3, 4):
        docs = corpus(seed=seed)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digest(table(spark, docs)).collect()}
        assert got == brute_spans([(i * 3 + 1, t) for i, t in enumerate(docs)])


def test_long_texts_are_cut_with_an_overlap(spark, monkeypatch):
    r = random.Random(9)
    long = "".join(r.choice("abcdef ") for _ in range(700_000))
    docs = [long, "intro " + long[300_000:300_500] + " outro " + long[262_100:262_200]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digest(table(spark, docs)).collect()}
    assert got == brute_spans([(i * 3 + 1, t) for i, t in enumerate(docs)])


def test_frequent_grams_only_move_work(spark, monkeypatch):
    docs = corpus(seed=6)
    monkeypatch.setattr(suffix_dedup, "frequent_grams", lambda source, buckets, total: np.unique(suffix_dedup.gram_hashes(np.frombuffer(docs[-2].encode(), np.uint8), np.zeros(0, np.uint64), None)))
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.dedup_digest(table(spark, docs)).collect()}
    assert got == {k: v[3] for k, v in brute_spans([(i * 3 + 1, t) for i, t in enumerate(docs)]).items()}


def test_index_family_keeps_the_least_owner():
    r = np.random.default_rng(0)
    family, seen = suffix_dedup.IndexFamily(), []
    for _ in range(12):
        who, key = r.integers(0, 40, 200), r.integers(0, 150, 200).astype("S50")
        family.add(key, who, np.arange(len(seen), len(seen) + 200))
        seen += list(zip(key.tolist(), who.tolist()))
    least = {}
    for k, w in seen:
        least[k] = min(w, least.get(k, w))
    gone = set(np.concatenate([p for _, p in family.gone]).tolist())
    assert gone == {i for i, (k, w) in enumerate(seen) if w > least[k]}
    assert len(family.levels) <= 8


def test_suffix_dedup_on_edges(spark):
    a, b = "one two three four five six seven eight nine ten " * 3, "other " + "one two three four five six seven eight nine ten " * 2
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, a), (None, a), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_digest(df).collect())
    assert got == sorted([("1", len(a), 0), ("1", len(a), 0), ("1", len(b), 0), ("None", len(a), len(a)), ("None", len(a), len(a)), ("2", 0, 0)])
    assert suffix_dedup.dedup_digest(df.limit(0)).collect() == []
    cut = suffix_dedup.deduplicated(spark.createDataFrame([(1, a, "x"), (2, "né " + a, "y"), (3, None, "z")], "doc_id long, text string, spans string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.spans) for r in cut] == [(1, a, "x"), (2, "né", "y"), (3, None, "z")]  # the space before a repeats too


# ---- MinHash


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates_are_exact(spark):
    for seed in (3, 5):
        docs = corpus(n=250, seed=seed)
        sets = {i * 3 + 1: shingles(t) for i, t in enumerate(docs)}
        links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        want = union(sets, links)
        got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, docs)).collect()}
        assert len(links) > 50 and {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_units_over_several_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for _ in range(60):
        text = list(base)
        for _ in range(r.randint(0, 9)):
            text[r.randrange(300)] = f"x{r.random()}"
        docs.append(" ".join(text))
    sets = {i * 3 + 1: shingles(t) for i, t in enumerate(docs)}
    want = union(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, docs)).collect()} == want
    assert 1 < len(set(want.values())) < 60


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.85, 1.0):
        a = r.integers(0, 2**63, 4000, dtype=np.uint64)
        b = r.integers(0, 2**63, 4000, dtype=np.uint64)
        same = int(4000 * 2 * share / (1 + share))
        b[:same] = a[:same]
        m = minhash.minima([np.unique(a), np.unique(b)])
        p = minhash.pack(m)
        assert abs(minhash.estimate(p[:1], p[1:])[0] - share) < 0.17
    assert minhash.least_estimate(0.85) < 0.7


def test_near_duplicates_on_edges(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, ""), (4, "A B C D E F G"), (5, "a b"), (6, "A\tb"), (7, "x " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([("1", 3, "1", True), ("1", 3, "1", True), ("None", 3, "None", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 3, "1", False), ("5", 1, "5", True), ("6", 1, "5", False), ("7", 1, "7", True)])
    assert minhash.near_duplicates(df.limit(0)).collect() == []


# ---- embeddings


def vectors(seed=0, n=400, dim=16):
    r = np.random.default_rng(seed)
    out = [r.standard_normal(dim) for _ in range(n // 2)]
    for _ in range(n // 2):
        out.append(out[r.integers(0, 20)] * r.uniform(0.5, 2) + r.standard_normal(dim) * r.choice([0.0, 0.05, 0.1, 0.3]))
    return [x.astype(np.float32).tolist() for x in out]


def test_near_vectors_are_exact(spark):
    for seed, block in ((0, 4096), (1, 40)):
        rows = vectors(seed)
        u = np.array(rows, np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        ids = [i * 2 + 5 for i in range(len(rows))]
        want = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
        df = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<float>").selectExpr("*", "1 as unit", "2 as rep", "3 as k").repartition(5)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(df, block=block).collect()}
        assert got == {i: (int(near[k].sum()) - 1, want[i], want[i] == i) for k, i in enumerate(ids)}


def test_tree_levels_are_nested():
    u = cover_tree.unit_rows(np.array(vectors(3), np.float64))
    order, marks = cover_tree.Tree.order(u)
    tree = cover_tree.Tree.read(u[order], marks)
    assert sorted(order.tolist()) == list(range(len(u)))
    for level in range(1, cover_tree.LEVELS):
        assert set(tree.starts[level - 1].tolist()) <= set(tree.starts[level].tolist())
        assert (tree.radii[level] <= 2.0 ** (1 - level) + 1e-3).all()


def test_unstructured_vectors_leave_few_pairs_to_compare():
    """Only close pairs are left by the bounds, whatever components hold the length, and none of them is lost."""
    r = np.random.default_rng(5)
    for scale in (np.ones(64), np.r_[np.full(40, 1e-3), np.ones(24)], np.r_[np.ones(24), np.zeros(40)]):
        rows = r.normal(size=(6001, 64)) * scale
        rows[700:710] = rows[:10] + 0.01 * r.normal(size=(10, 64)) * scale
        rows[1400:1450] = rows[20] + 0.04 * r.normal(size=(50, 64)) * scale
        sides = []
        for part in np.split(rows[r.permutation(6001)], [3100]):
            u = cover_tree.unit_rows(part)
            order, marks = cover_tree.Tree.order(u)
            sides.append(cover_tree.Tree.read(u[order], marks))
        for a, b in ((sides[0], sides[1]), (sides[0], sides[0])):
            links = cover_tree.Links(a, b, np.ones(len(a.u), int), np.ones(len(b.u), int), a is b, 0.95)
            compared, decide = [], links.decide
            links.decide = lambda x, y, level: compared.append(len(x)) or decide(x, y, level)
            links.walk()
            near = a.u @ b.u.T >= 0.95
            want = near.sum(axis=1) - 1 if a is b else np.r_[near.sum(axis=1), near.sum(axis=0)]
            assert links.result()[0].tolist() == want.tolist()
            if scale.min() == 1:
                assert compared[0] < len(a.u) + len(b.u)


def test_clustered_vectors_leave_few_pairs_of_blocks(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(24, 32))
    # one cluster holds a third of all vectors, so its cell is split again and again
    rows = centres[np.where(r.random(3000) < 0.33, 0, r.integers(0, 24, 3000))] + 0.12 * r.normal(size=(3000, 32))
    u = cover_tree.unit_rows(rows)
    near = u @ u.T >= 0.999
    classes = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(rows)], "rep long, weight long, v array<double>")
    dealt, pairs, _ = cover_tree._upper(cover_tree._place(classes, {32: cover_tree._pick_cells(u, 8)}, np.float64), np.float64, 40, 0.999)
    block = {row.rep: row.unit for row in dealt.collect()}
    held = {frozenset((p.a, p.b)) for p in pairs.collect()}
    assert sorted(block) == list(range(len(rows))) and pairs.count() == len(held)
    blocks = len(set(block.values()))
    assert max(Counter(block.values()).values()) <= 40 and blocks < 400
    assert len(held) < blocks * (blocks + 1) / 2 / 4
    assert all(frozenset((block[a], block[b])) in held for a, b in zip(*(x.tolist() for x in np.nonzero(near))))


def test_vectors_of_one_direction_are_not_split_for_ever(spark):
    rows = [(i, [float(i + 1), 2.0 * (i + 1)]) for i in range(300)] + [(300, [1.0, 0.0]), (301, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=20).collect()}
    assert got == {**{i: (299, 0) for i in range(300)}, 300: (0, 300), 301: (0, 301)}


def test_near_vectors_on_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1.0, 0.0, 0.0]), (9, [1.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(df).collect())
        alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 12)]
        assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (9, 3, 1, False), (9, 3, 1, False), (10, 1, 10, True), (11, 1, 10, False), *alone])
        assert cover_tree.near_vectors(df.limit(0)).collect() == []
