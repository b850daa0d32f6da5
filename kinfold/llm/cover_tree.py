"""Embedding near-dedup (operator 10): exact threshold links by dual traversal of cover trees.

Vectors lie on the unit sphere at chord distance sqrt(2 - 2 cos). A cover tree has nested levels whose radii halve:
each node of a level covers its vectors within the level's radius, and its centre is the centre of one of its own
children. Two nodes are dropped if their centres are further apart than both covering radii and the threshold
together; they are linked as a whole, without looking at pairs, if centres and radii together stay within it; else
their children are looked at, and single vectors are compared in double precision.

The upper part of the tree is made of tables. Its first nodes are the Voronoi cells of up to MAX_CELLS vectors picked
from a sample of SAMPLE distinct vectors; a node of more than BLOCK vectors is split again around up to FAN of its own
vectors (documented bounds; they shape the work, not the result), round by round, until its vectors fit a block or lie
so close together that they are linked as a whole anyway. Only such close ones, and what ROUNDS rounds leave, are dealt
into blocks by hash. The dual traversal goes down the tables level by level, by equi-joins on the parent, and drops
pairs of nodes by their covering radii. Each block gets a tree of its own, and blocks are dealt into groups of about
GROUP; the pairs of blocks that are left between two groups are a unit of work, so a block moves once for each group
that it meets and not once for each block. A cell with a third of all rows is many blocks in all groups. Equal vectors
are one class with a count. A unit gives counts of links and each vector's least connected vector, never pairs.

Where vectors have no structure, no exact method can rule out many pairs of blocks, and the work is quadratic. Then
most nodes are single vectors, and PREFIX components with the length of the rest bound a product from above, at a
third of its cost; the few pairs that the bound leaves are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release
from .components import components
from .minhash import roots, whole_units

SAMPLE, MAX_CELLS, BLOCK = 4096, 256, 4096
#: Most children of a node that is split, how often, and how many blocks of vectors one task moves to them.
FAN, ROUNDS, SHARE = 64, 8, 16
LEVELS = 8
#: Blocks of a group and least number of groups (they shape the work); vectors in a row of a stored tree.
GROUP, GROUPS, CHUNK = 32, 8, 64
#: Components that bound products, and the level that a traversal starts at where the first ones have hardly any node of several vectors.
PREFIX, FINE = 23, 3
#: Slack of bounds in double precision, and of products in single precision.
SLACK, SINGLE = 1e-7, 2e-5


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * dots))


def bounding(u32: np.ndarray) -> np.ndarray:
    """PREFIX components of unit vectors and the length of the rest: products of two such rows are not below the vectors' product."""
    head = u32[:, :PREFIX]
    rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", head, head, dtype=np.float64)))
    return np.ascontiguousarray(np.c_[head, rest], np.float32)


def net(u32: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of members within about radius of their first one; the first member stays a first one."""
    out, rest, least = [], members, 1 - radius * radius / 2
    while len(rest):
        some = rest[:256]
        dots = u32[some] @ u32[rest].T
        free = np.ones(len(rest), bool)
        for i in range(len(some)):
            if free[i]:
                mine = free & (dots[i] >= least)
                mine[i] = True
                free &= ~mine
                mine[i] = False
                out.append(np.concatenate([some[i : i + 1], rest[mine]]))
        rest = rest[free]
    return out


class Tree:
    """Vectors in tree order. Of each level: where its nodes start, and their covering radii; a node's centre is its first vector."""

    def __init__(self, u: np.ndarray, starts: list[np.ndarray]):
        self.u, self.starts = u, starts
        self.u32 = u.astype(np.float32)
        self.radii = []
        for s in starts:
            size = np.diff(np.r_[s, len(u)])
            d = chord(np.einsum("ij,ij->i", u, u[np.repeat(s, size)]))
            self.radii.append(np.where(size == 1, 0.0, np.maximum.reduceat(d, s) + SLACK))

    @staticmethod
    def order(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tree order of vectors, and in that order the node of each level that each one is in, (n, LEVELS)."""
        u32 = u.astype(np.float32)
        nodes = [np.arange(len(u))]
        marks = [np.zeros(len(u), np.int32)]
        for level in range(1, LEVELS):
            nodes = [x for members in nodes for x in (net(u32, members, 2.0 ** (1 - level)) if len(members) > 1 else [members])]
            mark = np.empty(len(u), np.int32)
            for i, members in enumerate(nodes):
                mark[members] = i
            marks.append(mark)
        order = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        return order, np.stack(marks, axis=1)[order]

    @classmethod
    def read(cls, u: np.ndarray, marks: np.ndarray) -> Tree:
        """The tree of vectors in tree order with their marks."""
        return cls(u, [np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) for m in marks.T])


class Links:
    """Counts and connections of two blocks (or one with itself) within a unit."""

    def __init__(self, a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, same, cosine
        self.most = chord(np.array(cosine)).item()
        self.wa, self.wb = np.r_[0, np.cumsum(weight_a)], np.r_[0, np.cumsum(weight_b)]
        self.weight = (weight_a, weight_b)
        self.ca, self.cb = np.zeros(len(weight_a) + 1, np.int64), np.zeros(len(weight_b) + 1, np.int64)
        self.joined: list[tuple[np.ndarray, np.ndarray]] = []
        self.own = np.zeros(len(weight_a), np.int64)
        self.shift = 0 if same else len(weight_a)

    def whole(self, sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> None:
        """Link all vectors of one range with all of another; equal ranges of one block: with each other."""
        if not len(sa):
            return
        alike = (sa == sb) if self.same else np.zeros(len(sa), bool)
        gain_a, gain_b = self.wb[eb] - self.wb[sb], np.where(alike, 0, self.wa[ea] - self.wa[sa])
        np.add.at(self.ca, sa, gain_a)
        np.add.at(self.ca, ea, -gain_a)
        target = self.ca if self.same else self.cb
        np.add.at(target, sb, gain_b)
        np.add.at(target, eb, -gain_b)
        if alike.any():  # none is linked with itself
            own = np.zeros(len(self.own) + 1, np.int64)
            np.add.at(own, sa[alike], 1)
            np.add.at(own, ea[alike], -1)
            self.own += np.cumsum(own)[:-1] * self.weight[0]
        for s, e, at in ((sa, ea, 0), (sb, eb, self.shift)):
            n = e - s
            each = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.joined.append((each + at, np.repeat(sa, n)))

    def walk(self) -> None:
        """Dual traversal, a level at a time."""
        a, b = self.a, self.b
        # wide nodes of few vectors rule out less than they cost
        start = 1 if 4 * len(a.starts[1]) * len(b.starts[1]) <= len(a.u) * len(b.u) else FINE
        left, right = self.dense(start)
        for level in range(start, LEVELS):
            if level > start:
                left, right = self.children(left, right, level)
            if not len(left):
                return
            left, right = self.decide(left, right, level)
        # what is left are nodes of the last level: single vectors are compared
        last = LEVELS - 1
        sa, ea, sb, eb = self.ranges(left, right, last)
        for i in range(0, len(sa), 4096):
            x, y = self.expand(sa[i : i + 4096], ea[i : i + 4096], sb[i : i + 4096], eb[i : i + 4096])
            if self.same:
                keep = (x < y) | ((x != y) & np.repeat(sa[i : i + 4096] != sb[i : i + 4096], ((ea - sa) * (eb - sb))[i : i + 4096]))
                x, y = x[keep], y[keep]
            self.singles(x, y)

    def singles(self, x: np.ndarray, y: np.ndarray) -> None:
        for i in range(0, len(x), 1 << 17):
            p, q = x[i : i + (1 << 17)], y[i : i + (1 << 17)]
            hit = np.einsum("ij,ij->i", self.a.u[p], self.b.u[q]) >= self.cosine
            p, q = p[hit], q[hit]
            self.whole(p, p + 1, q, q + 1)

    def dense(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a level's nodes that single-precision bounds leave."""
        a, b = self.a, self.b
        ca, cb = a.u32[a.starts[level]], b.u32[b.starts[level]]
        ra, rb = a.radii[level], b.radii[level]
        far = 1 - (self.most + SLACK) ** 2 / 2 - SINGLE
        # single vectors first, as most are; nodes with several have a wider reach
        wide_a, wide_b = ra > 0, rb > 0
        x, y = self.close(np.flatnonzero(~wide_a), np.flatnonzero(~wide_b), level, far)
        out = [(x, y)]
        every = np.arange(len(cb))
        for rows, columns in ((np.flatnonzero(wide_a), every), (np.flatnonzero(~wide_a), np.flatnonzero(wide_b))):
            if not len(columns):
                continue
            for i in range(0, len(rows), 1024):
                some = rows[i : i + 1024]
                reach = self.most + SLACK + ra[some][:, None] + rb[columns]
                x, y = np.nonzero(1 - np.minimum(reach, 2.0) ** 2 / 2 - SINGLE <= ca[some] @ cb[columns].T)
                out.append((some[x], columns[y]))
        left, right = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        if self.same:
            keep = left <= right
            left, right = left[keep], right[keep]
        return left, right

    def close(self, rows: np.ndarray, columns: np.ndarray, level: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a level's nodes whose centres' product may be least or more."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not len(rows) or not len(columns):
            return out[0]
        ua, ub = self.a.u32[self.a.starts[level][rows]], self.b.u32[self.b.starts[level][columns]]
        bound = ua.shape[1] > 2 * PREFIX
        if bound:
            pa, pb = bounding(ua), bounding(ub)
        else:
            pa, pb = ua, ub
        # columns in eights, so that most of the product is passed over eight at a time
        padded = np.zeros((pb.shape[1], -(-len(pb) // 8) * 8), np.float32)
        padded[:, : len(pb)] = pb.T
        held = np.empty((256, padded.shape[1]), np.float32)
        for i in range(0, len(pa), 256):
            dots = np.matmul(pa[i : i + 256], padded, out=held[: len(pa) - i])
            hit = dots >= least
            eights = np.flatnonzero(hit.view(np.uint64) != 0)
            if bound and 16 * len(eights) > hit.size // 8:  # the bound rules out too little
                x, y = np.nonzero(ua[i : i + 256] @ ub.T >= least)
            else:
                at, y = np.nonzero(hit.reshape(-1, 8)[eights])
                x, y = np.divmod(eights[at] * 8 + y, padded.shape[1])
                x, y = x[y < len(pb)], y[y < len(pb)]
            out.append((rows[x + i], columns[y]))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def ranges(self, left: np.ndarray, right: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
        sa, sb = self.a.starts[level], self.b.starts[level]
        ends_a, ends_b = np.r_[sa[1:], len(self.a.u)], np.r_[sb[1:], len(self.b.u)]
        return sa[left], ends_a[left], sb[right], ends_b[right]

    @staticmethod
    def expand(sa, ea, sb, eb) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of each two ranges."""
        na, nb = ea - sa, eb - sb
        n = na * nb
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(nb, n)
        return np.repeat(sa, n) + i // width, np.repeat(sb, n) + i % width

    def children(self, left: np.ndarray, right: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        sa, ea, sb, eb = self.ranges(left, right, level - 1)
        first_a, end_a = np.searchsorted(self.a.starts[level], sa), np.searchsorted(self.a.starts[level], ea)
        first_b, end_b = np.searchsorted(self.b.starts[level], sb), np.searchsorted(self.b.starts[level], eb)
        x, y = self.expand(first_a, end_a, first_b, end_b)
        if self.same:
            keep = x <= y
            x, y = x[keep], y[keep]
        return x, y

    def decide(self, left: np.ndarray, right: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Drop what is too far, link what is near as a whole, compare single vectors; the rest stays."""
        a, b = self.a, self.b
        stay = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(0, len(left), 1 << 17):
            x, y = left[i : i + (1 << 17)], right[i : i + (1 << 17)]
            sa, ea, sb, eb = self.ranges(x, y, level)
            dot = np.einsum("ij,ij->i", a.u[sa], b.u[sb])
            reach = a.radii[level][x] + b.radii[level][y]
            d = chord(dot)
            alike = (x == y) if self.same else np.zeros(len(x), bool)
            single = (ea - sa == 1) & (eb - sb == 1)
            hit = np.where(single, (dot >= self.cosine) & ~alike, d + reach <= self.most - SLACK)
            self.whole(sa[hit], ea[hit], sb[hit], eb[hit])
            keep = ~single & ~hit & (d - reach <= self.most + SLACK)
            stay.append((x[keep], y[keep]))
        return np.concatenate([x for x, _ in stay]), np.concatenate([y for _, y in stay])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of both blocks' vectors one after the other, and each one's least connected place."""
        counts = np.cumsum(self.ca)[:-1] - self.own
        if not self.same:
            counts = np.r_[counts, np.cumsum(self.cb)[:-1]]
        joined = [np.concatenate(x) for x in zip(*self.joined)] if self.joined else [np.zeros(0, np.int64)] * 2
        return counts, roots(len(counts), *joined)


def valid(c: str) -> F.Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(c) > 0) & F.forall(c, finite) & F.exists(c, lambda x: x != 0), F.lit(False))


def _pick_cells(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n vectors of a sample, each the farthest from those before it."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, chord(sample @ sample[chosen[-1]]))
        i = int(far.argmax())
        if far[i] <= 0:
            break
        chosen.append(i)
    return sample[chosen]


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link at a cosine (double precision) of cosine or more; ones of different length never do. Null, empty and
    zero vectors and those with null or non-finite components link with nothing. Each row counts as a vector of its
    own, also where rows repeat. An empty table gives no rows; other columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    wide = rows.schema["v"].dataType.elementType.simpleString() != "float"
    rows = rows.withColumn("v", F.col("v").cast("array<double>" if wide else "array<float>"))
    kind = np.float64 if wide else np.float32
    good = rows.where(valid("v") & F.col("id").isNotNull())
    # adding 0 makes -0 and 0 one value
    classes = materialize(good.groupBy(F.transform("v", lambda x: x + F.lit(0).cast("double" if wide else "float")).alias("v")).agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vectors")
    n = classes.count()
    sample = [np.array(r.v, kind) for r in classes.orderBy(F.xxhash64("v"), "rep").limit(SAMPLE).select("v").collect()]
    cells: dict[int, np.ndarray] = {}
    for size in {len(x) for x in sample}:
        some = unit_rows(np.stack([x for x in sample if len(x) == size]))
        cells[size] = _pick_cells(some, min(MAX_CELLS, max(1, n // block)))
    dealt, pairs, held = _upper(_place(classes, cells, kind), kind, block, cosine)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            block_of = table.column("unit").to_numpy()
            for s, e in _runs(block_of):
                part = table.slice(s, e - s).combine_chunks()
                raw = _stack(part.column("raw"), kind)
                order, marks = Tree.order(unit_rows(raw))
                stored = [part.column(c).to_numpy()[order] for c in ("rep", "weight")] + [raw[order], marks]
                cuts = range(0, e - s, CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cuts), block_of[s])), pa.array(np.arange(len(cuts), dtype=np.int32)), *(pa.array([x[i : i + CHUNK].tobytes() for i in cuts], pa.binary()) for x in stored)],
                    ["block", "ord", "rep", "weight", "raw", "marks"],
                )

    trees = materialize(dealt.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(plant, "block long, ord int, rep binary, weight binary, raw binary, marks binary"), "trees")
    pairs = materialize(pairs, "pairs")
    groups = max(GROUPS, -(-pairs.where("a = b").count() // GROUP))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    dealt_pairs = pairs.select("a", "b", (F.least(group("a"), group("b")) * groups + F.greatest(group("a"), group("b"))).alias("unit"))
    sides = dealt_pairs.select("unit", F.explode(F.array("a", "b")).alias("block")).distinct()
    work = trees.join(sides, "block").select("unit", "block", "ord", F.lit(0).cast("long").alias("other"), "rep", "weight", "raw", "marks")
    none = F.lit(None).cast("binary")
    work = work.unionByName(dealt_pairs.select("unit", F.col("a").alias("block"), F.lit(-1).alias("ord"), F.col("b").alias("other"), *[none.alias(c) for c in ("rep", "weight", "raw", "marks")]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            for s, e in _runs(table.column("unit").to_numpy()):
                rep, counts, other = _meet(table.slice(s, e - s).combine_chunks(), kind, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(counts), pa.array(other)], ["rep", "links", "other"])
            release()

    # more partitions than units, so that few share one
    shares = min(2 * groups * (groups + 1), 4096)
    met = materialize(work.repartition(shares, "unit").sortWithinPartitions("unit", "block", "ord").mapInArrow(meet, "rep long, links long, other long"), "links")
    for stage in (*held, trees, pairs):
        discard(stage)
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = (
        classes.join(counts, "rep", "left")
        .join(found.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    )
    zero = F.lit(0).cast("double" if wide else "float")
    keyed = rows.withColumn("k", F.when(valid("v") & F.col("id").isNotNull(), F.transform("v", lambda x: x + zero)))
    return (
        keyed.join(of_class.withColumnRenamed("v", "k"), "k", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
    )


def _stack(raw: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    held = raw.to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1)


def _meet(part: pa.Table, kind, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, counts of links and a connected rep of a unit's vectors with links; part has the pairs of blocks (ord -1) and the stored trees' rows, by block and ord."""
    block, order, other = (part.column(c).to_numpy() for c in ("block", "ord", "other"))
    pair, stored = np.flatnonzero(order < 0), part.filter(pa.array(order >= 0))
    read = lambda c, s, e, t: np.frombuffer(b"".join(stored.column(c).slice(s, e - s).to_pylist()), t)
    trees, reps, weights, first, n = {}, [], {}, {}, 0
    for s, e in _runs(block[order >= 0]):
        own = int(block[order >= 0][s])
        reps.append(read("rep", s, e, np.int64))
        weights[own], first[own] = read("weight", s, e, np.int64), n
        m = len(reps[-1])
        trees[own] = Tree.read(unit_rows(read("raw", s, e, kind).reshape(m, -1)), read("marks", s, e, np.int32).reshape(m, -1))
        n += m
    counts, joined = np.zeros(n, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in zip(block[pair].tolist(), other[pair].tolist()):
        links = Links(trees[a], trees[b], weights[a], weights[b], a == b, cosine)
        links.walk()
        more, label = links.result()
        at = np.arange(first[a], first[a] + len(weights[a]))
        if a != b:
            at = np.r_[at, np.arange(first[b], first[b] + len(weights[b]))]
        counts[at] += more
        some = np.flatnonzero(label != np.arange(len(label)))
        joined.append((at[some], at[label[some]]))
    label = roots(n, *(np.concatenate(x) for x in zip(*joined)))
    some = np.flatnonzero(counts)
    rep = np.concatenate(reps)
    return rep[some], counts[some], rep[label[some]]


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return list(zip(start.tolist(), [*start[1:].tolist(), len(key)]))


def _place(classes: DataFrame, cells: dict[int, np.ndarray], kind) -> DataFrame:
    """rep, weight, raw, cell, parent (null) and dist, the distance from the cell's centre, of every class."""
    centres = classes.sparkSession.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            size = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
            raw = [flat[a : a + m].astype(kind).tobytes() for a, m in zip(at.tolist(), size.tolist())]
            # a length that the sample lacks is one cell, of which nothing is known
            cell, dist = np.zeros(len(size), np.int64), np.full(len(size), 2.0)
            for m in np.unique(size).tolist():
                mine = np.flatnonzero(size == m)
                found = centres.value.get(m)
                if found is not None:
                    dots = unit_rows(np.stack([np.frombuffer(raw[i], kind) for i in mine])) @ found.T
                    cell[mine], dist[mine] = dots.argmax(axis=1), chord(dots.max(axis=1))
                cell[mine] += m << 16  # cells of each length are apart
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("weight"), pa.array(raw, pa.binary()), pa.array(cell), pa.nulls(len(size), pa.int64()), pa.array(dist)], ["rep", "weight", "raw", "cell", "parent", "dist"])

    return materialize(classes.select("rep", "weight", "v").mapInArrow(place, "rep long, weight long, raw binary, cell long, parent long, dist double"), "cells")


def _upper(placed: DataFrame, kind, block: int, cosine: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The upper tree: (unit, rep, weight, raw) of all vectors by block, the pairs of blocks, and tables to drop.

    A node's centre is its vector nearest to what it was picked around, its reach the largest distance from that. Nodes
    to split, and vectors that move to their children, stay tables: a node's vectors are dealt over shares of SHARE
    blocks each, and each share gets the node's children.
    """
    most = float(chord(np.array(cosine)))
    now, nodes, stages, leaves = placed, [], [placed], []
    for turn in range(ROUNDS + 1):
        found = now.groupBy("cell").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), (F.max("dist") + SLACK).alias("reach"), F.min_by("raw", "dist").alias("raw"))
        fits = (F.col("n") <= block) | (F.col("reach") <= most / 4) | F.lit(turn == ROUNDS)
        found = materialize(found.withColumns({"leaf": fits, "parts": F.ceil(F.col("n") / F.lit(block))}), "nodes")
        nodes.append(found)
        stages.append(found)
        own = now.join(found.where("leaf").select("cell", "parts"), "cell")
        leaves.append(own.select(F.xxhash64("cell", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("unit"), "rep", "weight", "raw"))
        wide = found.where("not leaf").select("cell", "n", F.least(F.lit(FAN), F.col("parts") + 1).cast("int").alias("k"), F.ceil(F.col("parts") / SHARE).alias("shares"))
        if wide.isEmpty():
            break
        over = now.join(wide, "cell")
        # the children's centres: k of some 64 to 256 vectors that a hash picks
        order = F.xxhash64("rep", F.lit(turn))
        some = over.where(F.pmod(order, F.col("n")) < F.greatest(F.lit(64), 4 * F.col("k"))).groupBy("cell", "k", "shares").agg(F.array_sort(F.collect_list(F.struct(order.alias("h"), "rep", "raw"))).alias("s"))
        centres = some.select("cell", "shares", F.posexplode(F.slice("s", F.lit(1), F.col("k")))).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.col("pos").cast("long").alias("rep"), F.lit(0).cast("long").alias("weight"), "col.raw")
        vectors = over.select("cell", F.pmod(F.xxhash64("rep"), F.col("shares")).alias("share"), F.lit(1).alias("kind"), "rep", "weight", "raw")
        moved = vectors.unionByName(centres).repartition("cell", "share").sortWithinPartitions("cell", "share", "kind", "rep").mapInArrow(_nearest(kind), "rep long, weight long, raw binary, parent long, child int, dist double")
        now = materialize(moved.select("rep", "weight", "raw", F.xxhash64("parent", "child").alias("cell"), "parent", "dist"), "cells")
        stages.append(now)
    rows = leaves[0]
    for other in leaves[1:]:
        rows = rows.unionByName(other)
    return rows, _block_pairs(nodes, kind, most + 4 * SLACK), stages


def _nearest(kind):
    """Moves vectors to the nearest of the centres that come before them in their share of a node."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, share, is_vector = (batch.column(c).to_numpy() for c in ("cell", "share", "kind"))
            edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (share[1:] != share[:-1]) | (is_vector[1:] != is_vector[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(cell)]):
                part = batch.slice(s, e - s)
                if (cell[s], share[s]) != at:
                    at, centres = (cell[s], share[s]), []
                u = unit_rows(_stack(part.column("raw"), kind))
                if not is_vector[s]:
                    centres.append(u)
                    continue
                dots = u @ np.concatenate(centres).T
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("weight"), part.column("raw"), part.column("cell"), pa.array(dots.argmax(axis=1).astype(np.int32)), pa.array(chord(dots.max(axis=1)))], ["rep", "weight", "raw", "parent", "child", "dist"])

    return move


def _block_pairs(nodes: list[DataFrame], kind, most: float) -> DataFrame:
    """(unit, a, b): pairs of blocks, a block with itself too, that the covering radii leave.

    Dual traversal of the upper tree: pairs of nodes that may be within most of each other become the pairs of their
    children; a leaf stands for itself until the last level. At most MAX_CELLS first nodes of each vector length come
    to the driver.
    """
    session = nodes[0].sparkSession
    of_size: dict[int, list] = {}
    for r in nodes[0].select("cell", "raw", "reach").collect():
        of_size.setdefault(len(r.raw), []).append(r)
    first = []
    for same in of_size.values():
        u, reach = unit_rows(np.stack([np.frombuffer(r.raw, kind) for r in same])), np.array([r.reach for r in same])
        x, y = np.nonzero(np.triu(chord(u @ u.T) <= reach[:, None] + reach + most))
        first += [(same[i].cell, same[j].cell) for i, j in zip(x.tolist(), y.tolist())]
    pairs = session.createDataFrame(first, "a long, b long")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, keep = pa.compute.binary_length(batch.column("raw_a")).to_numpy(), np.zeros(batch.num_rows, bool)
            for m in np.unique(size).tolist():
                mine = np.flatnonzero(size == m)
                u, v = (unit_rows(_stack(batch.column(c).take(pa.array(mine)), kind)) for c in ("raw_a", "raw_b"))
                reach = batch.column("reach_a").to_numpy() + batch.column("reach_b").to_numpy()
                keep[mine] = chord(np.einsum("ij,ij->i", u, v)) <= reach[mine] + most
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def down(pairs: DataFrame, kids: DataFrame) -> DataFrame:
        named = lambda k: kids.select(F.col("parent").alias(k), F.col("node").alias(f"child_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in kids.columns if c not in ("parent", "node")])
        both = pairs.join(named("a"), "a").join(named("b"), "b").where("a <> b or child_a <= child_b")
        return both.drop("a", "b").withColumnsRenamed({"child_a": "a", "child_b": "b"})

    ended = nodes[0].where("leaf")
    for level in nodes[1:]:
        themselves = ended.select(F.col("cell").alias("parent"), F.col("cell").alias("node"), "raw", "reach")
        kids = level.select("parent", F.col("cell").alias("node"), "raw", "reach").unionByName(themselves)
        pairs = down(pairs, kids).select("a", "b", "raw_a", "raw_b", "reach_a", "reach_b").mapInArrow(near, "a long, b long")
        ended = ended.unionByName(level.where("leaf"))
    parts = ended.select(F.col("cell").alias("parent"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")).select("parent", F.xxhash64("parent", "p").alias("node"))
    return down(pairs, parts).select("a", "b").withColumn("unit", F.xxhash64("a", "b"))
