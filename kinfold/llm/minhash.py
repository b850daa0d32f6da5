"""MinHash near-dedup (operator 9) with b-bit signatures.

Every text's set of word shingles gets K minima. BANDS bands of ROWS minima make candidate buckets; the low BITS bits
of all minima, packed by bit planes into 64-bit words, give a similarity estimate by counting bits, corrected for
chance collisions. Documents of a bucket whose estimate isn't sure to lie under the threshold join one cluster, and
within clusters links are confirmed on the full shingle sets; components of confirmed links are the result.

What keeps groups of any size from one task:
- documents with equal shingle sets are one representative, found by an aggregate with partial results;
- buckets and clusters over BLOCK members (or BLOCK_BYTES of sets) are dealt into blocks, and each pair of blocks is a
  unit of work of its own;
- a unit gives each member's least connected member, never its pairs.

Chance of losing a link at the threshold 0.85: (1 - 0.85^4)^24 = 2e-8 by the bands, and 1e-9 by the estimate, as
SURE standard deviations are allowed below the threshold. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import components

WORDS = 5
K, BANDS, ROWS, BITS = 128, 24, 4, 4
#: Members of a block, and bytes of their shingle sets; a unit holds two blocks.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Bytes of text that are hashed at a time; they take some fifty times that.
SLICE = 2 << 20
SURE = 6.0
#: Shares that the copies of one text are dealt into.
SALTS = 64
SIGNATURE = "doc long, n long, fp1 long, fp2 long, sig binary, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def constants() -> dict[str, np.ndarray]:
    """Fixed random numbers of all hash functions."""
    r = np.random.default_rng(9)
    draw = lambda *s: r.integers(0, 2**64, s, dtype=np.uint64)
    return {"byte": draw(256), "word": draw(64) | np.uint64(1), "a": draw(K) | np.uint64(1), "b": draw(K), "row": draw(ROWS) | np.uint64(1), "band": draw(BANDS), "step": np.uint64(0x9E3779B97F4A7C15)}


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lower-cased), and where each text's words start (length + 1)."""
    c = constants()
    raws = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    sizes = np.array([len(x) + 1 for x in raws], np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    ends = np.cumsum(sizes)
    at = np.r_[0, np.searchsorted(start, ends)]
    if not len(start):
        return np.zeros(0, np.uint64), at
    length = end - start
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)])) if start[0] == 0 else np.r_[np.zeros(start[0], np.int64), np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))]
    most = int(length.max())
    powers = np.cumprod(np.full(max(most, 1), c["step"], np.uint64))
    value = c["byte"][data]
    value *= powers[np.minimum(place, most - 1)]
    value[space] = 0
    return mix(np.add.reduceat(value, start) + length.astype(np.uint64)), at


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle has, the whole sequence as one."""
    c = constants()["word"]
    if words > len(c):
        raise ValueError("too many words in a shingle")
    hashes, at = word_hashes(texts)
    n = len(hashes)
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        whole += hashes[j : n - words + 1 + j] * c[j] if n >= words else np.zeros(0, np.uint64)
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        m = b - a
        if m >= words:
            s = np.sort(whole[a : b - words + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif m:
            out.append(mix((hashes[a:b] * c[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """K minima of each set, (sets, K); none of them may be empty."""
    c = constants()
    out = np.empty((len(sets), K), np.uint64)
    i = 0
    while i < len(sets):  # some sets at a time, so that they stay in the cache
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 16_384):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        held = np.empty_like(flat)
        for k in range(K):
            np.multiply(flat, c["a"][k], out=held)
            held += c["b"][k]
            out[i:j, k] = np.minimum.reduceat(held, starts)
        i = j
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """(n, BITS * K / 64) words: the bit planes of BITS bits of each minimum, one plane after another."""
    bits = (low >> np.uint64(20)).astype(np.uint8) & ((1 << BITS) - 1)
    planes = [np.packbits(bits >> p & 1, axis=1) for p in range(BITS)]
    return np.concatenate(planes, axis=1).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures row by row, from equal minima: chance gives 2^-BITS of the unequal ones."""
    x = (a ^ b).reshape(len(a), BITS, K // 64)
    unequal = np.bitwise_count(np.bitwise_or.reduce(x, axis=1)).sum(axis=1)
    chance = 2.0**-BITS
    return ((1 - unequal / K) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Estimates below this are sure to come from similarities below threshold."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SURE * (p * (1 - p) / K) ** 0.5 / (1 - chance)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """SIGNATURE of every row: set size, set fingerprint, packed signature, band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = constants()
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            fp = np.zeros((2, len(sets)), np.uint64)
            sig: list[bytes | None] = [None] * len(sets)
            keys: list[np.ndarray | None] = [None] * len(sets)
            if len(some):
                m = minima([sets[i] for i in some])
                packed = pack(m)
                band = np.stack([mix((m[:, i * ROWS : i * ROWS + ROWS] * c["row"]).sum(axis=1, dtype=np.uint64) + c["band"][i]) for i in range(BANDS)], axis=1).view(np.int64)
                for k, i in enumerate(some.tolist()):
                    mixed = mix(sets[i] + c["step"])
                    fp[0, i], fp[1, i] = mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(mixed))
                    sig[i], keys[i] = packed[k].tobytes(), band[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "n", "fp1", "fp2", "sig", "bands"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' component under the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        # roots learn of each other too
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def deal(members: DataFrame, key: str, set_size: str | None = None) -> DataFrame:
    """The members (key, doc) of keys with two or more, and of each the number of its key's blocks and its own one.

    Keys of up to BLOCK members, with sets (of set_size shingles each) of up to BLOCK_BYTES, have one block; larger ones
    are split by a hash of doc.
    """
    size = F.ceil(F.count("*") / F.lit(BLOCK))
    if set_size:
        size = F.greatest(size, F.ceil(F.sum(F.col(set_size) * 8) / F.lit(BLOCK_BYTES)))
    sizes = members.groupBy(key).agg(F.least(size, F.count("*")).cast("int").alias("parts"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = members.join(sizes.hint("merge"), key)
    return dealt.withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))


def units(dealt: DataFrame, key: str) -> DataFrame:
    """A row for each unit that a dealt row takes part in: unit and alone, in place of key and parts.

    Every pair of a key's blocks is a unit; alone tells whether it is a block with itself.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("blk", j).alias("i"), F.greatest("blk", j).alias("j"))))
    return dealt.withColumn("pair", pair).withColumn("unit", F.xxhash64(key, "pair.i", "pair.j")).withColumn("alone", F.expr("pair.i = pair.j")).drop("pair", "parts", key)


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units from batches that are sorted by unit."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        unit = now.column("unit").to_numpy()
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(unit: np.ndarray, alone: np.ndarray, blk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, by distance within units sorted one after another."""
    a = np.arange(len(unit) - 1)
    d = 1
    while len(a):
        a = a[a + d < len(unit)]
        a = a[unit[a] == unit[a + d]]
        some = a[alone[a] | (blk[a] != blk[a + d])]
        if len(some):
            yield some, some + d
        d += 1


def near_in_units(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each member and the least one it is near to by estimates, within each unit."""
    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches):
            unit, alone, blk, doc = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "alone", "blk", "doc"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(len(unit), -1)
            found = [(a[near], b[near]) for a, b in _pairs(unit, alone, blk) for near in [estimate(sig[a], sig[b]) >= least]]
            yield from _stars(doc, found)

    return _sorted_units(dealt, "unit", "alone", "blk", "doc", "sig").mapInArrow(run, "a long, b long")


def _stars(doc: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        label = roots(len(doc), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        other = np.flatnonzero(label != np.arange(len(doc)))
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(doc[other]), pa.array(doc[label[other]])], ["a", "b"])


def _sorted_units(dealt: DataFrame, *columns: str) -> DataFrame:
    return dealt.select(*columns).repartition("unit").sortWithinPartitions("unit", "doc")


def confirmed_in_units(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member and the least one that confirmed links connect it with, within each unit (column set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches):
            unit, alone, blk, doc = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "alone", "blk", "doc"))
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            found = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)]):
                m = e - s
                if m == 2:
                    shared = np.array([[0, len(np.intersect1d(sets[s], sets[s + 1], assume_unique=True))], [0, 0]])
                else:
                    # columns: shingles that two or more members have
                    flat = np.concatenate(sets[s:e])
                    row = np.repeat(np.arange(m), size[s:e])
                    order = np.argsort(flat, kind="stable")
                    flat, row = flat[order], row[order]
                    new = np.r_[True, flat[1:] != flat[:-1]]
                    column = np.cumsum(new) - 1
                    many = np.bincount(column) > 1
                    keep = many[column]
                    column, row = (np.cumsum(many) - 1)[column[keep]], row[keep]
                    shared = np.zeros((m, m), np.float32)
                    for c in range(0, int(many.sum()), 8192):  # some columns at a time
                        part = (column >= c) & (column < c + 8192)
                        held = np.zeros((m, 8192), np.float32)
                        held[row[part], column[part] - c] = 1
                        shared += held @ held.T
                a, b = np.triu_indices(m, 1)
                both = np.rint(shared[a, b]).astype(np.int64)
                link = (100 * both >= percent * (size[s + a] + size[s + b] - both)) & (alone[s] | (blk[s + a] != blk[s + b]))
                found.append((s + a[link], s + b[link]))
            yield from _stars(doc, found)

    return _sorted_units(dealt, "unit", "alone", "blk", "doc", "set").mapInArrow(run, "a long, b long")


def sets_of(df: DataFrame, words: int = WORDS) -> DataFrame:
    """df (cluster, doc, parts, blk, text) with the text's shingle set in place of the text."""
    keep = ["cluster", "doc", "parts", "blk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sets, pa.binary())], [*keep, "set"])

    return df.select(*keep, "text").mapInArrow(run, "cluster long, doc long, parts int, blk int, set binary")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets, component_id is the
    smallest doc_id reachable, and kept tells whether that is the document itself. Texts that are null, empty or
    without words have no shingles and no links. Rows that repeat a doc_id stay rows, and are joined with what any of
    their texts is linked with; null ids link with nothing and are kept. An empty table gives no rows; other columns
    are not looked at.
    """
    threshold = percent / 100
    table = materialize(signatures(df, id_col, text_col, words), "signatures")
    known = table.where("n > 0 and doc is not null")
    # equal sets: one representative each, by way of one for each of SALTS shares of the copies
    salted = known.select("doc", "fp1", "fp2", "n", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("fp1", "fp2", "n", "salt").agg(F.min("doc").alias("part"))
    classes = parts.groupBy("fp1", "fp2", "n").agg(F.min("part").alias("rep"))
    copies = salted.join(parts.hint("merge"), ["fp1", "fp2", "n", "salt"]).where("doc <> part").select(F.col("doc").alias("a"), F.col("part").alias("b"))
    member = copies.unionByName(parts.join(classes.hint("merge"), ["fp1", "fp2", "n"]).where("part <> rep").select(F.col("part").alias("a"), F.col("rep").alias("b")))
    reps = materialize(known.join(classes.select(F.col("rep").alias("doc"), "fp1", "fp2", "n"), ["doc", "fp1", "fp2", "n"], "left_semi").dropDuplicates(["doc", "fp1", "fp2"]), "representatives")
    # signatures follow only where a bucket has two members, and texts only where a cluster has
    shared = deal(reps.select(F.explode("bands").alias("key"), "doc"), "key")
    near = near_in_units(units(shared, "key").join(reps.select("doc", "sig").hint("merge"), "doc"), threshold)
    clusters = components(near)
    inside = clusters.select(F.col("node").alias("doc"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("doc"), F.col("root").alias("cluster")).distinct())
    sized = inside.join(reps.select("doc", "n").hint("merge"), "doc")
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).join(deal(sized, "cluster", "n").drop("n").hint("merge"), "doc")
    links = confirmed_in_units(units(sets_of(texts, words), "cluster"), percent)
    found = components(links.unionByName(member))
    return (
        table.join(found.select(F.col("node").alias("doc"), "root").hint("merge"), "doc", "left")
        .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
    )
