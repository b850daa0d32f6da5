"""Suffix-array dedup (operator 6): a logarithmic family of indexes over content-defined shares of all windows.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Every string of
LENGTH bytes (a window) is keyed by the least hash of its GRAM-byte strings, so equal windows have equal keys, and
neighbouring windows mostly share theirs. A maximal row of windows with one key is shipped once, as one string, to the
bucket of that key. Within a bucket, strings are added batch by batch to an index family: each batch gets a suffix
array (its suffixes sorted by LENGTH bytes), is merge-scanned against the existing levels for matches of LENGTH bytes,
and levels of equal size merge geometrically. Of equal windows, those of the least document stay; the others' places
are the result.

What keeps shares even: strings that a map task has seen from a smaller document of the same slice are settled there;
equal strings of a bucket are one before they are indexed; grams that are frequent over all documents (a common line,
a group of copies) key a window only if it holds no other, so the many different surroundings of a common line go to
the keys of those surroundings. The list of frequent grams is at most MOST_FREQUENT long; it moves work, not results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices

LENGTH, GRAM = 50, 16
SLICE = 4 << 20
#: Windows are keyed in stretches of so many bytes, to stay in the cache; longer texts are cut with an overlap.
STRETCH = 256 << 10
BUCKET_BYTES = 8 << 20
#: Most partitions that buckets are dealt over; a partition streams its buckets one after another.
PARTITIONS = 8192
#: Bytes shipped for a byte of text, about: LENGTH - 1 bytes more for each row of windows.
SPREAD = 3.7
#: Windows of a batch, and of the keys that share an index family.
BATCH, FAMILY = 1 << 16, 1 << 18
LOCALLY_FREQUENT = 8
MOST_FREQUENT = 1 << 20
NO_ID = np.iinfo(np.int64).max
NARROW = np.iinfo(np.int32).max

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_TOP = np.uint64(1 << 63)


def gram_hashes(data: np.ndarray, frequent: np.ndarray, filter_: np.ndarray | None) -> np.ndarray:
    """Hashes of all GRAM-byte strings of data; frequent ones (sorted) get the top bit, so they come last."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = words[:n] * _M1
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n] * _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    h >>= np.uint64(1)
    if filter_ is not None and len(frequent):
        maybe = np.flatnonzero(filter_[(h >> np.uint64(47)).astype(np.int64)])
        if len(maybe):
            found = h[maybe]
            at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
            h[maybe[frequent[at] == found]] |= _TOP
    return h


def frequency_filter(frequent: np.ndarray) -> np.ndarray | None:
    """Which leading 16 bits occur among the frequent hashes."""
    if not len(frequent):
        return None
    out = np.zeros(1 << 16, bool)
    out[(frequent >> np.uint64(47)).astype(np.int64)] = True
    return out


def least_of_windows(h: np.ndarray) -> np.ndarray:
    """Least hash among the grams of each window."""
    width, done, m = LENGTH - GRAM + 1, 1, h
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - done : width - done + len(h) - width + 1]) if done < width else m


def stretches(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together up to STRETCH bytes: data, and of each part its text, its place in data and in its text."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = np.array([len(x) for _, _, x in held], np.int64)
        return data, np.array([i for i, _, _ in held], np.int64), np.cumsum(sizes) - sizes, np.array([a for _, a, _ in held], np.int64)

    for i, raw in enumerate(raws):
        for a in range(0, max(1, len(raw) - LENGTH + 1), STRETCH):
            part = raw[a : a + STRETCH + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > STRETCH:
                yield joined()
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield joined()


def window_rows(raws: list[bytes], frequent: np.ndarray, filter_: np.ndarray | None):
    """For each stretch: data, gram hashes, and of each row of windows its text, place in text, place in data, windows, key."""
    for data, text, at, shift in stretches(raws):
        h = gram_hashes(data, frequent, filter_)
        least = least_of_windows(h)
        ends = np.r_[at[1:], len(data)] - LENGTH + 1  # windows may not reach into the next part
        start = np.zeros(len(least), bool)
        start[1:] = least[1:] != least[:-1]
        start[at] = True
        dead = np.zeros(len(data) + 1, np.int8)
        np.add.at(dead, ends, 1)
        np.add.at(dead, np.minimum(np.r_[at[1:], len(data)], len(data)), -1)
        live = np.cumsum(dead[: len(least)]) == 0
        start[ends[ends < len(least)]] = True
        first = np.flatnonzero(start)
        n = np.diff(np.r_[first, len(least)])
        keep = live[first]
        first, n = first[keep], n[keep]
        part = np.searchsorted(at, first, side="right") - 1
        yield data, h, text[part], first - at[part] + shift[part], first, n, least[first]


def frequent_grams(source: DataFrame, buckets: int, total: int) -> np.ndarray:
    """Hashes of grams so frequent that their windows alone would make a good part of a bucket; at most MOST_FREQUENT.

    Counted over all documents: each slice gives the grams that its own frequent keys' rows hold often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in slices(batches, "text", SLICE):
            raws = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            keys, grams = [], []
            for _, h, _, _, first, n, key in window_rows(raws, none, None):
                keys.append(key)
                grams.append((h, first, n))
            if not keys:
                continue
            value, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            often = (count >= LOCALLY_FREQUENT)[inverse]
            found, i = [], 0
            for h, first, n in grams:
                mine = often[i : i + len(first)]
                i += len(first)
                if mine.any():
                    a, m = first[mine], n[mine] + LENGTH - GRAM
                    found.append(h[np.repeat(a - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())])
            if found:
                value, count = np.unique(np.concatenate(found), return_counts=True)
                keep = count >= LOCALLY_FREQUENT
                yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["gram", "n"])

    rows = total * SPREAD / (LENGTH + 17)
    least = max(1000, int(rows / buckets / 4))
    held = source.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(held.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def _merge(who: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans of each owner."""
    if not len(who):
        return who, start, stop
    order = np.lexsort((start, who))
    who, start, stop = who[order], start[order], stop[order]
    base = who.astype(np.int64)
    new = np.r_[True, base[1:] != base[:-1]]
    group = np.cumsum(new) - 1
    # running end within each owner: ends are lifted by owner, so one running maximum does
    lift = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * lift) - group * lift
    begin = new | np.r_[True, start[1:] > reach[:-1]]
    first = np.flatnonzero(begin)
    return who[first], start[first], reach[np.r_[first[1:] - 1, len(who) - 1]]


def _pack(who: np.ndarray, pos: np.ndarray, size: np.ndarray, body: bytes, span: tuple[np.ndarray, ...], ids: np.ndarray, marks: np.ndarray) -> bytes:
    """A compressed share: the documents in it, strings with owner and place, and spans that are settled already."""
    used, who2 = np.unique(np.r_[who, span[0]], return_inverse=True)
    # narrow numbers, and steps where they ascend, take the least room
    wide = np.int64 if len(pos) and int(pos.max()) > NARROW or len(span[2]) and int(span[2].max()) > NARROW else np.int32
    long = np.int64 if len(size) and int(size.max()) > 65_535 else np.uint16
    head = np.array([len(used), len(who), len(span[0]), np.dtype(wide).itemsize, np.dtype(long).itemsize], np.int64)
    parts = [head, np.diff(ids[used], prepend=0), marks[used], np.diff(who2[: len(who)], prepend=0).astype(np.int32), who2[len(who) :].astype(np.int32), pos.astype(wide), size.astype(long), span[1].astype(wide), span[2].astype(wide)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in parts) + body)


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    u, n, s, wide, long = np.frombuffer(raw, np.int64, 5).tolist()
    at = 40

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(raw, kind, k, at)
        at += out.nbytes
        return out

    place, length = f"<i{wide}", "<u2" if long == 2 else "<i8"
    ids, marks, who, owner = np.cumsum(take(np.int64, u)), take(np.int64, u), np.cumsum(take(np.int32, n), dtype=np.int64), take(np.int32, s)
    pos, size, start, stop = take(place, n).astype(np.int64), take(length, n).astype(np.int64), take(place, s).astype(np.int64), take(place, s).astype(np.int64)
    return ids, marks, who, pos, size, (owner, start, stop), raw[at:]


def shares(source: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """(bucket, blob): all rows of windows, by the bucket of their key."""
    held = source.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = frequency_filter(held.value)
        for batch in slices(batches, "text", SLICE):
            batch = batch.take(pa.compute.sort_indices(batch.column("doc")))  # smaller ids first
            ids, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            raws = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            seen: dict[bytes, int] = {}
            strings: list[bytes] = []
            found = []
            for data, _, text, pos, first, n, key in window_rows(raws, held.value, filter_):
                body, size = data.tobytes(), n + LENGTH - 1
                now = [body[a:b] for a, b in zip(first.tolist(), (first + size).tolist())]
                # the first text of this slice that has each string; texts are in the order of their ids
                by = np.fromiter(map(seen.setdefault, now, text.tolist()), np.int64, len(now))
                strings += now
                found.append((text, pos, size, (key % np.uint64(buckets)).astype(np.int64), ids[by] < ids[text]))
            if not found:
                continue
            del seen
            text, pos, size, to, done = map(np.concatenate, zip(*found))
            settled = _merge(text[done], pos[done], pos[done] + size[done])
            spread = (settled[0] * 7919 + settled[1]) % buckets
            left = np.flatnonzero(~done)
            left = left[np.argsort(to[left], kind="stable")]
            rows = []
            edges = np.searchsorted(to[left], np.arange(buckets + 1)).tolist() if buckets <= len(left) else None
            for k in np.union1d(to[left], spread).tolist():
                i, j = (edges[k], edges[k + 1]) if edges else np.searchsorted(to[left], [k, k + 1]).tolist()
                mine, own = left[i:j], spread == k
                rows.append((k, _pack(text[mine], pos[mine], size[mine], b"".join(map(strings.__getitem__, mine.tolist())), tuple(x[own] for x in settled), ids, marks)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    return source.mapInArrow(run, "bucket int, blob binary")


class IndexFamily:
    """Suffix arrays of growing size: levels of sorted LENGTH-byte suffixes with their document and place."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gone: list[tuple[np.ndarray, np.ndarray]] = []

    def _drop(self, who: np.ndarray, place: np.ndarray) -> None:
        if len(who):
            self.gone.append((who, place))

    def _settle(self, key: np.ndarray, who: np.ndarray, place: np.ndarray):
        """Of equal suffixes in a sorted array, only those of the least document stay."""
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        if len(new) == len(key):
            return key, who, place
        least = np.repeat(np.minimum.reduceat(who, new), np.diff(np.r_[new, len(key)]))
        stay = who == least
        self._drop(who[~stay], place[~stay])
        return key[stay], who[stay], place[stay]

    def add(self, key: np.ndarray, who: np.ndarray, place: np.ndarray) -> None:
        """Index a batch: its suffix array, a merge-scan against each level, and geometric merges."""
        order = np.argsort(key, kind="stable")
        key, who, place = self._settle(key[order], who[order], place[order])
        for i, (k, w, p) in enumerate(self.levels):
            if not len(key) or not len(k):
                continue
            a, b = np.searchsorted(k, key, "left"), np.searchsorted(k, key, "right")
            hit = np.flatnonzero(a < b)
            if not len(hit):
                continue
            theirs = w[a[hit]]
            later = hit[who[hit] > theirs]
            beaten = hit[who[hit] < theirs]
            if len(beaten):
                stay = np.ones(len(k), bool)
                for x, y in {(int(a[j]), int(b[j])) for j in beaten}:
                    stay[x:y] = False
                self._drop(w[~stay], p[~stay])
                self.levels[i] = (k[stay], w[stay], p[stay])
            if len(later):
                stay = np.ones(len(key), bool)
                stay[later] = False
                self._drop(who[later], place[later])
                key, who, place = key[stay], who[stay], place[stay]
        now = (key, who, place)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(now[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), now)]
            order = np.argsort(both[0], kind="stable")  # two sorted runs: a merge
            now = tuple(x[order] for x in both)
        self.levels.append(now)


def repeats(body: np.ndarray, who: np.ndarray, pos: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, frequent: np.ndarray, filter_: np.ndarray | None):
    """(owner, start, stop) of all windows of the strings that a smaller document has, where the strings differ."""
    # strings whose key no other document's string has can't share a window
    key, i = np.empty(len(at), np.uint64), 0
    while i < len(at):  # some strings at a time, so that hashes stay in the cache
        j = max(i + 1, int(np.searchsorted(at, at[i] + STRETCH)))
        part = body[at[i] : at[j - 1] + size[j - 1]]
        h = np.append(gram_hashes(part, frequent, filter_), np.full(GRAM, np.iinfo(np.uint64).max, np.uint64))
        bounds = np.empty(2 * (j - i), np.int64)
        bounds[::2], bounds[1::2] = at[i:j] - at[i], at[i:j] - at[i] + size[i:j] - GRAM + 1
        key[i:j] = np.minimum.reduceat(h, bounds)[::2]
        i = j
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    doc = ids[who][order]
    spread = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
    use = order[np.repeat(spread, np.diff(np.r_[new, len(order)]))]
    # strings of one key lie together; some keys at a time have an index family of their own, as keys never meet
    begins = np.flatnonzero(np.r_[True, key[use][1:] != key[use][:-1]]) if len(use) else np.zeros(0, np.int64)
    # owners are numbered by id, so that comparing numbers compares documents
    _, rank = np.unique(ids, return_inverse=True)
    owners, n = who[use], size[use] - LENGTH + 1
    ends = np.cumsum(n)
    suffixes = np.ndarray((max(0, len(body) - LENGTH + 1),), f"S{LENGTH}", buffer=body, strides=(1,)) if len(body) >= LENGTH else None
    found, g = [], 0
    while g < len(begins):
        i = int(begins[g])
        base = int(ends[i - 1]) if i else 0
        g = max(g + 1, int(np.searchsorted(ends[begins[1:] - 1], base + FAMILY, side="right")) + 1) if len(begins) > 1 else g + 1
        last = int(begins[g]) if g < len(begins) else len(use)
        family = IndexFamily()
        while i < last:
            j = min(last, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH, side="right"))))
            m = n[i:j]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            where = np.repeat(at[use[i:j]], m) + step
            place = np.repeat(np.arange(i, j), m) << 32 | step
            family.add(suffixes[where], np.repeat(rank[owners[i:j]], m), place)
            i = j
        if family.gone:
            place = np.concatenate([p for _, p in family.gone])
            row = place >> 32
            start = pos[use][row] + (place & 0xFFFFFFFF)
            found.append(_merge(owners[row], start, start + LENGTH))
    return tuple(map(np.concatenate, zip(*found))) if found else None


def spans(dealt: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc, mark, start, stop): spans to remove, from the shares of each bucket."""
    held = dealt.sparkSession.sparkContext.broadcast(frequent)

    def bucket_spans(blobs: list[bytes], filter_: np.ndarray | None) -> pa.RecordBatch:
        ids, marks, who, pos, size, bodies, found = [], [], [], [], [], [], []
        base = 0
        for blob in blobs:
            i, m, w, p, n, span, body = _unpack(blob)
            ids.append(i)
            marks.append(m)
            found.append((span[0] + base, span[1], span[2]))
            who.append(w.astype(np.int64) + base)
            pos.append(p)
            size.append(n.astype(np.int64))
            bodies.append(body)
            base += len(i)
        ids, marks, who, pos, size = map(np.concatenate, (ids, marks, who, pos, size))
        body = b"".join(bodies)
        del bodies
        if len(who):
            stop = np.cumsum(size)
            at = stop - size
            seen: dict[bytes, int] = {}
            # equal strings: all but those of the least document go as a whole
            alike = np.fromiter((seen.setdefault(body[a:b], k) for k, (a, b) in enumerate(zip(at.tolist(), stop.tolist()))), np.int64, len(who))
            del seen
            doc = ids[who]
            least = doc.copy()
            np.minimum.at(least, alike, doc)
            stay = doc == least[alike]
            gone = ~stay
            found.append((who[gone], pos[gone], pos[gone] + size[gone]))
            more = repeats(np.frombuffer(body, np.uint8), who[stay], pos[stay], at[stay], size[stay], ids, held.value, filter_)
            if more is not None:
                found.append(more)
        who, start, stop = _merge(*(np.concatenate([x[j] for x in found]).astype(np.int64) for j in range(3)))
        return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(marks[who]), pa.array(start), pa.array(stop)], ["doc", "mark", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = frequency_filter(held.value)
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now and blobs:
                    yield bucket_spans(blobs, filter_)
                    blobs = []
                    release()
                now = bucket
                blobs.append(blob)
        if blobs:
            yield bucket_spans(blobs, filter_)
        del blobs
        release()

    return dealt.mapInArrow(run, "doc long, mark long, start long, stop long")


def removals(source: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc, mark, spans) of every row of source (doc, mark, text) that loses bytes; spans may still overlap."""
    session = source.sparkSession
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not buckets:
        buckets = max(2 * int(session.conf.get("spark.sql.shuffle.partitions")), int(total * SPREAD / BUCKET_BYTES) + 1)
    frequent = frequent_grams(source, buckets, total)
    dealt = shares(source, buckets, frequent).repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket")
    # written first, so that the shares are gone when the texts move
    return materialize(spans(dealt, frequent), "spans").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (NO_ID for null), mark and text, before df's columns.

    Where an id comes with several rows, mark is a hash of the text, so that places in them stay apart; else it is 0.
    """
    repeated = not df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    mark = F.xxhash64(F.col(text_col).cast("string")) if repeated else F.lit(0).cast("long")
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("__doc"), mark.alias("__mark"), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in df.columns])


def _cut(raw: bytes, found: list[dict] | None) -> tuple[bytes, int]:
    """What is left of raw, and the number of removed runs."""
    if not found:
        return raw, 0
    kept, at, runs = [], 0, 0
    last = -1
    for a, b in sorted((x["start"], x["stop"]) for x in found):
        if a > last:
            kept.append(raw[at:a])
            runs += 1
        last = max(last, b)
        at = max(at, b)
    kept.append(raw[at:])
    return b"".join(kept), runs


def dedup_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null and empty texts, and texts under LENGTH bytes, lose nothing. Rows that repeat a doc_id count as one document:
    they never remove from each other. A null id counts as larger than all others. An empty table gives no rows; other
    columns are not looked at.
    """
    source = marked(df.select("doc_id", "text"), "doc_id", "text").select(F.col("__doc").alias("doc"), F.col("__mark").alias("mark"), F.col("__text").alias("text"))
    found = removals(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, runs = _cut(raw, spans_)
                out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            doc = [None if x == NO_ID else x for x in batch.column("doc").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array([x[j] for x in out], pa.int64()) for j in range(3)), pa.array([x[3] for x in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return source.join(found, ["doc", "mark"], "left").select("doc", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every text cut down to what no document with a smaller id has; the other columns stay.

    Spans are bytes; a character that a span cuts through goes as a whole. Null texts stay null.
    """
    source = marked(df, id_col, text_col)
    found = removals(source.select(F.col("__doc").alias("doc"), F.col("__mark").alias("mark"), F.col("__text").alias("text")))

    @F.arrow_udf("string")
    def left(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([x if x is None or not s else _cut(x.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for x, s in zip(texts.to_pylist(), found.to_pylist())], pa.string())

    joined = source.join(found.withColumnsRenamed({"doc": "__doc", "mark": "__mark", "spans": "__spans"}), ["__doc", "__mark"], "left")
    return joined.withColumn("__text", left("__text", "__spans")).select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
