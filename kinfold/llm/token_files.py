"""Token-ID / binary output (operator 5): Arrow stream files of fixed-size-list batches.

Documents are range-partitioned by id. Each partition is one shard: an Arrow IPC stream whose record batches hold three
columns, `ids` fixed_size_list<uint16>[SEQ] (uint32 for vocabularies over 65,536 ids), `mask` fixed_size_list<bool>[SEQ]
and `last` fixed_size_list<bool>[SEQ], which marks the last id of each document. Documents are packed without gaps; only a
shard's last sequence is padded (mask false). As every value has a fixed width, all full batches are equally long, so the
n-th id of a shard lies at a place that is known without reading what is before it: a reader maps the file, or seeks in a
remote one, and slices without copying. A second stream beside it holds the ids of the shard's documents in their order.
The manifest has one row a shard. Files are written to a temporary name and moved, so a repeated task leaves the same
files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, slices

SEQ, ROWS = 1024, 256
END_ID = 2
CACHE = 600_000
#: Words of lower-case letters that the normaliser leaves alone, with one sign after them at most.
LETTERS = "^[a-zÀ-ÖØ-öø-į]+[.,]?$"
#: Bytes of text whose distinct words are looked up together, and words whose ids are gathered together.
SLICE, GATHER = 24 << 20, 1 << 19
#: Text bytes of a shard; shards of very large tables are larger, so that there are at most MOST_SHARDS.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 1 << 16
#: Rows of a batch that is read back, and shards whose starts are counted together.
DOCS, RANGE = 1 << 14, 1 << 12
MANIFEST = "shard int, path string, n_docs long, n_ids long"


class WordEncoder:
    """Encodes texts with the tokenizers library, word by word where that is the same.

    The vocabulary drops white space before anything is merged, and its normaliser works within words, so a text's ids
    are those of its white-space separated words. Texts with separators that only Python counts as white space are
    encoded whole, as are those that may hold special tokens.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        self.kind = np.dtype("<u2" if self.of.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.of.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _each(self, words: list[str], into: dict[str, bytes]) -> None:
        """Ids of words, each encoded by itself."""
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            into.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(some, self.of.encode_batch_fast(some, add_special_tokens=False)))

    def _letters(self, words: list[str], into: dict[str, bytes]) -> None:
        """Ids of words that are one pre-token each: encoded as one text, and cut after each id that ends a word."""
        wide = self.kind.itemsize
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = np.array(self.of.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(some):
                self._each(some, into)
                continue
            raw, at = ids.tobytes(), np.r_[0, (ends + 1) * wide].tolist()
            into.update(zip(some, (raw[a:b] for a, b in zip(at[:-1], at[1:]))))

    def _known(self, cache: dict[str, bytes], words: list[str], how) -> list[bytes]:
        """Ids of distinct words by a cache of bounded size."""
        lacking = [w for w in words if w not in cache]
        if len(cache) + len(lacking) > CACHE:
            cache.clear()
            lacking = words
        how(lacking, cache)
        return list(map(cache.__getitem__, words))

    def _words(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words, ASCII letters lower-cased. Letters and a sign after them are pre-tokens of their own."""
        plain = pc.match_substring_regex(words, LETTERS)
        stems = pc.replace_substring_regex(words.filter(plain), "[.,]$", "").dictionary_encode()
        of_stem = self._known(self.stems, stems.dictionary.to_pylist(), self._letters)
        signs = pc.index_in(pc.utf8_slice_codeunits(words.filter(plain), -1), value_set=pa.array([",", "."]))
        of_sign = self._known(self.cache, [",", "."], self._each) + [b""]
        both = [of_stem[i] + of_sign[j] for i, j in zip(stems.indices.to_pylist(), pc.fill_null(signs, 2).to_pylist())]
        rest = self._known(self.cache, [w or "." for w in words.filter(pc.invert(plain)).to_pylist()], self._each)
        out = np.empty(len(words), object)
        mask = plain.to_numpy(zero_copy_only=False)
        out[mask], out[~mask] = both, rest
        return out.tolist()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, of the vocabulary's kind; null is empty."""
        texts = pc.fill_null(texts, "")
        # ASCII letters are lower-cased one by one, so that can come first, but for what may spell a special token
        odd = np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]|<[|]").to_numpy(zero_copy_only=False))
        cut = pc.utf8_split_whitespace(pc.ascii_lower(texts))
        flat = cut.flatten().dictionary_encode()
        raws = self._words(flat.dictionary)
        if (none := pc.index(flat.dictionary, "").as_py()) >= 0:
            raws[none] = b""
        wide = self.kind.itemsize
        size = np.array(list(map(len, raws)), np.int32) // wide
        ids, start, index = np.frombuffer(b"".join(raws), self.kind), np.cumsum(size) - size, flat.indices.to_numpy()
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        held: list[bytes] = []
        i = 0
        while i < len(texts):  # the ids of all words of some texts, one after another
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + GATHER, side="right")) - 1)
            mine = index[bounds[i] : bounds[j]]
            n = size[mine]
            ends = np.cumsum(n, dtype=np.int32)
            body = ids[np.repeat((start[mine] - (ends - n)).astype(np.int32), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)].tobytes()
            at = (np.r_[np.int32(0), ends][bounds[i : j + 1] - bounds[i]].astype(np.int64) * wide).tolist()
            held += [body[x:y] for x, y in zip(at[:-1], at[1:])]
            i = j
        for k in odd.tolist():
            held[k] = np.array(self.of.encode(texts[k].as_py(), add_special_tokens=False).ids, self.kind).tobytes()
        return held


@lru_cache(maxsize=2)
def loaded(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)


def filesystem(uri: str):
    """The file system of a shared path, and the path within it; whatever scheme Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class _Stream:
    """An Arrow stream file under a temporary name until it is closed."""

    def __init__(self, where, final: str, schema: pa.Schema):
        self.fs, self.final, self.temporary = where, final, f"{final}.{uuid.uuid4().hex}.tmp"
        self.file = where.open_output_stream(self.temporary)
        self.stream = pa.ipc.new_stream(self.file, schema)

    def close(self) -> None:
        """End the stream and move the file to its place."""
        self.stream.close()
        self.file.close()
        self.fs.move(self.temporary, self.final)


def documents_of(uri: str) -> str:
    """The file of a shard's document ids."""
    return f"{uri.removesuffix('.arrows')}.docs.arrows"


class ShardWriter:
    """Packs ids into the stream file of one shard, and the ids of its documents into another."""

    def __init__(self, folder: str, shard: int, kind: np.dtype):
        self.kind, self.wide = kind, kind.itemsize
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}.arrows"
        self.uri = f"{folder}/{name}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), SEQ)), ("mask", pa.list_(pa.bool_(), SEQ)), ("last", pa.list_(pa.bool_(), SEQ))])
        self.docs = pa.schema([("doc_id", pa.int64())])
        self.out, self.index = _Stream(where, f"{base}/{name}", self.schema), _Stream(where, documents_of(f"{base}/{name}"), self.docs)
        self.held: list[bytes] = []
        #: Places behind the last ids of documents, counted from the first id that is held
        self.ends: list[int] = []
        self.size = self.total = self.n_docs = 0

    def add(self, doc_ids: pa.Array, raws: list[bytes]) -> None:
        """Append documents; each has one id at least."""
        self.index.stream.write_batch(pa.record_batch([doc_ids], schema=self.docs))
        self.n_docs += len(raws)
        for raw in raws:
            n = len(raw) // self.wide
            self.held.append(raw)
            self.size += n
            self.total += n
            self.ends.append(self.size)
            if self.size >= SEQ * ROWS:
                self.flush(False)

    def flush(self, final: bool) -> None:
        """Write full batches; at the end the rest as well, padded."""
        ids = np.frombuffer(b"".join(self.held), self.kind)
        last = np.zeros(len(ids), bool)
        last[np.array(self.ends, np.int64) - 1] = True
        step = SEQ * ROWS
        full = len(ids) // step * step
        for i in range(0, full, step):
            self.batch(ids[i : i + step], np.ones(step, bool), last[i : i + step])
        ids, last = ids[full:], last[full:]
        if final and len(ids):
            pad = np.zeros(-len(ids) % SEQ, bool)
            self.batch(np.r_[ids, pad.astype(self.kind)], np.r_[np.ones(len(ids), bool), pad], np.r_[last, pad])
            ids, last = ids[:0], last[:0]
        self.held, self.size, self.ends = [ids.tobytes()], len(ids), (np.flatnonzero(last) + 1).tolist()

    def batch(self, *columns: np.ndarray) -> None:
        """One record batch of whole sequences."""
        self.out.stream.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), SEQ) for x in columns], schema=self.schema))

    def close(self) -> None:
        """Write what is left and move the files to their places."""
        self.flush(True)
        self.index.close()
        self.out.close()


class ShardReader:
    """Access to one shard: any ids, any sequence, or all documents one after another.

    Local files are mapped; of others only the batches that are asked for are read.
    """

    def __init__(self, uri: str):
        from pyarrow import fs

        where, path = filesystem(uri)
        self.where, self.path = where, path
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.first = self.source.tell()
        self.length, self.n_batches, self.at, self.now = 0, 0, -1, None
        # the end of a stream takes eight bytes
        if self.source.size() - 8 > self.first:
            pa.ipc.read_message(self.source)
            self.length = self.source.tell() - self.first
            self.n_batches = -(-(self.source.size() - 8 - self.first) // self.length)
        #: ids before the padding, which only the last batch can have
        self.size = (self.n_batches - 1) * SEQ * ROWS + self.batch(self.n_batches - 1)[1].true_count if self.n_batches else 0

    def batch(self, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Ids, mask and last marks of the k-th batch; the batch of the last call is kept."""
        if k != self.at:
            self.source.seek(self.first + k * self.length)
            held = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
            self.at, self.now = k, tuple(held.column(c).flatten() for c in ("ids", "mask", "last"))
        return self.now

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; a slice of the map where they lie in one batch."""
        if start + n > self.size:
            raise ValueError("the ids reach into padding")
        step, parts = SEQ * ROWS, []
        while n:
            a = start % step
            m = min(n, step - a)
            parts.append(self.batch(start // step)[0].to_numpy()[a : a + m])
            start, n = start + m, n - m
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def digests(self) -> Iterator[tuple[int, int, int]]:
        """(start, number of ids, crc32 of them as 32-bit integers) of the documents, by the marks in the file."""
        crc = begin = base = 0
        for k in range(self.n_batches):
            ids, _, last = self.batch(k)
            raw = memoryview(ids.to_numpy().astype("<u4").tobytes())
            at = 0
            for end in (np.flatnonzero(last.to_numpy(zero_copy_only=False)) + 1).tolist():
                yield begin, base + end - begin, zlib.crc32(raw[4 * at : 4 * end], crc)
                crc, begin, at = 0, base + end, end
            crc = zlib.crc32(raw[4 * at :], crc)
            base += len(ids)

    def doc_ids(self) -> Iterator[int | None]:
        """Ids of the shard's documents in their order."""
        with self.where.open_input_file(documents_of(self.path)) as source:
            for batch in pa.ipc.open_stream(source):
                yield from batch.column("doc_id").to_pylist()


def write(df: DataFrame, vocabulary: str, folder: str, shards: int, end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest (MANIFEST) is written beside the shards and returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, out = loaded(vocabulary), None
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in slices(batches, "text", SLICE):
            out = out or ShardWriter(folder, shard, encoder.kind)
            out.add(batch.column("doc_id"), [x + end for x in encoder.encode(batch.column("text"))])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([out.uri]), pa.array([out.n_docs], pa.int64()), pa.array([out.total], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_back(manifest: DataFrame, shards: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; the manifest tells the order of shards only.

    The ids before a shard are counted in two steps: within ranges of RANGE shards, and over the ranges.
    """
    ranged = manifest.withColumn("range", F.floor(F.col("shard") / RANGE))
    ranges = ranged.groupBy("range").agg(F.sum("n_ids").alias("m"))
    ranges = ranges.select("range", F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("within", within).join(ranges, "range").select("path", (F.col("base") + F.col("within")).cast("long").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                reader = ShardReader(path)
                rows = ((i, before + at, n, crc) for i, (at, n, crc) in zip(reader.doc_ids(), reader.digests(), strict=True))
                while some := list(islice(rows, DOCS)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, vocabulary: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the token files of a table of documents and return what reading them back gives.

    Null and empty texts hold the end id alone; rows that repeat a doc_id follow one another; an empty table writes no
    shard and gives no rows; other columns are not looked at. A shard holds about shard_bytes of text, more where there
    would be over MOST_SHARDS of them.
    """
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = new_path(df.sparkSession, "tokens")
    shards = max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_SHARDS, -(-total // shard_bytes)))
    return read_back(write(df, vocabulary, folder, shards, end_id), shards)
