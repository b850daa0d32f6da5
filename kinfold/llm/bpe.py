"""BPE encoding and decoding (operator 1) with a contiguous rank array per short word.

A text is cut into pre-tokens. Each pre-token starts as single bytes; an array holds its part boundaries and the merge
rank of each part with the next one. The encoder looks for the least rank, deletes the boundary between the two parts
and refreshes the two neighbouring ranks, until no rank is left. Short words of equal length run together as the rows
of one matrix, which changes nothing for a row. Words over SHORT bytes go through a heap with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import Cut, Known, pieces

#: Pre-token pattern of the byte-level vocabularies (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 48
#: All code points up to this one are assigned.
ASSIGNED = "\u0377"
CACHE = 200_000
#: Bytes of text whose distinct pieces are looked up together, and pieces whose ids are gathered together.
SLICE, GATHER = 8 << 20, 1 << 18
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> tuple[tuple[int, int], ...]:
    """Ranges of all code points that this Python's Unicode tables don't know.

    Letter classes of assigned code points are fixed, but parties with other tables class some of these as letters.
    """
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for c, before in zip(unknown, [-2, *unknown]) if c != before + 1]
    ends = [c for c, after in zip(unknown, [*unknown[1:], -2]) if c != after - 1]
    return tuple(zip(starts, ends))


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers .json file."""

    def __init__(self, path: str, words: int = CACHE):
        self.most = words
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * (max(chain(vocab.values(), (x["id"] for x in held["added_tokens"]))) + 1)
        for word, i in vocab.items():
            self.bytes[i] = bytes(of_letter[c] for c in word) if all(c in of_letter for c in word) else word.encode()
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.names = [str(i) for i in range(len(self.bytes))]
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.of_pair = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made)}
        self.merge_of = np.zeros(len(pairs), np.int64)
        self.merge_of[self.ranks] = self.made
        self.of_bytes = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.kind = np.dtype(np.uint16 if len(self.bytes) <= 1 << 16 else np.int32)
        self.spaced = Known(lambda words: zip(words, self._raw([" " + w for w in words])), words)
        self.bare = Known(lambda words: zip(words, self._raw(words)), words)
        self.path, self.library = path, None
        self.find = regex.compile(PATTERN).findall
        self.unknown = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in unassigned()) + "]").search
        self.odd = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in unassigned()) + "]"
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; NONE where the vocabulary has no such merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words of one length, a row each: ids in place of the boundaries, ranks of each with the next."""
        rows, n = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(rows, n)
        ids = self.first[raw]
        out: list[tuple[int, ...]] = [()] * rows
        who = np.arange(rows)
        ranks = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        while n > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            if (done := best == NONE).any():
                for i, row in zip(who[done].tolist(), ids[done].tolist()):
                    out[i] = tuple(row)
                left = ~done
                who, ids, ranks, at, best = who[left], ids[left], ranks[left], at[left], best[left]
                if not len(who):
                    return out
            # delete the boundary after part `at`: later parts move one place to the left
            row, keep = np.arange(len(who)), np.ones((len(who), n), bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(who), n - 1)
            ids[row, at] = self.merge_of[best]
            keep[row, at + 1], keep[row, at] = True, False
            ranks = ranks[keep[:, : n - 1]].reshape(len(who), n - 2)
            n -= 1
            if n > 1:  # only the two neighbours' ranks change
                left = np.flatnonzero(at > 0)
                right = np.flatnonzero(at < n - 1)
                r, a = np.r_[left, right], np.r_[at[left] - 1, at[right]]
                ranks[r, a] = self.rank(ids[r, a], ids[r, a + 1])
        for i, row in zip(who.tolist(), ids.tolist()):
            out[i] = tuple(row)
        return out

    def _long(self, word: bytes) -> tuple[int, ...]:
        """The same merges by a heap over linked parts, for words where scanning would be quadratic."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := self.of_pair.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if p := self.of_pair.get(made << 20 | ids[after[j]]):
                    heapq.heappush(heap, (p[0], i, made, ids[after[j]], p[1]))
            if (h := before[i]) >= 0 and (p := self.of_pair.get(ids[h] << 20 | made)):
                heapq.heappush(heap, (p[0], h, ids[h], made, p[1]))
        return tuple(x for x in ids if x >= 0)

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; the commonest shapes need no pattern (isalpha is the letter class).

        Pieces with code points unknown here are cut by the library's own pre-tokenizer.
        """
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():  # letters are never unknown
            return [piece]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        if not piece.isascii() and max(piece) > ASSIGNED and self.unknown(piece):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]
        return self.find(piece)

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, tuple[int, ...]] = {}
        for word in words:
            raw = word.encode()
            if len(raw) > SHORT:
                out[word] = self._long(raw)
            else:
                by_size.setdefault(len(raw), []).append((word, raw))
        for size, held in by_size.items():
            if size:
                out.update(zip((w for w, _ in held), self._short([r for _, r in held])))
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the tokenizers library gives them without added special tokens."""
        cut, cache = self.cut, self.cache
        parts: list[list[list[str]]] = []
        for text in texts:
            spans = cut.split(text) if cut and any(s in text for s in self.special) else [text]
            parts.append([[s] if i % 2 else pieces(s) for i, s in enumerate(spans) if s])
        needed = set().union(*(span for spans in parts for span in spans)) - self.special.keys()
        missing = needed - cache.keys()
        if missing:
            if len(cache) + len(missing) > self.most:
                cache.clear()
                missing = needed
            cut_up = {p: self.words(p) for p in missing}
            cache.update(self.encode_words({w for words in cut_up.values() for w in words} - cache.keys()))
            cache.update((p, tuple(chain.from_iterable(map(cache.__getitem__, w)))) for p, w in cut_up.items() if len(w) > 1)
        of = cache.__getitem__
        out = []
        for spans in parts:
            held: list[int] = []
            for span in spans:
                if len(span) == 1 and span[0] in self.special:
                    held.append(self.special[span[0]])
                else:
                    held.extend(chain.from_iterable(map(of, span)))
            out.append(held)
        return out

    def _raw(self, pieces_: list[str]) -> list[bytes]:
        """Ids of distinct pieces as bytes of self.kind."""
        cut_up = [self.words(p) for p in pieces_]
        ids = self.encode_words({w for words in cut_up for w in words})
        lists = [ids[w[0]] if len(w) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, w))) for w in cut_up]
        raw, wide = np.fromiter(chain.from_iterable(lists), self.kind).tobytes(), self.kind.itemsize
        ends = np.cumsum([len(x) * wide for x in lists]).tolist() if lists else []
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_array(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow array without nulls: distinct pieces are encoded once, and gathered."""
        # all code points up to U+0377 are assigned: most slices need no look at the long class
        rare = pc.any(pc.match_substring_regex(texts, r"[^\x00-\x{377}]")).as_py()
        cut = Cut(texts, list(self.special), self.odd if rare else None)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        odd = np.flatnonzero(~cut.plain).tolist()
        for i, ids in zip(odd, self.encode_batch([texts[i].as_py() for i in odd])):
            out[i] = np.array(ids, self.kind)
        if cut.plain.any():
            raws = cut.entries(self.spaced, self.bare)
            size = np.array(list(map(len, raws)), np.int32) // self.kind.itemsize
            flat, start = np.frombuffer(b"".join(raws), self.kind), np.cumsum(size) - size
            bounds, where, i = cut.bounds, np.flatnonzero(cut.plain).tolist(), 0
            while i < len(where):  # some texts at a time
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + GATHER, side="right")) - 1)
                mine = cut.index[bounds[i] : bounds[j]]
                n = size[mine]
                ends = np.cumsum(n, dtype=np.int64)
                ids = flat[np.repeat(start[mine] - (ends - n), n) + np.arange(int(ends[-1]))]
                for k, part in zip(where[i:j], np.split(ids, np.r_[0, ends][bounds[i + 1 : j] - bounds[i]])):
                    out[k] = part
                i = j
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: their bytes joined and read as UTF-8, with U+FFFD for what isn't."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str, words: int = CACHE) -> Bpe:
    """One vocabulary for each Python worker, with room for the ids of so many words."""
    return Bpe(path, words)


def lists(bpe: Bpe, texts: pa.Array) -> pa.Array:
    """Ids of each text as an Arrow list array; null counts as empty."""
    ids = bpe.encode_array(pc.fill_null(texts, ""))
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text counts as empty and gives no ids. Other columns of df are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(bpe, batch.column("text"))], ["id", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encoded(df: DataFrame, vocabulary: str, text_col: str = "text", words: int = CACHE, slice_bytes: int = SLICE) -> DataFrame:
    """df with a column ids (array<int>) of its text's ids; null text gives none.

    Fewer words that are held, and smaller slices of texts, take less memory and more time; ids are the same.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe, out = loaded(vocabulary, words), []
        for batch in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", slice_bytes):
            out.append(lists(bpe, batch.column("text")))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return df.withColumn("ids", ids(F.col(f"`{text_col}`").cast("string")))


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every document and decode it again in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts give no tokens and the digests of the empty string; repeated rows give equal rows; an empty
    table gives none; other columns are not looked at. Memory is bounded by a slice of texts and CACHE words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        sha, names = hashlib.sha256, bpe.names
        for batch in slices(batches, "text", SLICE):
            n, of_ids, of_text = [], [], []
            for found in bpe.encode_array(pc.fill_null(batch.column("text"), "")):
                ids = found.tolist()
                n.append(len(ids))
                of_ids.append(sha(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
