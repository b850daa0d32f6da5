"""Token counts (operator 2) by overlap resynchronisation.

Texts over CHUNK characters are encoded as overlapping chunks with offsets. Two neighbouring chunks are spliced at a
place in their overlap where both start a pre-token and which lies before the last pre-token and MARGIN characters
before the end of the left chunk. Pre-tokenization reads from left to right and never looks back, so right of such a
place the right chunk's tokens are those of the whole text, and left of it the left chunk's are. Where the overlap
holds no such place, it is doubled, until the right chunk starts where the left one's proven part does. A right chunk
is at least as long as the overlap, so a text without any such place is encoded some times over, not once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import Cut, Known

CHUNK, OVERLAP, MARGIN = 16_384, 128, 32
CACHE, SLICE = 400_000, 16 << 20


def boundaries(encoding, shift: int, low: int, high: int) -> dict[int, int]:
    """Where pre-tokens of an encoded chunk start within [low, high) of the whole text -> tokens before that place.

    The chunk's last pre-token is left out. Only the tokens within the range are looked at.
    """
    n, of_char, word, chars = len(encoding), encoding.char_to_token, encoding.token_to_word, encoding.token_to_chars
    last = n - 1
    while last > 0 and word(last) is not None and word(last - 1) == word(last):
        last -= 1
    t = next((x for c in range(max(0, low - shift), max(0, high - shift)) if (x := of_char(c)) is not None), n)
    found = {}
    before = word(t - 1) if 0 < t < n else -1
    while t < last:
        now, at = word(t), chars(t)[0] + shift
        if at >= high:
            break
        # a special token stands alone and may carry its neighbour's word number or none
        if at >= low and (now is None or now != before):
            found[at] = t
        before, t = now, t + 1
    return found


class Counter:
    """Counts tokens with the tokenizers library."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        self.special = [x.content for x in self.of.get_added_tokens_decoder().values()]
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        self.margin = max([MARGIN, *(2 * len(x) for x in self.special)])
        self.spaced = Known(lambda words: ((p[1:], n) for p, n in self._each([" " + w for w in words])), CACHE)
        self.bare = Known(self._each, CACHE)

    def spliced(self, text: str) -> int:
        """Tokens of a huge text from overlapping chunks."""
        encode = lambda a, b: self.of.encode(text[a:b], add_special_tokens=False)
        total, start, end = 0, 0, min(self.chunk, len(text))
        left = encode(start, end)
        skip = 0  # tokens of the left chunk that earlier ones have counted
        proven = 0  # from here on the left chunk's tokens are the whole text's
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(proven, end - overlap)
                stop = min(len(text), end + max(self.chunk, end - begin))
                right = encode(begin, stop)
                if begin == proven:  # both are proven from here: the right one replaces the left one
                    place = (skip, 0)
                    break
                sure, other = boundaries(left, start, max(proven, begin + 1), end - self.margin + 1), boundaries(right, begin, begin + 1, end)
                p = next((x for x in sure if x in other), None)
                if p is not None:
                    place, proven = (sure[p], other[p]), p
                    break
                self.widened += 1
                overlap *= 2
            total += place[0] - skip
            left, start, end, skip = right, begin, stop, place[1]
        return total + len(left) - skip

    def _each(self, strings: list[str]) -> Iterator[tuple[str, int]]:
        for i in range(0, len(strings), 4096):
            some = strings[i : i + 4096]
            yield from zip(some, map(len, self.of.encode_batch_fast(some, add_special_tokens=False)))

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        """Tokens of each text: of huge ones by splicing, of others piece by piece, as a piece starts a pre-token."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out = np.zeros(len(texts), np.int64)
        huge = pc.greater(pc.utf8_length(texts), self.chunk).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(huge).tolist():
            out[i] = self.spliced(texts[i].as_py())
        small = np.flatnonzero(~huge)
        cut = Cut(texts.take(pa.array(small)), self.special)
        odd = small[~cut.plain].tolist()
        if odd:
            out[odd] = [len(e) for e in self.of.encode_batch_fast([texts[i].as_py() for i in odd], add_special_tokens=False)]
        if cut.plain.any():
            n = np.array(cut.entries(self.spaced, self.bare), np.int64)
            out[small[cut.plain]] = np.add.reduceat(n[cut.index], cut.bounds[:-1])
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Counter:
    """One counter for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows give equal rows; an empty table gives none; other
    columns are not looked at. A text over CHUNK characters is held chunk by chunk when encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary)
        for batch in slices(batches, "text", SLICE):
            n = counter.count(pc.fill_null(batch.column("text"), ""))
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
