"""The best pairs of a block of S1 records and a block of the index, by their postings (B7 to B10 within a cell)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "way int, s1_id string, cand_id string, score double"
_ARROW = pa.schema([("way", pa.int32()), ("s1_id", pa.string()), ("cand_id", pa.string()), ("score", pa.float64())])
#: Products of weights that are held at a time (one S1 record's at least).
HITS = 1 << 21
#: Bits of a score to nine places: scores are cosines of weights above 0, so at most 1 but for rounding.
SCORE_BITS = 30


def _coded(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The items of lists as numbers in the order of the ids, and the ids."""
    items = lists.combine_chunks().flatten().dictionary_encode()
    ids = items.dictionary
    order = pc.sort_indices(ids).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[items.indices.to_numpy(zero_copy_only=False)], ids.take(pa.array(order))


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _first(keys: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted keys are among the first k of their run."""
    if not len(keys):
        return np.empty(0, bool)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)])) < k


class Lists:
    """The k best pairs of each key: by score to nine places downwards, then by the other side's number."""

    def __init__(self, k: int, keys: int, others: int) -> None:
        self.k, self.bits = k, max(1, (others - 1).bit_length())
        if max(1, (keys - 1).bit_length()) + SCORE_BITS + self.bits > 63:
            raise ValueError(f"a cell of {keys} by {others} records is too large")
        self.held, self.scores = np.empty(0, np.int64), np.empty(0)

    def add(self, key: np.ndarray, other: np.ndarray, score: np.ndarray, places: np.ndarray) -> None:
        """Take pairs in; places are the scores to nine places as whole numbers."""
        packed = (key << (SCORE_BITS + self.bits)) | (((1 << SCORE_BITS) - 1 - places) << self.bits) | other
        order = np.argsort(packed)
        order = order[_first(packed[order] >> (SCORE_BITS + self.bits), self.k)]
        packed, score = np.concatenate([self.held, packed[order]]), np.concatenate([self.scores, score[order]])
        order = np.argsort(packed)
        order = order[_first(packed[order] >> (SCORE_BITS + self.bits), self.k)]
        self.held, self.scores = packed[order], score[order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, other, score)."""
        return self.held >> (SCORE_BITS + self.bits), self.held & ((1 << self.bits) - 1), self.scores


def best(k: int, reverse_k: int) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow: rows of a cell are terms, each with S1 ids, index ids and their weights.

    Scores of all pairs with a term in common are summed, some S1 records at a time, in the order of their ids. Gives
    the k best candidates of each S1 record (way 0) and the reverse_k best S1 records of each candidate (way 1).
    """

    def run(cell: pa.Table) -> pa.Table:
        s1, s1_ids = _coded(cell["s1_ids"])
        cand, cand_ids = _coded(cell["cand_ids"])
        s1_w, cand_w = _flat(cell["s1_ws"]), _flat(cell["cand_ws"])
        n_s1, n_cand = (pc.list_value_length(cell[c]).to_numpy().astype(np.int64) for c in ("s1_ids", "cand_ids"))
        row = np.repeat(np.arange(len(cell)), n_s1)
        order = np.argsort(s1, kind="stable")
        s1, s1_w, row = s1[order], s1_w[order], row[order]
        start, n = (np.cumsum(n_cand) - n_cand)[row], n_cand[row]
        backward = Lists(reverse_k, len(cand_ids), len(s1_ids))
        out = []
        for a, b in _batches(s1, n):
            m = n[a:b]
            at = np.arange(m.sum()) + np.repeat(start[a:b] - (np.cumsum(m) - m), m)
            pair = np.repeat(s1[a:b], m) * len(cand_ids) + cand[at]
            product = np.repeat(s1_w[a:b], m) * cand_w[at]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            score, pair = np.add.reduceat(product[order], first), pair[first]
            key, other = np.divmod(pair, len(cand_ids))
            places = np.floor(score * 1e9 + 0.5).astype(np.int64)
            if k:
                forward = Lists(k, len(s1_ids), len(cand_ids))
                forward.add(key, other, score, places)
                x, y, z = forward.pairs()
                out.append(_rows(0, s1_ids, x, cand_ids, y, z))
            if reverse_k:
                backward.add(other, key, score, places)
        if reverse_k:
            y, x, z = backward.pairs()
            out.append(_rows(1, s1_ids, x, cand_ids, y, z))
        return pa.concat_tables(out) if out else _ARROW.empty_table()

    return run


def _rows(way: int, s1_ids: pa.Array, x: np.ndarray, cand_ids: pa.Array, y: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(x), way, np.int32)), s1_ids.take(pa.array(x)), cand_ids.take(pa.array(y)), pa.array(score)], schema=_ARROW)


def _batches(s1: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of postings, cut between S1 records, with about HITS products each."""
    if not len(s1):
        return
    ends = np.flatnonzero(np.r_[s1[1:] != s1[:-1], True]) + 1
    done = np.cumsum(n)[ends - 1]
    a, before = 0, 0
    while a < len(s1):
        i = max(np.searchsorted(done, before + HITS, "right") - 1, np.searchsorted(ends, a, "right"))
        yield a, int(ends[i])
        a, before = int(ends[i]), done[i]
