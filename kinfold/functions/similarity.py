"""String similarities of pairs.

Set and number comparisons are column expressions. The ratios need longest common subsequences, which run over whole
Arrow batches: all pairs of a batch advance together through a bit-parallel recurrence (Hyyro 2004), one column of the
second string at a time, with as many 64-bit words as the first string needs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words_of

#: Pairs, and windows, that advance together.
PAIRS, WINDOWS = 2048, 1 << 15


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded code points (-1 behind the end) and lengths."""
    size = np.array([len(x) for x in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    out = np.full((len(texts), int(size.max()) if len(texts) else 0), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


class Masks:
    """Of each first string, where each symbol of the batch stands in it: (pairs, symbols, words)."""

    def __init__(self, texts: list[str]):
        codes, self.size = _codes(texts)
        self.symbols = np.unique(codes[codes >= 0])
        self.words = max(1, -(-codes.shape[1] // 64))
        self.table = np.zeros((len(texts), len(self.symbols) + 1, self.words), np.uint64)
        for k in range(codes.shape[1]):
            row = np.flatnonzero(codes[:, k] >= 0)
            self.table[row, np.searchsorted(self.symbols, codes[row, k]), k // 64] |= np.uint64(1) << np.uint64(k % 64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Places of code points among the symbols; the last place, without any bit, for others."""
        at = np.searchsorted(self.symbols, codes)
        at = np.minimum(at, len(self.symbols) - 1) if len(self.symbols) else np.zeros_like(at)
        known = self.symbols[at] == codes if len(self.symbols) else np.zeros(codes.shape, bool)
        return np.where(known, at, len(self.symbols))

    def _states(self, pair: np.ndarray, places: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The recurrence's state after each column of places; zero bits up to a pair's size are matches."""
        state = [np.full(len(pair), np.iinfo(np.uint64).max, np.uint64) for _ in range(self.words)]
        for t in range(places.shape[1]):
            mask = self.table[pair, places[:, t]]
            carry = np.zeros(len(pair), np.uint64)
            for w in range(self.words):
                s = state[w]
                u = s & mask[:, w]
                total = s + u
                over = total < s
                total += carry
                over |= total < carry
                carry = over.astype(np.uint64)
                state[w] = total | (s - u)
            yield state

    def _found(self, pair: np.ndarray, state: list[np.ndarray]) -> np.ndarray:
        """Matches of a state."""
        found = np.zeros(len(pair), np.int64)
        for w in range(self.words):
            live = np.clip(self.size[pair] - 64 * w, 0, 64)
            mask = np.where(live >= 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(live, 63).astype(np.uint64)) - np.uint64(1))
            found += np.bitwise_count(~state[w] & mask)
        return found

    def lcs(self, pair: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each row of places with its pair's first string."""
        state = None
        for state in self._states(pair, places):
            pass
        return np.zeros(len(pair), np.int64) if state is None else self._found(pair, state)

    def best_start(self, places: np.ndarray) -> np.ndarray:
        """The best F1 of each pair's first string with any start of its row of places that is no longer than it: one scan gives all starts."""
        pair, out = np.arange(len(places)), np.zeros(len(places))
        for t, state in enumerate(self._states(pair, places)):
            out = np.where(t < self.size, np.maximum(out, _shares(self._found(pair, state), self.size + t + 1)), out)
        return out


def lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequences of pairs."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort([max(len(x), len(y)) for x, y in zip(a, b)], kind="stable")  # like lengths together
    for i in range(0, len(order), PAIRS):
        some = order[i : i + PAIRS]
        masks = Masks([a[k] for k in some])
        out[some] = masks.lcs(np.arange(len(some)), masks.places(_codes([b[k] for k in some])[0]))
    return out


def _shares(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """100 * 2 * LCS / (both lengths); 100 for two empty strings."""
    return _shares(lcs(a, b), np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64))


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """F1 of the words in order."""
    tidy = lambda x: " ".join(sorted(x.split()))
    return ratios(list(map(tidy, a)), list(map(tidy, b)))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """of shared words, and shared words with either rest; see the cases below."""
    n = len(a)
    out, rests = np.zeros(n), ([], [])
    shape = np.zeros((n, 3), np.int64)
    left = []
    for i, (x, y) in enumerate(zip(a, b)):
        s, t = set(x.split()), set(y.split())
        if not s or not t:
            continue
        both = s & t
        if both and (len(both) == len(s) or len(both) == len(t)):
            out[i] = 100.0  # one side's words are all in the other
            continue
        p, q = " ".join(sorted(s - both)), " ".join(sorted(t - both))
        rests[0].append(p)
        rests[1].append(q)
        shape[i] = len(" ".join(both)), len(p), len(q)
        left.append(i)
    if left:
        shared, p, q = shape[left].T
        gap = (shared > 0).astype(np.int64)
        apart = p + q - 2 * lcs(*rests)
        whole_p, whole_q = shared + gap + p, shared + gap + q
        best = 100 - 100 * apart / (whole_p + whole_q)
        # shared words against shared words with a rest differ by that rest alone
        one = np.where(gap > 0, 100 - 100 * (gap + p) / np.maximum(shared + whole_p, 1), 0.0)
        two = np.where(gap > 0, 100 - 100 * (gap + q) / np.maximum(shared + whole_q, 1), 0.0)
        out[left] = np.maximum(best, np.maximum(one, two))
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """the best F1 of the shorter string with any window of the longer one, windows cut short at its ends included."""
    n = len(a)
    out = np.where([not x and not y for x, y in zip(a, b)], 100.0, 0.0) if n else np.zeros(0)
    jobs = []
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y:
            jobs.append((i, x, y) if len(x) <= len(y) else (i, y, x))
            if len(x) == len(y):
                jobs.append((i, y, x))
    jobs.sort(key=lambda j: (len(j[1]), len(j[2])))
    at = 0
    while at < len(jobs):
        some, size = [], 0
        while at < len(jobs) and (not some or (len(some) < PAIRS and size + len(jobs[at][2]) - len(jobs[at][1]) < WINDOWS)):
            some.append(jobs[at])
            size += len(jobs[at][2]) - len(jobs[at][1]) + 1
            at += 1
        masks = Masks([x for _, x, _ in some])
        places = masks.places(_codes([y for _, _, y in some])[0])
        # windows within the longer string, then those cut short at its start, and at its end
        short, long = np.array([len(x) for _, x, _ in some]), np.array([len(y) for _, _, y in some])
        most = int(short.max())
        count = long - short + 1
        pair = np.repeat(np.arange(len(some)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        column = np.arange(most)
        window = np.where(column < short[pair][:, None], places[pair[:, None], np.minimum(start[:, None] + column, places.shape[1] - 1)], len(masks.symbols))
        best = np.maximum.reduceat(_shares(masks.lcs(pair, window), 2 * short[pair]), np.cumsum(count) - count)
        best = np.maximum(best, masks.best_start(places[:, :most]))
        turned = Masks([x[::-1] for _, x, _ in some])
        best = np.maximum(best, turned.best_start(turned.places(_codes([y[::-1] for _, _, y in some])[0][:, :most])))
        for (i, _, _), s in zip(some, best.tolist()):
            out[i] = max(out[i], s)
    return out


KERNELS = "struct<name_ratio:double,name_token_sort:double,name_token_set:double,name_partial:double,name_nospace:double,addr_ratio:double,addr_token_set:double,addr_partial:double>"


@functools.lru_cache(maxsize=1)
def _kernels():
    @F.arrow_udf(KERNELS)
    def kernels(n1: pa.Array, a1: pa.Array, n2: pa.Array, a2: pa.Array) -> pa.Array:
        n1, a1, n2, a2 = ([x or "" for x in c.to_pylist()] for c in (n1, a1, n2, a2))
        plain = lambda c: [x.replace(" ", "") for x in c]
        values = [ratios(n1, n2), token_sort_ratios(n1, n2), token_set_ratios(n1, n2), partial_ratios(n1, n2), ratios(plain(n1), plain(n2)), ratios(a1, a2), token_set_ratios(a1, a2), partial_ratios(a1, a2)]
        names = [x.split(":")[0] for x in KERNELS[7:-1].split(",")]
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in values], names)

    return kernels


def pair_kernels(name1: Column, address1: Column, name2: Column, address2: Column) -> Column:
    """All ratio features of a pair as one struct (features 10 to 14 and 19 to 21)."""
    return _kernels()(name1, address1, name2, address2)


def _udf_of(function):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(function([x or "" for x in a.to_pylist()], [x or "" for x in b.to_pylist()]), pa.float64())

    return run


def ratio(a: Column, b: Column) -> Column:
    """F1."""
    return _udf_of(ratios)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """F2."""
    return _udf_of(token_sort_ratios)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """F3."""
    return _udf_of(token_set_ratios)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    """F4."""
    return _udf_of(partial_ratios)(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """F5 of two arrays: shared by total distinct items; -1 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def digit_runs(address: Column) -> Column:
    """Digit runs of an address in order."""
    return F.regexp_extract_all(address, F.lit("[0-9]+"), F.lit(0))


def postal(runs: Column) -> Column:
    """the last digit run of five or six digits; null if there is none."""
    return F.get(F.reverse(F.filter(runs, lambda r: F.length(r).isin(5, 6))), F.lit(0))


def house(runs: Column) -> Column:
    """the first digit run that differs from the postal code, its first 15 digits as a number; null if there is none."""
    code = postal(runs)
    return F.substring(F.get(F.filter(runs, lambda r: code.isNull() | (r != code)), F.lit(0)), 1, 15).cast("long")


def distinct_words(c: Column) -> Column:
    """Distinct words of a normalized text."""
    return F.array_distinct(words_of(c))
