"""Cuts of a text at places where byte-level pre-tokenization is sure to start anew."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GAPS = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> list[str]:
    """Pieces of text, each but the first starting at a space between two non-spaces.

    No pre-token of the byte-level pattern crosses such a place: its letter, digit and sign classes hold no white
    space, its white-space runs start at white space, and a run is looked beyond only at its own end. So the tokens of
    a text are those of its pieces, one after another. Python counts at least as many characters as white space as the
    pattern does, so no cut is made where the pattern would see a longer run.
    """
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or _GAPS.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


#: White space that any of the parties may see (fixed by Unicode, and four separators that only Python counts).
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that have white space side by side or at an end.
GAPPED = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$"
#: Words of Latin letters with one sign after them at most: two pre-tokens, or one.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ɏ]+[.,]?$"


class Cut:
    """Distinct pieces of plain texts: those without gaps, special strings, matches of also, or nothing in them.

    plain: which texts are; of the i-th plain one, index[bounds[i]:bounds[i + 1]] are its pieces. Pieces below
    len(words) are a space and a word, the others are first words, which no space precedes.
    """

    def __init__(self, texts: pa.Array, special: list[str], also: str | None = None):
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, GAPPED))
        if also:
            odd = pc.or_(odd, pc.match_substring_regex(texts, also))
        for s in special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        self.plain = ~odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(self.plain)), " ")
        flat = lists.flatten().dictionary_encode()
        self.words = flat.dictionary
        self.bounds = lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
        self.index = flat.indices.to_numpy().astype(np.int32)
        at = self.bounds[:-1]
        first, place = np.unique(self.index[at], return_inverse=True)
        self.firsts = self.words.take(pa.array(first))
        self.index[at] = place + len(self.words)

    def entries(self, spaced: Callable[[list[str]], list], bare: Callable[[list[str]], list]) -> list:
        """What the functions give for each piece; words of letters with a sign are asked for as two."""
        letters = pc.match_substring_regex(self.words, LETTERS)
        some = self.words.filter(letters)
        stems = pc.replace_substring_regex(some, "[.,]$", "").dictionary_encode()
        of_stem = spaced(stems.dictionary.to_pylist())
        signs = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(some, -1), value_set=pa.array([",", "."])), 2).to_pylist()
        both = bare([",", "."])
        of_sign = [*both, type(both[0])()]
        out = np.empty(len(self.words), object)
        mask = letters.to_numpy(zero_copy_only=False)
        made = np.empty(len(some), object)
        made[:] = [of_stem[i] + of_sign[j] for i, j in zip(stems.indices.to_pylist(), signs)]
        out[mask] = made
        rest = np.empty(int((~mask).sum()), object)
        rest[:] = spaced(self.words.filter(pc.invert(letters)).to_pylist())
        out[~mask] = rest
        return out.tolist() + bare(self.firsts.to_pylist())


class Known:
    """A cache of bounded size for what a function gives for distinct strings."""

    def __init__(self, how: Callable[[list[str]], Iterable[tuple[str, object]]], limit: int):
        self.how, self.limit, self.held = how, limit, {}

    def __call__(self, strings: list[str]) -> list:
        lacking = [s for s in strings if s not in self.held]
        if len(self.held) + len(lacking) > self.limit:  # what is asked for now stays
            self.held = {s: self.held[s] for s in strings if s in self.held}
        self.held.update(self.how(lacking))
        return list(map(self.held.__getitem__, strings))
