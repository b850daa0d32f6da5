"""Normalization of names and addresses as column expressions.

Everything but to_ascii stays in the JVM and in whole-stage code generation.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


@functools.lru_cache(maxsize=1 << 16)
def _letter(c: str) -> str:
    """A character that doesn't decompose, spelled by its Unicode name: letters of Indian scripts, Cyrillic and Greek, and digits."""
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    script, _, rest = unicodedata.name(c, "").partition(" ")
    letter = rest.rpartition("LETTER ")[2].rpartition("VOWEL SIGN ")[2]
    if script in tables.INDIAN_SCRIPTS:
        if "LETTER " not in rest and "VOWEL SIGN " not in rest:
            return tables.INDIAN_SIGNS.get(rest.rpartition("SIGN ")[2], "")
        # consonants lose the vowel of their name; doubled letters mark length or place and count once
        letter = letter.split(" ")[-1].lower()
        bare = letter[:-1] if letter.endswith("a") and letter.strip("aeiou") else letter
        out = re.sub(r"(.)\1+", r"\1", bare)
    elif script == "CYRILLIC":
        letter = letter.lower()
        out = tables.CYRILLIC_VOWELS.get(letter)
        if out is None:
            out = re.sub("[aeiou]", "", letter) if " " not in letter else ""
    elif script == "GREEK":
        letter = letter.split(" WITH ")[0].removeprefix("FINAL ").lower()
        out = tables.GREEK_LETTERS.get(letter, letter[:1])
    else:
        return ""
    return out.title() if "CAPITAL" in rest else out


def spell_ascii(x: str) -> str:
    """x in ASCII: what Unicode decomposes by its base letters, other known letters by their names, the rest goes."""
    if x.isascii():
        return x
    return "".join(c if c.isascii() else "" if 0x300 <= ord(c) < 0x370 else _letter(c) for c in unicodedata.normalize("NFKD", x))


@functools.lru_cache(maxsize=1)
def _to_ascii():
    @F.arrow_udf("string")
    def to_ascii(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else spell_ascii(x) for x in texts.to_pylist()], pa.string())

    return to_ascii


def to_ascii(c: Column) -> Column:
    """Letters spelled in ASCII (spell_ascii). The one step that needs Python (Arrow)."""
    return _to_ascii()(c)


def drop_aliases(c: Column) -> Column:
    """N3: "also known as" marks (a.k.a. written with or without slashes)."""
    return F.regexp_replace(c, tables.ALIAS, " ")


def collapse_acronyms(c: Column) -> Column:
    """Dots of acronyms go (u.s.a. becomes usa), letter after letter from where the last one ended."""
    return F.regexp_replace(c, r"(?:\G(?!^)|\b(?=(?:[a-z]\.){2,}(?!\w)))([a-z])\.", "$1")


def spell_ampersand(c: Column) -> Column:
    """N5."""
    return F.replace(c, F.lit("&"), F.lit(" and "))


def split_joined(c: Column) -> Column:
    """A hyphen or slash between letters parts words."""
    return F.regexp_replace(c, r"(?<=[a-z])[-/](?=[a-z])", " ")


def drop_punctuation(c: Column) -> Column:
    """Only lower-case letters, digits, hyphens, slashes and spaces stay."""
    return F.regexp_replace(c, r"[^a-z0-9/\- ]", " ")


def prune_stray(c: Column) -> Column:
    """Hyphens and slashes stay only beside a digit."""
    return F.regexp_replace(c, r"(?<![0-9])[-/](?![0-9])", " ")


def shorten_phrases(c: Column) -> Column:
    """Phrases of several words to their short form, in order."""
    return functools.reduce(lambda x, p: F.regexp_replace(x, rf"\b{p[0]}\b", p[1]), tables.PHRASES, c)


def split_words(c: Column) -> Column:
    """Words without hyphens and slashes at their ends; empty ones go."""
    return F.filter(F.transform(F.split(F.trim(c), " +"), lambda t: F.regexp_replace(t, r"^[-/]+|[-/]+$", "")), lambda t: t != "")


def strip_zeros(t: Column) -> Column:
    """Leading zeros of a word of digits go; a word of zeros is 0."""
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)


def is_ordinal(t: Column) -> Column:
    """N13."""
    return t.rlike(tables.ORDINAL)


def undo_leet(t: Column) -> Column:
    """Digits that stand for letters, in words of three letters or more that outnumber their digits, ordinals aside."""
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(t, "[^a-z]", ""))
    return F.when((digits > 0) & (letters >= 3) & (letters > digits) & ~is_ordinal(t), F.translate(t, tables.LEET_FROM, tables.LEET_TO)).otherwise(t)


def base_words(c: Column, ascii_only: bool = False) -> Column:
    """Clean words of a raw text; null counts as empty. ascii_only leaves N1 out where the input is known to be ASCII."""
    c = F.coalesce(c, F.lit(""))
    steps = [F.lower, drop_aliases, collapse_acronyms, spell_ampersand, split_joined, drop_punctuation, prune_stray, shorten_phrases]
    c = functools.reduce(lambda x, f: f(x), steps, c if ascii_only else to_ascii(c))
    return F.transform(split_words(c), lambda t: undo_leet(strip_zeros(t)))


def _words_literal(words) -> Column:
    return F.array(*[F.lit(x) for x in words])


def _mapped(table: dict[str, str], t: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), t), t)


def name_words(words: Column) -> Column:
    """N14 on clean words: legal forms and "and" go, unless nothing else is left."""
    core = F.filter(words, lambda t: ~F.array_contains(_words_literal([*tables.LEGAL_WORDS, "and"]), t))
    return F.when(F.size(core) > 0, core).otherwise(words)


def expand_address_word(t: Column) -> Column:
    """N15."""
    return _mapped(tables.ADDRESS_WORDS, t)


def shorten_state(t: Column) -> Column:
    """N16."""
    return _mapped(tables.STATES, t)


def address_words(words: Column) -> Column:
    """N15 to N17 on clean words: spelt out, states shortened, then filler dropped; may become empty."""
    return F.filter(F.transform(words, lambda t: shorten_state(expand_address_word(t))), lambda t: ~F.array_contains(_words_literal(tables.ADDRESS_FILLER), t))


def normalize_name(c: Column, ascii_only: bool = False) -> Column:
    """N14."""
    return F.array_join(name_words(base_words(c, ascii_only)), " ")


def normalize_address(c: Column, ascii_only: bool = False) -> Column:
    """N18."""
    return F.array_join(address_words(base_words(c, ascii_only)), " ")


def words_of(c: Column) -> Column:
    """Words of a normalized text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def number_parts(address: Column) -> Column:
    """Digit runs of two or more within words that aren't digits alone."""
    compound = F.filter(words_of(address), lambda t: ~t.rlike("^[0-9]+$"))
    return F.flatten(F.transform(compound, lambda t: F.filter(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r) >= 2)))


def block_text(name: Column, address: Column) -> Column:
    """Name, address and number parts by single spaces (also where one is empty, as the pieces are joined as they are)."""
    return F.array_join(F.concat(F.array(name, address), number_parts(address)), " ")


def add_normalized(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds name_n, addr_n and block_text to business_name and business_address.

    The normalized pair is computed once per row, below the columns made of it.
    """
    held = df.withColumn("name_n", normalize_name(F.col("business_name"), ascii_only)).withColumn("addr_n", normalize_address(F.col("business_address"), ascii_only))
    return held.withColumn("block_text", block_text(F.col("name_n"), F.col("addr_n")))


def word_pairs(words: Column) -> Column:
    """B1 on words: each two neighbours joined by an underscore."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda x, y: F.concat(x, F.lit("_"), y))).otherwise(F.array().cast("array<string>"))


def search_terms(block: Column, name: Column, address: Column) -> Column:
    """B1: terms of the block text, and word pairs within the name and within the address."""
    return F.concat(words_of(block), word_pairs(words_of(name)), word_pairs(words_of(address)))


def address_terms(address: Column) -> Column:
    """Terms of an address alone: its words, number parts and word pairs."""
    return F.concat(words_of(address), number_parts(address), word_pairs(words_of(address)))
