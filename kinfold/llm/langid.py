"""Language ID (operator 8) by hyperdimensional profiles.

Each letter class has a random +-1 vector of DIM components (class 0: any run of non-letters, a word's edge). The
vector of a letter triple is the product of the first letter's vector permuted twice, the second's permuted once and
the third's. A text's vector is the sum (bundle) of its triples' vectors, times their counts; a language's prototype is
the sum over its training texts. Documents are compared with the prototypes by cosine, which is the score.

The letter classes are a bounded alphabet: a to z, and other letters dealt over the remaining classes by a fixed rule,
so scripts with many letters share classes. Languages may be many: training keeps triple counts by language, of which
one language has at most PROFILE, and the model is DIM numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices

DIM, SEED = 1024, 20_240
CLASSES = 64
PROFILE = CLASSES**3
UNKNOWN = "und"
#: Bytes of text whose triples are held at a time; they take some forty times that.
SLICE = 2 << 20
#: Documents, and distinct triples, of a product of counts and vectors.
DOCS, STEP = 1024, 4096


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter class of each code point below 65536; those beyond follow class_of_rare."""
    out = np.zeros(65536, np.uint8)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 % (CLASSES - 27)
    return out


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter triples of all texts, one after another, and where each text's start (length + 1)."""
    codes = [np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(x) for x in codes], np.int64)
    code = np.concatenate(codes) if codes else np.zeros(0, "<u4")
    cls = classes()[np.minimum(code, 65535)].astype(np.uint32)
    if len(rare := np.flatnonzero(code > 65535)):
        cls[rare] = [27 + int(x) * 2654435761 % 2**32 % (CLASSES - 27) if chr(x).isalpha() else 0 for x in code[rare]]
    doc = np.repeat(np.arange(len(texts)), sizes)
    # one edge for each run of non-letters
    keep = (cls > 0) | np.r_[True, (cls[:-1] > 0) | (doc[1:] != doc[:-1])] if len(cls) else np.zeros(0, bool)
    cls, doc = cls[keep], doc[keep]
    tri = cls[:-2] << 12 | cls[1:-1] << 6 | cls[2:]
    same = doc[:-2] == doc[2:]
    return tri[same], np.searchsorted(doc[:-2][same], np.arange(len(texts) + 1))


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of all classes as first, second and third letter of a triple."""
    last = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM), dtype=np.int8) * 2 - 1
    return np.roll(last, 2, 1), np.roll(last, 1, 1), last


def vectors(tri: np.ndarray) -> np.ndarray:
    """Vectors of triples, one row each."""
    first, second, third = letters()
    return (first[tri >> 12] * second[tri >> 6 & 63] * third[tri & 63]).astype(np.float32)


def bundles(doc: np.ndarray, tri: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Sums of times * vector over the entries (doc, tri, times) of each of n documents, no entry twice."""
    out = np.zeros((n, DIM), np.float32)
    used, column = np.unique(tri, return_inverse=True)
    order = np.argsort(column, kind="stable")
    doc, column, times = doc[order], column[order], times[order]
    for i in range(0, len(used), STEP):
        a, b = np.searchsorted(column, [i, i + STEP])
        dense = np.zeros((n, min(STEP, len(used) - i)), np.float32)
        dense[doc[a:b], column[a:b] - i] = times[a:b]
        out += dense @ vectors(used[i : i + STEP])
    return out


def counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, tri, n): letter triples of all training texts by language, summed slice by slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            langs, of = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            tri, at = triples(batch.column("text").to_pylist())
            key, n = np.unique(np.repeat(of.astype(np.int64), np.diff(at)) << 18 | tri, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(key >> 18)), pa.array((key & PROFILE - 1).astype(np.int32)), pa.array(n)], ["lang", "tri", "n"])

    source = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    return source.mapInArrow(run, "lang string, tri int, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """languages, and the prototype of each, scaled to length 1."""

    languages: list[str]
    prototypes: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the cosine, not under 0) and number of triples of each text; und and 0 without letters or languages."""
        tri, at = triples([x or "" for x in texts])
        names, scores, size = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.diff(at)
        # the lone edge of a text without letters gives no triple
        some = np.flatnonzero(size > 0)
        for i in range(0, len(some) if self.languages else 0, DOCS):
            mine = some[i : i + DOCS]
            part = tri[at[mine[0]] : at[mine[-1] + 1]]
            key, times = np.unique(np.repeat(np.arange(len(mine)), size[mine]) << 18 | part, return_counts=True)
            bundle = bundles(key >> 18, key & PROFILE - 1, times, len(mine)).astype(np.float64)
            length = np.sqrt((bundle * bundle).sum(1))
            cosine = bundle @ self.prototypes.T / np.where(length > 0, length, 1)[:, None]
            scores[mine] = np.clip(cosine.max(1), 0, 1)
            for k, b in zip(mine.tolist(), cosine.argmax(1).tolist()):
                names[k] = self.languages[b]
        return names, scores, size


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn prototypes from all rows with a language and a text.

    A language's counts (PROFILE rows at most, whatever the input) make its prototype in one task; only the prototypes,
    DIM numbers a language, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            of, tri, n = langs.indices.to_numpy(), batch.column("tri").to_numpy().astype(np.int64), batch.column("n").to_numpy().astype(np.float64)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for i in range(0, len(mine := np.flatnonzero(of == k)), STEP):
                    held[lang] = held.get(lang, 0) + n[mine[i : i + STEP]] @ vectors(tri[mine[i : i + STEP]]).astype(np.float64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["lang", "prototype"])

    # sums of whole numbers under 2^53: the order of rows can't change them
    rows = counts(df, lang_col, text_col).repartition("lang").mapInArrow(run, "lang string, prototype array<double>").collect()
    rows.sort(key=lambda r: r.lang)
    prototypes = np.array([r.prototype for r in rows], np.float64).reshape(len(rows), DIM)
    return Model([r.lang for r in rows], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12))


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "n_triples")) -> DataFrame:
    """The kept columns with language, score and number of letter triples of every row, under the given names.

    The text is the only input of a prediction. Null texts and texts without letters give und, 0 and 0.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, n long")
    def told(texts: pa.Array) -> pa.Array:
        parts = []
        for batch in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", SLICE):
            langs, scores, size = held.value.predict(batch.column("text").to_pylist())
            parts.append(pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(size.astype(np.int64))], ["lang", "score", "n"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("n", pa.int64())]))

    own = fresh("told", keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], told(F.col(f"`{text_col}`").cast("string")).alias(own))
    return source.select(*[F.col(f"`{c}`") for c in keep], *[F.col(own)[x].alias(name) for x, name in zip(("lang", "score", "n"), names)])


def held_out(df: DataFrame) -> DataFrame:
    """df with held_out: whether crc32 of the doc_id as text leaves 1 when divided by 3 (a null id: not)."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from those not held out.

    Null texts and texts without letters give und and 0; repeated rows give equal rows; an empty table, or one without
    labels, gives no languages and und everywhere; other columns are not looked at.
    """
    marked = held_out(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = fit(marked.where(~F.col("held_out")))
    return predict(marked, model, keep=("doc_id", "held_out"))
