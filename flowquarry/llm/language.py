"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with
its code point. The vector of an n-gram binds (multiplies) the letter vectors,
each permuted (rotated) by its place; the vector of a document bundles (adds)
those of its n-grams. A language's prototype bundles the unit vectors of its
training documents, and a document has the language of nearest cosine.

Whether that language is known at all is judged by the mean of its n-grams' products
with the language's mean document, which does not depend on the length of a text: it
is near zero for random letters and low for a language not learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, unused

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
#: A text is like its language unless it is less typical than this share of the training documents and than half their mean.
RARE = 0.01
#: Letters a text needs to be judged; a shorter one stays.
SHORTEST = 8
#: Characters bundled at once, and n-gram vectors a worker keeps (4 KB each).
CHARS_AT_ONCE = 400_000
VECTORS_KEPT = 20_000

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


@lru_cache(maxsize=4096)
def _letter(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([dimensions, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def gram_vector(gram: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bound vector of an n-gram given as its code points in base 2^21; 0 stands for a border of letters."""
    found = _vectors.get(gram)
    if found is None or len(found) != dimensions:
        found = np.ones(dimensions, np.float32)
        rest = gram
        for place in range(GRAM):  # the last letter first
            found = found * np.roll(_letter(rest & 0x1FFFFF, dimensions), place)
            rest >>= 21
        if len(_vectors) >= VECTORS_KEPT:
            _vectors.clear()
        _vectors[gram] = found = found.astype(np.float32)
    return found


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of every n-gram with a letter in its middle, over several texts."""
    docs, grams = [], []
    for number, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
        letter = _is_letter(codes)
        codes = np.where(letter, codes, 0)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one border after each run of letters
        codes = np.concatenate(([0], codes[keep], [0]))
        middle = np.flatnonzero(codes[1:-1])
        grams.append((codes[middle] << 42) | (codes[middle + 1] << 21) | codes[middle + 2])
        docs.append(np.full(len(middle), number))
    return np.concatenate(docs), np.concatenate(grams)


def document_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bundled vectors of texts, one row each; all zero for a text without letters."""
    return _bundles(texts, dimensions)[0]


def _bundles(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of texts, and the number of n-grams in each."""
    out, sizes = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last]) <= CHARS_AT_ONCE):
            chars += len(texts[last])
            last += 1
        docs, grams = _grams(texts[first:last])
        sizes[first:last] = np.bincount(docs, minlength=last - first)
        if len(grams):
            distinct, place = _distinct(grams)
            counts = np.bincount(docs * len(distinct) + place, minlength=(last - first) * len(distinct))
            counts = counts.reshape(last - first, len(distinct)).astype(np.float32)
            for i in range(0, len(distinct), 4096):
                part = np.stack([gram_vector(g, dimensions) for g in distinct[i : i + 4096].tolist()])
                out[first:last] += counts[:, i : i + 4096] @ part
        first = last
    return out, sizes


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by counting where few letters occur."""
    present = np.flatnonzero(np.bincount(grams & 0x1FFFFF))
    present = np.union1d(present, np.flatnonzero(np.bincount((grams >> 21) & 0x1FFFFF)))
    present = np.union1d(present, np.flatnonzero(np.bincount(grams >> 42)))
    n = len(present)
    if n > 160:
        return np.unique(grams, return_inverse=True)
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[present] = np.arange(n)
    small = (number[grams >> 42] * n + number[(grams >> 21) & 0x1FFFFF]) * n + number[grams & 0x1FFFFF]
    used = np.flatnonzero(np.bincount(small, minlength=n**3))
    place = np.zeros(n**3, np.int64)
    place[used] = np.arange(len(used))
    whole = (present[used // (n * n)] << 42) | (present[used // n % n] << 21) | present[used % n]
    return whole, place[small]


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: unit vectors about the mean document, in order of the language name."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    centre: np.ndarray
    means: np.ndarray  # unit vectors of the mean documents themselves
    floors: np.ndarray  # least typicality of a known text, per language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Nearest language and a score from 0 to 1: half of one plus the cosine to its prototype.

        A text unlike the documents its language was learnt from has a score below one half:
        half the share of its floor that it reaches.
        """
        vectors, sizes = _bundles([t or "" for t in texts], len(self.centre))
        empty = ~vectors.any(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = _unit(_unit(vectors) - self.centre) @ self.prototypes.T
        best = cosines.argmax(axis=1)
        score = np.clip((1 + cosines[np.arange(len(texts)), best].astype(np.float64)) / 2, 0, 1)
        names = [UNKNOWN if e else self.languages[b] for e, b in zip(empty.tolist(), best.tolist(), strict=True)]
        typical, floor = self.typical(vectors, sizes, best), self.floors[best]
        unlike = (sizes >= SHORTEST) & (typical < floor)
        share = np.divide(typical, floor, out=np.zeros(len(texts)), where=unlike & (floor > 0))
        score = np.where(unlike, np.minimum(score, np.maximum(share, 0) / 2), score)
        return names, np.where(empty, 0.0, score)

    def typical(self, vectors: np.ndarray, sizes: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Mean product of a text's n-grams with the mean document of one language (by number) each."""
        products = np.einsum("ij,ij->i", vectors, self.means[language], dtype=np.float64)
        return products / (np.maximum(sizes, 1) * np.sqrt(vectors.shape[1]))


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, floors: bool = True) -> Profiles:
    """Prototypes from every row of ``docs`` with letters and a non-null ``lang``.

    Each task adds up unit vectors per language; one row per task, language and
    block of components is shuffled, and the driver receives one vector a
    language. A table without such rows gives profiles that know no language.
    With ``floors`` a second pass over the same rows learns how typical they are;
    without, every text with letters counts as known.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            vectors = _unit(document_vectors(batch.column(1).to_pylist(), dimensions))
            for name in sorted(set(lang)):
                rows = vectors[[i for i, x in enumerate(lang) if x == name]]
                sums[name] = sums.get(name, 0) + rows.sum(axis=0, dtype=np.float64)
                counts[name] = counts.get(name, 0) + int(rows.any(axis=1).sum())
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(total),
                    pa.array([counts[name]] * dimensions, pa.int64()),
                ],
                names=["lang", "place", "total", "docs"],
            )

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, place int, total double, docs long").groupBy("lang", "place")
    whole = sums.agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).groupBy("lang", "docs")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("parts")).where("docs > 0")
    found = sorted(whole.collect(), key=lambda r: r["lang"])  # a vector a language
    if not found:
        none = np.zeros((0, dimensions), np.float32)
        return Profiles((), none, np.zeros(dimensions, np.float32), none, np.zeros(0))
    means = np.array([[p["total"] for p in r["parts"]] for r in found]) / np.array([[r["docs"]] for r in found])
    # Rounded, so that the order in which tasks finish does not show.
    centre = (means.mean(axis=0) if len(found) > 1 else np.zeros(dimensions)).round(9)
    learnt = Profiles(
        tuple(r["lang"] for r in found), _unit((means - centre).round(9)).astype(np.float32), centre.astype(np.float32),
        _unit(means.round(9)).astype(np.float32), np.full(len(found), -np.inf),
    )
    return replace(learnt, floors=_floors(rows, learnt)) if floors else learnt


def _floors(rows: DataFrame, learnt: Profiles) -> np.ndarray:
    """Least typicality per language, from all of its training documents that are long enough to be judged."""
    number = {name: i for i, name in enumerate(learnt.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, sizes = _bundles(batch.column(1).to_pylist(), len(learnt.centre))
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            use = (sizes >= SHORTEST) & (own >= 0)
            found = learnt.typical(vectors[use], sizes[use], own[use])
            yield pa.RecordBatch.from_arrays([pa.array(own[use]), pa.array(found)], names=["own", "typical"])

    rated = rows.mapInArrow(run, "own long, typical double").groupBy("own")
    floors = np.full(len(number), -np.inf)
    for r in rated.agg(F.percentile_approx("typical", RARE).alias("rare"), F.avg("typical").alias("mean")).collect():  # a row a language
        floors[r["own"]] = round(min(r["rare"], r["mean"] / 2), 9)
    return floors


def detect(profiles: Profiles, text: Column) -> Column:
    """Struct ``lang_pred, score`` of a text column: ``und`` and 0 for a null text or one without letters."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts):
        import pandas as pd

        names, score = profiles.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": score})

    return predicted(text.cast("string"))


def keep_known(docs: DataFrame, profiles: Profiles, least: float = 0.5) -> DataFrame:
    """Rows whose language is known: not ``und``, and a score of at least ``least``.

    One half is where texts begin that are like the documents their language was learnt
    from; one of fewer than ``SHORTEST`` letters cannot be judged by that and stays.
    """
    bounded(docs.sparkSession)
    name = unused("found", docs.columns)
    found = docs.withColumn(name, detect(profiles, F.col("text")))
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*docs.columns)
