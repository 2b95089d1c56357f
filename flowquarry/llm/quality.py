"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are fixed counts and shares; trees are grown on their
histograms and kept as flat arrays (a feature and a threshold per inner node, a
value per leaf), which numpy walks for many documents at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, held_out, map_batches, staged

#: Labelled rows the trees are fitted on, at most: the rows of least key hash.
SAMPLE = 50_000
TREES, DEPTH, RATE, BINS, PENALTY = 80, 4, 0.15, 64, 1.0

FEATURES = (
    "chars", "words", "word_length", "long_words", "distinct_words", "commonest_word", "commonest_pair", "lines", "line_words",
    "repeated_lines", "short_lines", "ended_lines", "letters", "digits", "marks", "symbols", "spaces", "upper", "not_ascii",
    "controls", "longest_word", "upper_words", "symbol_words", "compression",
)

_KIND = np.zeros(128, np.uint8)  # of ASCII: 1 letter, 2 digit, 3 mark of prose, 4 other symbol, 5 space, 6 control
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.isalpha() else 2 if _s.isdigit() else 5 if _s in " \t\n\r\v\f" else 6 if _c < 32 or _c == 127 else 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_SYMBOL = set("#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str | None) -> list[float]:
    """``FEATURES`` of a whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(text)
    ascii_ = data[data < 128]
    kinds = np.bincount(_KIND[ascii_], minlength=7)
    upper = int(np.count_nonzero((ascii_ >= 65) & (ascii_ <= 90)))
    words = text.split()
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    w, k = max(len(words), 1), max(len(lines), 1)
    counts, repeated = Counter(words), Counter(lines)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 14).mean()) if len(words) else 0.0, len(counts) / w, max(counts.values(), default=0) / w,
        max(pairs.values(), default=0) / w, np.log1p(len(lines)), len(words) / k,
        1 - len(repeated) / k if lines else 0.0, sum(len(x) < 30 for x in lines) / k,
        sum(x[-1] in ".!?\"'" for x in lines) / k, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        upper / n, (n - len(ascii_)) / n, kinds[6] / n, np.log1p(int(lengths.max(initial=0))),
        sum(x.isupper() and len(x) > 1 for x in words) / w, sum(x[-1] in _SYMBOL for x in words) / w,
        len(zlib.compress(data.tobytes(), 1)) / len(data),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row; one pass, nothing shuffled."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, features array<double>")


@dataclass(frozen=True)
class Forest:
    """Boosted trees of equal depth as flat arrays: node k has the children 2k + 1 (not above the threshold) and 2k + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of statistics."""
        margin = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:  # all rows are at the same depth
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Fit boosted trees with logistic loss on histograms of ``BINS`` bins a feature.

    Labels of one kind, or none at all, give a forest without trees: their smoothed share.
    """
    n, width = len(rows), len(FEATURES)
    share = (labels.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not n or labels.min() == labels.max():
        return Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], "left") for f in range(width)], axis=1)
    margin = np.full(n, base)
    feature, threshold, value = (np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                at = (node - first) * BINS + binned[:, f]
                g = np.bincount(at, grad, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(at, hess, count * BINS).reshape(count, BINS).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + PENALTY) + (gt - g) ** 2 / (ht - h + PENALTY) - gt**2 / (ht + PENALTY)
                gain = gain[:, : len(cuts[f])]
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                for i in np.flatnonzero(top > best).tolist():
                    best[i], feature[t, first + i], threshold[t, first + i] = top[i], f, cuts[f][k[i]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value[t] = -rate * g / (h + PENALTY)
        margin += value[t, leaf]
    return Forest(base, feature, threshold, value)


def fit(found: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Trees from ``doc_id, features`` and the labels of the same documents.

    The fit sees at most ``sample`` labelled rows, those whose doc_id has the least
    hash: a documented bound, so it runs on the driver. Null labels and labels of
    unknown documents are left out; a document with several label rows counts as often.
    """
    marked = labels.where(f"doc_id is not null and {label} is not null").select("doc_id", F.col(label).cast("int").alias("label"))
    least = marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(sample)
    rows = least.join(found.where("doc_id is not null"), "doc_id").select("h", "doc_id", "label", "features").collect()
    rows.sort(key=lambda r: (r.h, r.doc_id, r.label, r.features))
    return grow(np.array([r.features for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label > 0 for r in rows], float))


def score(found: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every row of ``doc_id, features``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(rows))], names=["doc_id", "score"])

    bounded(found.sparkSession)
    return map_batches(found.select("doc_id", "features"), work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, least: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, learnt from labels of documents not held out.

    The score depends on the text alone. Null and empty texts have zero statistics
    and a score like any other; repeated rows get equal scores; rows without doc_id
    are scored and never learnt from; extra columns are ignored; without labels the
    score is one half for every document.
    """
    found = staged(features(docs), "statistics")
    forest = fit(found, labels.where(~held_out(F.col("doc_id"), modulus)))
    out = score(found, forest)
    return out.select(
        "doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
