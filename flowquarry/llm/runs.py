"""Periodic runs: stretches of words that repeat with a period, found by branching tandem repeats.

A run of period q that ends before word e holds the square of two equal halves of
q words that ends at e. The suffixes at both halves share exactly q words, so they
part in the interval of the suffix array whose depth is q, and one of them lies
outside that interval's largest child. So for each interval the suffixes of its
smaller children alone are tried: is the suffix ``depth`` words later, or earlier,
in the interval too? Each square found is rotated to the left while it stays one,
which gives the whole run; runs over the same words keep the smallest period.

No tree is built: intervals and their children come from the common-prefix array.
Documents are independent, nothing is shuffled, and a task holds some documents
of at most ``WORDS`` words together, or a single longer one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, unused
from flowquarry.llm.suffixes import Suffixes, intervals, ranges, smaller_children

#: Least words of a run, beside twice its period.
LEAST = 12
#: Words that are searched at once.
WORDS = 400_000

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _stretches(ids: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, symbols and groups of the only words that can be in a run.

    Each word of a run occurs in it twice. So a word that occurs once in its
    document ends every run, and what lies between such words is looked at by
    itself, until nothing is left to cut. Groups are whole numbers that grow.
    """
    place = np.arange(len(ids))
    while True:
        group = np.unique(group, return_inverse=True)[1] if len(group) else group
        _, symbols, count = np.unique(group * np.int64(len(ids) + 1) + ids, return_inverse=True, return_counts=True)
        kept = count[symbols] > 1
        place, ids, group, symbols = place[kept], ids[kept], group[kept], symbols[kept]
        parts = np.append(True, (place[1:] != place[:-1] + 1) | (group[1:] != group[:-1]))[: len(place)]
        stretch = np.cumsum(parts) - 1
        long = np.bincount(stretch)[stretch] >= least if len(stretch) else kept[:0]
        if kept.all() and long.all() and (stretch == group).all():
            return place, symbols, group
        place, ids, group = place[long], ids[long], stretch[long]


def find(documents: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    sizes = np.array([len(words) for words in documents], np.int64)
    offset = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.int64)
    for words, begin in zip(documents, offset.tolist(), strict=True):
        # The first place of a word stands for it.
        ids[begin : begin + len(words)] = [*map({}.setdefault, words, range(len(words)))]
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place, symbols, group = _stretches(ids, owner, least)
    if not len(place):
        return found
    # Every stretch ends with a symbol of its own; the first one also begins with one.
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    text = np.insert(symbols, ends, symbols.max() + 1 + np.arange(len(ends)))
    origin = np.insert(place, ends, -1)
    suffixes = Suffixes(text)
    start, length, period = _runs(suffixes)
    good = length >= np.maximum(least, 2 * period)
    begin = origin[start[good]]
    doc = owner[begin]
    rows = zip(doc.tolist(), (begin - offset[doc]).tolist(), length[good].tolist(), period[good].tolist(), strict=True)
    for doc, *run in sorted(rows):
        found[doc].append(tuple(run))
    for i, runs in enumerate(found):
        if len(runs) > 1:
            least_period = {}
            for run in runs:  # periods ascend for equal start and length
                least_period.setdefault(run[:2], run)
            found[i] = sorted(least_period.values(), key=lambda r: (r[0], r[2]))
    return found


def _runs(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every maximal periodic stretch, multiples of periods included."""
    text, n = suffixes.symbols, len(suffixes.symbols)
    depth, first, last, begin, end = intervals(suffixes.common())
    small = smaller_children(first, last, begin, end)
    depth, first, last, begin, end = (x[small] for x in (depth, first, last, begin, end))
    at, owner = ranges(begin, end - begin + 1)
    at, depth, first, last = suffixes.order[at], depth[owner], first[owner], last[owner]
    squares = []
    for left in (at, at - depth):  # the suffix is the first half of a square, or the second
        right = left + depth
        other = right if left is at else left
        inside = (other >= 0) & (other < n)
        where = suffixes.place[other * inside]
        inside &= (first <= where) & (where <= last)
        x, d = left[inside], depth[inside]
        # Branching: the words after both halves differ. Both are inside, as ends of stretches are symbols of their own.
        parts = text[x + d] != text[x + 2 * d]
        squares.append((x[parts], d[parts]))
    x, period = (np.concatenate(part) for part in zip(*squares, strict=True))
    pairs = np.unique(np.stack((x, period)), axis=1) if len(x) else np.empty((2, 0), np.int64)
    x, period = pairs
    turned = suffixes.back(x, x + period)
    return x - turned, turned + 2 * period, period


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str | Column = "text", least: int = LEAST) -> DataFrame:
    """Every row with ``runs.found`` (start, length, period; words counted from 0) and ``runs.collapsed`` (text).

    Words are what ASCII white space separates; case counts. A run is a stretch
    of words with smallest period q, of ``least`` words and twice q or more, that
    no neighbouring word extends. ``collapsed`` joins the words that no run holds
    after its first q words with single spaces. All columns of ``docs`` stay as
    they are, whatever their names; if one is called ``runs``, the new column is
    ``runs_``. A null or empty text, and one of white space alone, has no runs
    and collapses to an empty text. Texts of any length are searched whole;
    repeated rows, null or repeated ids and ties give a row each; an empty table
    gives an empty one. Nothing is shuffled.
    """
    spark = docs.sparkSession
    bounded(spark)
    name = unused("runs", docs.columns)
    find_runs = _finder(least)
    return docs.withColumn(name, find_runs(F.col(text) if isinstance(text, str) else text))


def _finder(least: int):
    @F.arrow_udf(f"struct<found: array<{RUN}>, collapsed: string>")
    def find_runs(texts: pa.Array) -> pa.Array:
        found, kept, part, size = [], [], [], 0

        def search() -> None:
            for words, runs in zip(part, find(part, least), strict=True):
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept.append(b" ".join(collapsed(words, runs)).decode())
            part.clear()

        for value in texts:
            words = (value.as_py() or "").encode().split()
            if part and size + len(words) > WORDS:
                search()
                size = 0
            part.append(words)
            size += len(words)
        search()
        item = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.list_(item)), pa.array(kept, pa.string())], names=["found", "collapsed"]
        )

    return find_runs
