"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``DISTANCE`` bits differ in at most
that many of their 8 bytes, so they share at least 8 - 3 = 5 positional bytes. The
inverted index is keyed by the bytes at 5 positions: a posting list holds exactly
the fingerprints that reach the guaranteed number of matches at those positions,
and its pairs are verified by their differing bits. As postings hold distinct
fingerprints whose other three bytes are free, a list has at most 2^24 entries of
8 bytes: that bounds what one task gathers, however many copies a text has.

Within a list only a spanning forest of its links is passed on, never all pairs;
that keeps the components whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, discard, map_batches, staged, tokens, unused
from flowquarry.llm.components import connected, spanning

SEED = 42
DISTANCE = 3
POSITIONS = 8
#: A posting list up to this length is compared pair by pair, a longer one by looking up changed bits.
PAIRWISE = 1024


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, repeats included; of the whole sequence if it is shorter."""
    found = tokens(text)
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(found) - words + 1)


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the shingle hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # little-endian bytes: bit k of the number is column k
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(ones * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (a signed long) for every row; a null or wordless text has fingerprint zero."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, fp long")


def _forest(marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one posting list of distinct fingerprints in any order."""
    marks = np.sort(marks)  # Spark sorts them as signed numbers; the search below needs unsigned order
    n = len(marks)
    if n <= PAIRWISE:
        left, right = np.nonzero(np.triu(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= distance, 1))
    else:  # every mark with up to ``distance`` changed bits among those that vary in the list
        varying = [k for k in range(64) if np.uint64(1 << k) & (np.bitwise_or.reduce(marks) & ~np.bitwise_and.reduce(marks))]
        lefts, rights = [], []
        for bits in range(1, distance + 1):
            for chosen in combinations(varying, bits):
                other = marks ^ np.uint64(sum(1 << k for k in chosen))
                at = np.searchsorted(marks, other)
                hit = np.flatnonzero((at < n) & (marks[np.minimum(at, n - 1)] == other) & (other > marks))
                lefts.append(hit)
                rights.append(at[hit])
        left, right = np.concatenate(lefts), np.concatenate(rights)
    linked, root = spanning(left, right, n)
    return marks[linked], marks[root]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def linked(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            size = np.diff(edges)
            left, right = [], []
            short = np.repeat(size <= 16, size)
            for gap in range(1, 16):  # short lists: all pairs of neighbours at each distance in the sorted list
                if len(keys) <= gap:
                    break
                i = np.flatnonzero(short[gap:] & (keys[gap:] == keys[:-gap]))
                if not len(i):
                    break
                near = np.bitwise_count(marks[i] ^ marks[i + gap]) <= distance
                left.append(marks[i[near]])
                right.append(marks[i[near] + gap])
            for k in np.flatnonzero(size > 16).tolist():
                x, y = _forest(marks[edges[k] : edges[k + 1]], distance)
                left.append(x)
                right.append(y)
            x = np.concatenate(left) if left else np.empty(0, np.uint64)
            y = np.concatenate(right) if right else np.empty(0, np.uint64)
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
            marks = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last list may go on in the next batch
            held_keys, held = keys[last:], marks[last:]
            if last:
                yield linked(keys[:last], marks[:last])
        if len(held_keys):
            yield linked(held_keys, held)

    return run


def near_links(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``fp`` that keep every component of those within ``distance`` bits.

    ``distance`` may be 1 to 3; more would leave too few guaranteed matches for lists of bounded length.
    """
    if not 1 <= distance <= DISTANCE:
        raise ValueError("distance must be 1, 2 or 3")
    least = POSITIONS - DISTANCE
    keys = []
    for number, chosen in enumerate(combinations(range(POSITIONS), least)):
        key = F.lit(number).cast("long")
        for position in chosen:
            byte = F.shiftright("fp", 8 * position).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    postings = marks.select(F.explode(F.array(*keys)).alias("key"), "fp")
    # Without a count the exchange follows spark.sql.shuffle.partitions; a list is bounded, see above.
    placed = postings.repartition("key").sortWithinPartitions("key", "fp")
    return placed.mapInArrow(_links(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest doc_id that can be reached over links between
    fingerprints with at most ``distance`` differing bits. Null and wordless texts
    have fingerprint zero and are linked like any other; rows with a null doc_id
    link others but name no component; repeated rows give repeated results; extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = connected(near_links(classes.select("fp"), distance))
    labelled = classes.join(labels.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = staged(labelled, "labelled")
    least = staged(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = staged(labelled.join(least, "label").select("fp", "component_id"), "named")
    discard(classes, labels, labelled, least)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id, with all its columns.

    Of rows repeated under one doc_id one stays. A row without doc_id cannot be named and stays as it is.
    """
    found = near_duplicates(docs, words, distance)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    mark, turn = unused("kept", docs.columns), unused("turn", docs.columns)
    joined = docs.join(staged(kept, "kept").withColumn(mark, F.lit(True)), "doc_id", "left")
    joined = joined.where(F.col(mark) | F.col("doc_id").isNull())
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    joined = joined.withColumn(turn, first).where((F.col(turn) == 1) | F.col("doc_id").isNull())
    return joined.select(*docs.columns)
