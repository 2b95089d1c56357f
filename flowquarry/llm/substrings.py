"""Repeated passages: paragraph MinHash banding, exact Jaccard, and components; and passages inside paragraphs.

A paragraph is a line of at least ``LEAST`` words. Its MinHash signature over
5-word shingles is cut into bands, tuned so that a pair at the threshold is missed
with probability at most ``MISS``; paragraphs that collide in a band are verified
by the exact Jaccard similarity of their shingles, and clustered by components.

A passage can also sit in the middle of otherwise different paragraphs. There the
text is cut by its own content: in every run of ``WINDOW`` shingles the one of
least hash (its MinHash) starts a passage of ``LEAST`` words. Whatever text of
``WINDOW + LEAST + 4`` words or more two documents share, they share a passage.
That length, 45 words, is the promise: shorter shared texts, from ``LEAST`` words on,
are found only if one of their passages happens to start where they do.

Of each cluster the document of smallest doc_id keeps its text, and every other
document loses its occurrences. Repetition inside one document is left alone.

Texts are never shuffled. What is gathered from all documents are 64-bit keys;
which of them occur in two documents goes back to the tasks as a bitmap of
``BITS`` bits (8 MB), and only rows that hit it are shuffled on. A full bitmap
would let more rows through, never change a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, discard, staged, unused
from flowquarry.llm.components import connected, spanning

SHINGLE = 5
THRESHOLD = 0.8
MISS = 0.002
MOST_BANDS = 6
LEAST = 25
WINDOW = 16
BITS = 1 << 26

#: Paragraphs of one band up to which all pairs are made, and paragraphs of a block beyond.
SHORT = 16
BLOCK = 256

PARAGRAPH, PASSAGE, BAND = 0, 1, 2


def tune(threshold: float = THRESHOLD, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which ``most`` bands miss a pair at the threshold no more often than ``miss``."""
    found = (most, 1)
    for rows in range(1, 65):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if bands > most:
            break
        found = (bands, rows)
    return found


_random = np.random.default_rng(20)
_BYTE, _PLACE, _MIN_MUL, _MIN_ADD = (_random.integers(1, 2**64, n, np.uint64) for n in (256, SHINGLE, 256, 256))
_PLACE, _MIN_MUL = _PLACE | np.uint64(1), _MIN_MUL | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of ``values[first:last]`` for many spans, by prefix sums modulo 2^64; equal spans hash alike anywhere."""
    power, inverse = _power(len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)))
    return _mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


class Units:
    """Paragraphs and passages of one text. Positions are in code points."""

    def __init__(self, text: str):
        data = np.frombuffer(text.encode().lower(), np.uint8)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turns[::2], turns[1::2]
        self.count = n = len(start)
        if n < LEAST:
            self.first = self.last = self.keys = self.anchors = self.blocks = np.empty(0, np.int64)
            return
        chars = np.cumsum((data & 0xC0) != 0x80)
        self.start, self.end = chars[start] - 1, chars[end - 1]
        words = _spans(_BYTE[data], start, end)
        sums = sum(words[i : n - SHINGLE + 1 + i] * _PLACE[i] for i in range(SHINGLE))
        self.shingles = _mix(sums)
        # Paragraphs: runs of words between line breaks.
        line = np.cumsum(data == 10)[start]
        edge = np.concatenate(([0], np.flatnonzero(line[1:] != line[:-1]) + 1, [n]))
        long = edge[1:] - edge[:-1] >= LEAST
        self.first, self.last = edge[:-1][long], edge[1:][long]
        self.keys = _spans(words, self.first, self.last)
        # Passages: from the least shingle of every window.
        if len(self.shingles) >= WINDOW:
            windows = np.lib.stride_tricks.sliding_window_view(self.shingles, WINDOW)
            anchors = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
            self.anchors = anchors[anchors + LEAST <= n]
            self.blocks = _spans(words, self.anchors, self.anchors + LEAST)
        else:
            self.anchors = self.blocks = np.empty(0, np.int64)

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """Band keys, one row per paragraph."""
        sizes = self.last - self.first - SHINGLE + 1
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.first - starts, sizes) + np.arange(int(sizes.sum()))
        shingles = self.shingles[at]
        out = np.empty((len(sizes), bands), np.uint64)
        for band in range(bands):
            key = np.full(len(sizes), band, np.uint64)
            for i in range(band * rows, (band + 1) * rows):
                least = np.minimum.reduceat(shingles * _MIN_MUL[i] + _MIN_ADD[i], starts)
                key = _mix(key * np.uint64(_BASE) + least)
            out[:, band] = key
        return out


def _hits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(BITS - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _scan(docs: DataFrame, parts, schema: str) -> DataFrame:
    """Rows that ``parts(doc_id, units)`` makes of every document; it yields tuples of columns."""
    kinds = [pa.field("x", {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}[c.split(" ")[1]]).type
             for c in schema.split(", ")]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [part for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for part in parts(doc, Units(text))]
            if rows:
                columns = [
                    pa.array([x for r in rows for x in r[i]], k) if pa.types.is_list(k)
                    else pa.array(np.concatenate([r[i] for r in rows]).astype(k.to_pandas_dtype()), k)
                    for i, k in enumerate(kinds)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of all keys: ``BITS`` / 8 bytes at most, whatever the number of keys."""
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1  # numbers from 1 are bit 0 on
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r.n - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _block_links(threshold: float):
    """Links between differently labelled paragraphs of one block, enough to connect whatever is alike in it."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        sets = table.column("shingles").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        owner, (_, place, seen) = np.repeat(np.arange(len(ids)), size), np.unique(
            sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = seen[place] > 1  # a shingle of one paragraph alone is in no intersection
        kept, place = np.unique(place[common], return_inverse=True)
        member = np.zeros((len(ids), len(kept)), np.float32)
        member[owner[common], place] = 1
        both = (member @ member.T).astype(float)
        alike = both / (size[:, None] + size[None, :] - both) >= threshold
        left, right = np.nonzero(np.triu(alike & (labels[:, None] != labels[None, :]), 1))
        a, b = spanning(left, right, len(ids))
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def repeated_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, first, last, source_id``: maximal spans (code points, ``last`` exclusive) that go, and who keeps the text.

    ``source_id`` is the smallest doc_id that keeps one of the clusters of the span.
    Rows without doc_id or text, and texts of fewer than ``LEAST`` words, neither
    lose nor keep anything; rows repeated under one doc_id are one document, and
    so only give other documents something to lose. Extra columns are ignored, an
    empty table gives no spans, and texts of any length are read whole. Up to
    ``WINDOW`` words at either end of a passage inside paragraphs stay, and shared
    texts of fewer than ``WINDOW + LEAST + 4`` words inside paragraphs may be missed.
    """
    spark = docs.sparkSession
    bounded(spark)
    bands, rows = tune(threshold)

    def same(n: int, value: int) -> np.ndarray:
        return np.full(n, value, np.int64)

    def keyed(doc: int, u: Units):
        if len(u.blocks):
            yield same(len(u.blocks), PASSAGE), u.blocks.view(np.int64), same(len(u.blocks), doc)
        if len(u.keys):
            yield same(len(u.keys), PARAGRAPH), u.keys.view(np.int64), same(len(u.keys), doc)
            found = u.bands(bands, rows)
            for band in range(bands):
                yield same(len(u.keys), BAND + band), found[:, band].copy().view(np.int64), u.keys.view(np.int64)

    # Keys in two documents; band keys of two different paragraphs.
    every = _scan(docs, keyed, "kind int, key long, id long")
    shared = every.groupBy("kind", "key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    shared = staged(shared.where("least < most").drop("most"), "shared")
    hot = spark.sparkContext.broadcast(_bitmap(shared.where(F.col("kind") != PARAGRAPH)))

    def again(doc: int, u: Units):
        hit = np.flatnonzero(_hits(hot.value, u.blocks)) if len(u.blocks) else ()
        if len(hit):
            at = u.anchors[hit]
            yield (same(len(hit), PASSAGE), u.blocks[hit].view(np.int64), same(len(hit), doc), u.start[at],
                   u.end[at + LEAST - 1])
        if len(u.keys):
            found = u.bands(bands, rows)
            for band in range(bands):
                hit = np.flatnonzero(_hits(hot.value, found[:, band]))
                if len(hit):
                    zero = same(len(hit), 0)
                    yield same(len(hit), BAND + band), found[hit, band].view(np.int64), u.keys[hit].view(np.int64), zero, zero

    units = staged(_scan(docs, again, "kind int, key long, id long, first int, last int"), "units")
    found = staged(units.join(shared.drop("n"), ["kind", "key"]), "matches")
    discard(units)
    passages = found.where((F.col("kind") == PASSAGE) & (F.col("id") != F.col("least")))
    passages = passages.select(F.col("id").alias("doc_id"), "first", "last", F.col("least").alias("source_id"))

    # Paragraphs: first compare each with the commonest one of its bands; edited copies resemble what they are copies of.
    popular = shared.where(F.col("kind") == PARAGRAPH).select(F.col("key").alias("id"), "n")
    members = found.where(F.col("kind") >= BAND).select("kind", "key", "id").distinct().join(popular, "id", "left")
    members = staged(members.select("kind", "key", "id", F.coalesce("n", F.lit(1)).alias("n")), "members")
    leads = staged(members.groupBy("kind", "key").agg(F.max(F.struct("n", "id")).alias("lead")), "leads")
    chosen = members.drop("n").join(leads, ["kind", "key"]).groupBy(F.col("id").alias("a")).agg(F.max("lead").alias("lead"))
    pairs = chosen.select("a", F.col("lead.id").alias("b")).where("a != b")
    ids = members.select(F.col("id").alias("key")).union(shared.where(F.col("kind") == PARAGRAPH).select("key"))
    wanted = spark.sparkContext.broadcast(_bitmap(ids))

    def paragraphs(doc: int, u: Units):
        hit = np.flatnonzero(_hits(wanted.value, u.keys)) if len(u.keys) else ()
        if len(hit):
            first, last = u.first[hit], u.last[hit]
            # Half of a shingle's hash: within one paragraph the chance of two alike is nil.
            sets = [np.unique(u.shingles[i : j - SHINGLE + 1].view(np.int32)[1::2]) for i, j in zip(first, last, strict=True)]
            yield u.keys[hit].view(np.int64), same(len(hit), doc), u.start[first], u.end[last - 1], sets

    seen = staged(_scan(docs, paragraphs, "key long, doc_id long, first int, last int, shingles array<int>"), "paragraphs")
    sets = seen.join(members.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
    sets = staged(sets.groupBy("key").agg(F.first("shingles").alias("shingles")), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return both.where(_jaccard(F.col("x"), F.col("y")) >= threshold).select("a", "b")

    links = staged(verified(pairs), "links")
    first = connected(links)
    named = members.join(first.toDF("id", "label"), "id", "left")
    named = staged(named.select("kind", "key", "id", F.coalesce("label", "id").alias("label")), "named")
    # What is still apart within a band: all pairs of a short list; a long one in blocks, in which nothing but links is made.
    sizes = named.groupBy("kind", "key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y"))
    sizes = staged(sizes.where("x < y").select("kind", "key", "m"), "sizes")
    short = named.join(sizes.where(F.col("m") <= SHORT).drop("m"), ["kind", "key"])
    rest = short.toDF("kind", "key", "a", "p").join(short.toDF("kind", "key", "b", "q"), ["kind", "key"])
    rest = rest.where("p < q and a != b").select("a", "b").distinct()
    long = named.join(sizes.where(F.col("m") > SHORT), ["kind", "key"])
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    long = long.withColumn("part", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    long = long.select("kind", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "id", "label")
    long = long.join(sets.withColumnRenamed("key", "id"), "id")
    late = verified(rest).union(long.groupBy("kind", "key", "low", "high").applyInArrow(_block_links(threshold), "a long, b long"))
    late = staged(late.distinct(), "links")
    labels = connected(links.union(late))

    clusters = seen.drop("shingles").join(labels.toDF("key", "label"), "key", "left")
    clusters = staged(clusters.withColumn("label", F.coalesce("label", "key")), "clusters")
    discard(shared, members, leads, seen, sets, links, first, named, sizes, late, labels)
    least = staged(clusters.groupBy("label").agg(F.min("doc_id").alias("source_id")), "sources")
    lines = clusters.join(least, "label").where("doc_id != source_id").select("doc_id", "first", "last", "source_id")
    return _islands(passages.union(lines)).withColumns({c: F.col(c).cast("long") for c in ("first", "last")})


def _islands(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one; a document's spans are bounded by its length."""
    ordered = Window.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("source_id").alias("source_id")
    )
    return merged.select("doc_id", "first", "last", "source_id")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans taken out of ``text``; ``n_chars``, if there, follows the new text. All rows stay."""
    names = [unused(n, docs.columns) for n in ("starts", "ends")]
    parts = F.array_sort(F.collect_list(F.struct("first", "last")))
    removed = spans.groupBy("doc_id").agg(parts.alias("parts"))
    removed = removed.select("doc_id", F.col("parts.first").alias(names[0]), F.col("parts.last").alias(names[1]))
    joined = docs.join(removed, "doc_id", "left")
    text, starts, ends = F.col("text"), F.col(names[0]), F.col(names[1])
    kept = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(starts, F.array(F.length(text).cast("long"))),
        lambda a, b: F.substr(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")),
    )
    out = joined.withColumn("text", F.when(starts.isNotNull(), F.array_join(kept, "")).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(starts.isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
