"""Repeated byte strings across a corpus, by common-prefix intervals of enhanced suffix arrays.

Every string of ``least`` bytes has an anchor: of its blocks of about a third of that
length the one of least hash. Equal strings have it at the same place, so they lie in
the *contexts* of equal anchors: a context goes from the begin of the first string
that has this anchor to the end of the last one. Every string of ``least`` bytes
begins in one context alone.

1. Two strings that share ``least`` bytes around an anchor share one of four longer
   pieces at fixed places around it. Hashes of these pieces, 48 bits each, are dealt
   to buckets; those that come twice make a bitmap of 4 to 8 bits a hash,
   ``MOST_BITS`` at most. A full one lets more anchors through, nothing else.
2. Contexts whose pieces hit the bitmap are counted by 128-bit names, without their
   text. One that occurs twice is a repeat as a whole.
3. Only where an anchor has several contexts their texts are needed: these go to the
   task of the anchor's key, equal ones of a block once. There an enhanced suffix array
   over the contexts is scanned with a stack: intervals of suffixes that share ``least``
   bytes or more and have differing bytes before them are the maximal repeats, with all
   their places.
4. Keys with more than ``CROWD`` contexts are not solved in one task: the suffixes
   of their contexts are dealt by their first ``least`` bytes instead, and those
   that meet another one are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, staged, unused
from flowquarry.llm.phrases import in_bitmap, key_bitmap
from flowquarry.llm.suffixes import Suffixes, ranges

LEAST = 200
#: Pieces around an anchor.
PIECES = 4
#: Bytes of text whose anchors are found at once, and of contexts searched at once.
BLOCK = 1 << 18
SEARCH = 1 << 20
#: Hashes a task holds before it deals them, and about as many a bucket.
HELD = 1 << 21
MOST_BITS = 1 << 30
CROWD = 4096

_BITS, _PLACE = 48, 21
_rng = np.random.default_rng(12)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _power(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Anchors:
    """Anchors of some texts that lie one after the other, and hashes of the pieces around them.

    ``size`` gives each text's length. Places are counted from the first text's
    begin; only strings that begin in ``[low, high)`` are looked at. ``first`` and
    ``last`` bound the contexts.
    """

    powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64),) * 2

    def __init__(self, data: bytes, size: np.ndarray, least: int, low: int = 0, high: int | None = None):
        codes = np.frombuffer(data, np.uint8)
        n, block = len(codes), max(least * 64 // 200, 1)
        if len(Anchors.powers[0]) <= n:
            Anchors.powers = _power(_BASE, 2 * n + 2), _power(pow(_BASE, -1, 2**64), 2 * n + 2)
        power, self.inverse = Anchors.powers
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[codes] * power[:n], dtype=np.uint64)))
        self.end = np.repeat(np.cumsum(size), size)
        self.begin = np.repeat(np.cumsum(size) - size, size)
        self.window = window = least - block + 1
        self.least = least
        # Where strings begin; the least hash of their blocks, with its place in the lower bits, leftmost first.
        here = np.flatnonzero(self.end - np.arange(n) >= least)
        here = here[(here >= low) & (here < (n if high is None else high))]
        self.at = self.key = self.first = self.last = here[:0]
        if not len(here):
            return
        hashes = (self.sums[block:] - self.sums[:-block]) * self.inverse[: n - block + 1] * _SPREAD
        least_hash = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            least_hash = np.minimum(least_hash[:-width], least_hash[width:])
            width *= 2
        if width < window:
            least_hash = np.minimum(least_hash[: len(least_hash) - (window - width)], least_hash[window - width :])
        place = (least_hash[here] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        fresh = np.flatnonzero(np.diff(place, prepend=-1))
        self.at = place[fresh]
        self.key = hashes[self.at]
        self.first, self.last = here[fresh], here[np.append(fresh[1:], len(here)) - 1] + least

    def span(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the strings between places; equal strings hash alike."""
        x = (self.sums[last] - self.sums[first]) * self.inverse[first] + (last - first).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * _SPREAD
        return x ^ (x >> np.uint64(29))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (48 bits) of the pieces around each anchor, and which of them lie in its text."""
        least = self.least
        cuts = np.linspace(0, self.window, PIECES + 1).astype(np.int64)
        hashes, inside = [], []
        for i, (near, far) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            # A string that begins near to far - 1 bytes before the anchor ends least - far + 1 bytes after it or later.
            first, last = self.at - near, self.at + least - far + 1
            good = (first >= self.begin[self.at]) & (last <= self.end[self.at])
            found = self.span(np.where(good, first, 0), np.where(good, last, 0)) + np.uint64(i) * _SPREAD
            hashes.append((found * _SPREAD) >> np.uint64(64 - _BITS))
            inside.append(good)
        return np.stack(hashes, 1), np.stack(inside, 1)


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[bytes, Anchors, list, np.ndarray]]:
    """Texts one after the other, their anchors, their rows' names, and the place in its row that each text begins at.

    Short texts come together. A long one comes in parts that overlap; each string
    is looked at in the part it begins in.
    """
    texts: list[bytes] = []
    names: list[tuple] = []
    held = 0

    def together():
        size = np.array([len(t) for t in texts], np.int64)
        found = Anchors(b"".join(texts), size, least)
        return b"".join(texts), found, list(names), np.zeros(len(texts), np.int64)

    for batch in batches:
        *keys, column = batch.columns
        for *name, text in zip(*keys, column, strict=True):
            data = (text.as_py() or "").encode()
            name = tuple(x.as_py() for x in name)
            if len(data) < least:
                continue
            if len(data) > 2 * BLOCK:
                for begin in range(0, len(data), BLOCK):
                    first = max(begin - least, 0)
                    part = data[first : begin + BLOCK + 2 * least]
                    found = Anchors(part, np.array([len(part)]), least, begin - first, begin - first + BLOCK)
                    yield part, found, [name], np.array([first])
                continue
            if held and held + len(data) > BLOCK:
                yield together()
                texts, names, held = [], [], 0
            texts.append(data)
            names.append(name)
            held += len(data)
    if held:
        yield together()


def _dealt(texts: DataFrame, least: int, buckets: int) -> DataFrame:
    """``bucket, once, more``: 48-bit hashes of pieces, by their upper bits; those a task saw once, and more often."""
    shift = np.uint64(_BITS - (buckets - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(found >> shift, np.arange(buckets + 1, dtype=np.uint64))
            out: list[tuple] = []
            for bucket in range(buckets):
                part = slice(edge[bucket], edge[bucket + 1])
                if edge[bucket] < edge[bucket + 1]:
                    single = count[part] == 1
                    out.append((bucket, _packed(found[part][single]), _packed(found[part][~single])))
            held.clear()
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["bucket", "once", "more"])

        size = 0
        for _, found, _, _ in _blocks(batches, least):
            hashes, inside = found.pieces()
            held.append(hashes[inside])
            size += len(held[-1])
            if size > HELD:
                yield rows()
                size = 0
        if size:
            yield rows()

    return texts.mapInArrow(run, "bucket int, once binary, more binary")


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) * 8 // _BITS, 8), np.uint8)
    wide[:, : _BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, _BITS // 8)
    return wide.view("<u8").ravel()


def _bitmap(dealt: DataFrame, bits: int, buckets: int):
    """A broadcast bitmap by the upper bits of the hashes that come twice or more."""
    width, cells = (bits - 1).bit_length(), max(bits // buckets, 8)

    def solve(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, image = [], np.zeros(cells, bool)
        for batch in batches:
            for once, more in zip(batch.column("once"), batch.column("more"), strict=True):
                seen.append(_unpacked(once.as_py()))
                sure = _unpacked(more.as_py())
                image[(sure >> np.uint64(_BITS - width)) & np.uint64(cells - 1)] = True
                seen.append(sure)
        values = np.sort(np.concatenate(seen))
        again = values[1:][values[1:] == values[:-1]]
        image[(again >> np.uint64(_BITS - width)) & np.uint64(cells - 1)] = True
        columns = pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(image, bitorder="little").tobytes()])
        yield pa.RecordBatch.from_arrays([*columns], names=["bucket", "image"])

    whole = np.zeros(cells // 8 * buckets, np.uint8)
    # One row a bucket, ``bits`` / 8 bytes in all, whatever the size of the corpus.
    for batch in dealt.groupBy("bucket").applyInArrow(solve, "bucket int, image binary").toArrow().to_batches():
        for bucket, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            whole[bucket * (cells // 8) : (bucket + 1) * (cells // 8)] = np.frombuffer(image.as_buffer(), np.uint8)
    return dealt.sparkSession.sparkContext.broadcast((width, whole.tobytes()))


PLACES = "key long, name binary, length int, places array<struct<id: long, missing: boolean, text: long, begin: long>>"
CONTEXTS = "key long, name binary, context binary"


def _chosen(batches: Iterator[pa.RecordBatch], least: int, bitmap) -> Iterator[tuple]:
    """Blocks with the anchors whose pieces hit the bitmap."""
    width, image = bitmap.value
    bits = np.frombuffer(image, np.uint8)
    for data, found, names, begins in _blocks(batches, least):
        hashes, inside = found.pieces()
        where = hashes >> np.uint64(_BITS - width)
        hit = (bits[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1 == 1
        yield data, found, names, begins, np.flatnonzero((hit & inside).any(axis=1))


def _name(context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16).digest()


def _rows(rows: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _places(texts: DataFrame, least: int, bitmap) -> DataFrame:
    """Names of the contexts of all anchors that hit the bitmap, and where they begin; those of a block together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("id", pa.int64()), ("missing", pa.bool_()), ("text", pa.int64()), ("begin", pa.int64())])
        kinds = {"key": pa.int64(), "name": pa.binary(), "length": pa.int32(), "places": pa.list_(place)}
        held: dict[tuple, list] = {}
        for data, found, names, begins, chosen in _chosen(batches, least, bitmap):
            text_begin = found.begin[found.at[chosen]]
            number = np.searchsorted(np.unique(found.begin), text_begin)
            columns = found.key[chosen].view(np.int64), found.first[chosen], found.last[chosen], number, begins[number] - text_begin
            for key, first, last, k, shift in zip(*[c.tolist() for c in columns], strict=True):
                name = _name(data[first:last])
                row = held.setdefault((key, name), (key, name, last - first, []))
                row[3].append(dict(zip(("id", "missing", "text"), names[k], strict=True)) | {"begin": first + shift})
            if len(held) > 10_000:
                yield _rows(list(held.values()), kinds)
                held = {}
        if held:
            yield _rows(list(held.values()), kinds)

    return texts.mapInArrow(run, PLACES)


def _contexts(texts: DataFrame, least: int, bitmap, mixed) -> DataFrame:
    """The contexts of anchors that hit both bitmaps; equal ones of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(mixed.value, np.uint8)
        kinds = {"key": pa.int64(), "name": pa.binary(), "context": pa.binary()}
        held: dict[tuple, tuple] = {}
        for data, found, _, _, chosen in _chosen(batches, least, bitmap):
            keys = found.key[chosen].view(np.int64)
            chosen = chosen[in_bitmap(bits, keys)]
            columns = found.key[chosen].view(np.int64), found.first[chosen], found.last[chosen]
            for key, first, last in zip(*[c.tolist() for c in columns], strict=True):
                context = data[first:last]
                name = _name(context)
                held[key, name] = (key, name, context)
            if len(held) > 10_000:
                yield _rows(list(held.values()), kinds)
                held = {}
        if held:
            yield _rows(list(held.values()), kinds)

    return texts.mapInArrow(run, CONTEXTS)


def maximal_repeats(contexts: list[bytes], least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, contexts, places) of every maximal repeat of ``least`` bytes or more among different contexts.

    A stack scan over the common prefixes of the suffix array. An interval of
    suffixes is a group if the bytes before them differ, where the begin of a context
    differs from everything; else the strings one byte further left are the repeat.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size + 1) - size  # every context ends with a symbol of its own, and so does what is before the first
    text = np.full(int(size.sum()) + len(size) + 1, -1, np.int64)
    at, owner = ranges(begin, size)
    text[at] = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.flatnonzero(text < 0)
    text[ends] = 256 + np.arange(len(ends))
    suffixes = Suffixes(text)
    common = suffixes.common()
    before = text[suffixes.order - 1]
    found = []
    long = np.flatnonzero(common >= least)
    edges = [*np.flatnonzero(np.diff(long, prepend=-9) != 1).tolist(), len(long)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        first, last = int(long[a]) - 1, int(long[b - 1])
        depths, left = common[first + 1 : last + 1].tolist(), before[first : last + 1].tolist()
        stack: list[list] = []  # depth, first place, byte before all of them (-1: they differ)
        for i, depth in enumerate([*depths, 0]):
            start, mark = first + i, left[i]
            while stack and stack[-1][0] > depth:
                length, start, seen = stack.pop()
                mark = mark if mark == seen else -1
                if mark == -1:
                    found.append((length, start, first + i))
            if stack and stack[-1][0] == depth:
                stack[-1][2] = mark if mark == stack[-1][2] else -1
            else:
                stack.append([depth, start, mark])
    out = []
    for length, start, end in found:
        places = suffixes.order[start : end + 1]
        number = np.searchsorted(begin, places, side="right") - 1
        out.append((length, number, places - begin[number]))
    return out


RESULTS = "key long, name binary, begins array<int>, lengths array<int>, groups array<binary>"


def _solved(contexts: DataFrame, least: int, groups: bool) -> DataFrame:
    """Where the contexts of each key repeat: merged stretches, or every maximal repeat with a name for its string.

    ``contexts`` has ``key, name, context``; the rows of a key come one after the
    other, equal contexts too.
    """

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        near = [i for i, r in enumerate(rows) if (i and rows[i - 1][0] == r[0]) or (i + 1 < len(rows) and rows[i + 1][0] == r[0])]
        found: dict[int, list[tuple]] = {}
        for length, number, begin in maximal_repeats([rows[i][2] for i in near], least) if near else ():
            for k, b in zip(number.tolist(), begin.tolist(), strict=True):
                found.setdefault(near[k], []).append((b, length))
        out = []
        for i, places in found.items():
            key, name, context = rows[i]
            places = sorted(set(places)) if groups else merged(places)
            marks = [_name(context[b : b + n]) for b, n in places] if groups else []
            out.append((key, name, [b for b, _ in places], [n for _, n in places], marks))
        if out:
            yield _rows(out, {"key": pa.int64(), "name": pa.binary(), "begins": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32()),
                              "groups": pa.list_(pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue
                if size > SEARCH and held[-1][0] != row[0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from solve(held)

    return contexts.mapInArrow(run, RESULTS)


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches (begin, length) of what some stretches cover; those that touch are one."""
    out: list[list[int]] = []
    for begin, length in sorted(places):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], begin + length)
        else:
            out.append([begin, begin + length])
    return [(begin, end - begin) for begin, end in out]


def _crowded(contexts: DataFrame, least: int) -> DataFrame:
    """Results for contexts of keys that are too many for a task: suffixes dealt by their first ``least`` bytes.

    A suffix whose first ``least`` bytes come a second time begins a repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "name": pa.binary(), "head": pa.binary(), "begin": pa.int32()}
        for batch in batches:
            for key, name, context in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _rows([(key, name, _name(context[i : i + least]), i) for i in range(len(context) - least + 1)], kinds)

    distinct = contexts.groupBy("key", "name").agg(F.first("context").alias("context"))
    suffixes = staged(distinct.mapInArrow(run, "key long, name binary, head binary, begin int"), "suffixes")
    heads = suffixes.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
    found = suffixes.join(heads, "head", "left_semi").groupBy("key", "name").agg(F.collect_list("begin").alias("begins"))
    return found.select("key", "name", "begins", F.transform("begins", lambda _: F.lit(least)).alias("lengths"), _none())


def _none() -> Column:
    """No names of groups."""
    return F.expr("cast(array() as array<binary>)").alias("groups")


def _named(docs: DataFrame, row_id: str, text: str) -> list[Column]:
    """What stands for a row: rows with equal id and text have equal repeats."""
    return [F.coalesce(F.col(row_id), F.lit(0)).cast("long").alias("id"), F.col(row_id).isNull().alias("missing"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text")]


def _found(docs: DataFrame, row_id: str, text: str, least: int, groups: bool) -> tuple[DataFrame, list[DataFrame]]:
    """``id, missing, text, begin, length, group`` of all repeats, and staged tables that can go once it is written."""
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.select(*_named(docs, row_id, text), F.col(text).alias("whole"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    hashes = 2 * PIECES * total // max(least - least * 64 // 200, 1)  # an anchor comes every half window
    bits = min(MOST_BITS, 1 << max(16, (4 * hashes).bit_length()))
    buckets = min(1 << 12, max(64, 1 << (hashes // HELD).bit_length()))
    bitmap = _bitmap(_dealt(texts, least, buckets), bits, buckets)
    places = staged(_places(texts, least, bitmap), "places")
    counted = places.groupBy("key", "name").agg(F.sum(F.size("places")).alias("n"), F.first("length").alias("length"))
    counted = staged(counted, "counted")
    keys = counted.groupBy("key").agg(F.count("*").alias("n"))
    crowds = staged(keys.where(F.col("n") > CROWD).select("key"), "crowds")
    mixed = key_bitmap(keys.where("n > 1").select("key"), MOST_BITS)
    contexts = _contexts(texts, least, bitmap, mixed)
    crowded = not crowds.isEmpty()
    if crowded:
        contexts = staged(contexts, "contexts")
    usual = contexts.join(crowds, "key", "left_anti") if crowded else contexts
    solved = _solved(usual.repartition("key").sortWithinPartitions("key", "name"), least, groups)
    if crowded:
        solved = solved.unionByName(_crowded(contexts.join(crowds, "key", "left_semi"), least))
    whole = F.when(F.lit(groups), F.array("name")).otherwise(_none()).alias("groups")
    twice = counted.where("n > 1").select("key", "name", F.array(F.lit(0)).alias("begins"), F.array("length").alias("lengths"), whole)
    solved = staged(solved.unionByName(twice), "solved")
    bitmap.unpersist()
    mixed.unpersist()
    used = [places, counted, crowds, solved] + ([contexts] if crowded else [])
    places = places.select("key", "name", F.explode("places").alias("place")).join(solved, ["key", "name"])
    part = F.explode(F.arrays_zip("begins", "lengths", "groups")).alias("part")
    places = places.select("place", part)
    begin = (F.col("place.begin") + F.col("part.begins")).cast("long").alias("begin")
    found = places.select("place.id", "place.missing", "place.text", begin, F.col("part.lengths").cast("long").alias("length"),
                          F.col("part.groups").alias("group"))
    return found.distinct(), used


def repeat_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``group, <row_id>, begin, length``: all occurrences of the maximal repeats around anchors.

    ``group`` names a string of ``least`` bytes or more that occurs at least twice
    and has, among the contexts of an anchor, occurrences with differing neighbours
    or ends; a context that occurs twice is a group of its own. ``begin`` counts
    bytes. Groups of keys with more than ``CROWD`` contexts are left unnamed (null):
    their strings of just ``least`` bytes are listed. Edge cases as in
    :func:`without_repeats`; rows of equal id and text are listed once.
    """
    found, _ = _found(docs, row_id, text, least, groups=True)
    return found.select("group", F.when(~F.col("missing"), F.col("id")).alias(row_id), "begin", "length")


def without_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Every row of ``docs`` with ``repeats``: ``n_bytes``, ``spans`` (begin, length; merged, in bytes) and ``kept`` (binary).

    A byte of a text (UTF-8; null: empty) goes if it lies in a string of ``least``
    bytes that also begins anywhere else in the table, in the same text too; overlaps
    count, and all strings are judged on the input. ``kept`` are the other bytes,
    which need not be whole code points. Columns of ``docs`` stay as they are; if
    one is called ``repeats``, the new one is ``repeats_``. ``row_id`` may be null
    or repeated: rows count as often as they come, equal rows have equal results.
    Texts shorter than ``least`` stay whole. Long texts are read whole, in parts that
    overlap. An empty table gives an empty one. Equality rests on 128-bit hashes of
    the contexts and on byte comparison of what differs.
    """
    found, used = _found(docs, row_id, text, least, groups=False)
    spans = found.groupBy("id", "missing", "text").agg(F.collect_list(F.struct("begin", "length")).alias("_spans"))
    hidden = [unused(f"_{c}", docs.columns) for c in ("id", "missing", "text", "spans")]
    spans = spans.toDF(*hidden)
    rows = docs.select("*", *[c.alias(n) for c, n in zip(_named(docs, row_id, text), hidden, strict=False)])
    name = unused("repeats", docs.columns)
    cut = _cutter()
    out = rows.join(spans, hidden[:3], "left").withColumn(name, cut(F.col(text), F.col(hidden[3])))
    return out.select(*docs.columns, name)


def _cutter():
    @F.arrow_udf("struct<n_bytes: bigint, spans: array<struct<begin: bigint, length: bigint>>, kept: binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        sizes, stretches, kept = [], [], []
        for text, places in zip(texts, spans, strict=True):
            data = (text.as_py() or "").encode()
            gone = merged([(p["begin"], p["length"]) for p in places.as_py() or ()])
            edge, parts = 0, []
            for begin, length in gone:
                parts.append(data[edge:begin])
                edge = begin + length
            sizes.append(len(data))
            stretches.append([{"begin": b, "length": n} for b, n in gone])
            kept.append(b"".join([*parts, data[edge:]]))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(stretches, span), pa.array(kept, pa.binary())],
                                          names=["n_bytes", "spans", "kept"])

    return cut
