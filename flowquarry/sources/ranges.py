"""Capture files in byte ranges: classic captures and pcapng of any size, many tasks a file.

A range starts somewhere inside a record. It guesses its first record by a chain of
plausible headers, walks the headers up to its end and says where it started, how many
records it holds and where the next one begins. The fold over the ranges of a file (one
small row each) keeps a guess only if the range before ends exactly there; any other
range is walked again from the true place, together with ranges after it that have no guess. So a guess costs time when it is wrong, never
a record. The fold also numbers the records and hands on the interfaces of a pcapng section.

Files are opened with ``pyarrow.fs`` inside the tasks; for stores that only Spark's own
readers open, ``captures.read_captures(..., whole=True)`` reads whole files.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.runtime import cut_lineage

RANGE = 128 << 20
# Magic numbers of classic captures with byte order and ticks a second; block types of pcapng.
CLASSIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6),
    b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9),
}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
SECTION_ORDER = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
LONGEST = 262_144  # snapshot length of common capture tools; longer records are read, but no guess starts at one

_CHUNK = 4 << 20
_CHAIN = 64  # more records than a common frame can hold of a capture that is being transferred
_BATCH_ROWS, _BATCH_BYTES = 4096, 16 << 20
_WALK = "path string, length bigint, first bigint, stop bigint, start bigint, order string, count bigint, end bigint, faces string, out string, reset boolean, error string"
_PLAN = "path string, length bigint, first bigint, stop bigint, start bigint, order string, pos bigint, faces string, error string, todo boolean"
_RECORDS = "path string, file bigint, pos bigint, t double, link_type int, frame binary"


class Damaged(ValueError):
    """The rest of a file cannot be read."""


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name for a path as Spark gives it."""
    uri = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class Source:
    """A file read forwards in chunks."""

    def __init__(self, path: str, length: int, chunk: int = _CHUNK):
        system, name = store(path)
        self.file, self.length, self.chunk = system.open_input_file(name), length, min(max(chunk, 1 << 12), _CHUNK)
        self.at, self.held = 0, self.file.read(24)

    def spot(self, at: int, size: int) -> int:
        """Place in ``held`` of the bytes from ``at``; they must lie inside the file."""
        if at < self.at or at + size > self.at + len(self.held):
            self.file.seek(at)
            self.held, self.at = self.file.read(min(max(size, self.chunk), self.length - at)), at
        return at - self.at

    def take(self, at: int, size: int) -> bytes:
        spot = self.spot(at, size)
        return self.held[spot:spot + size]

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


class Classic:
    """Records after one file header; every record is a header of 16 bytes and the frame."""

    begin = 24

    def __init__(self, head: bytes):
        self.order, self.ticks = CLASSIC[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0] & 0xFFFF
        self.head = struct.Struct(self.order + "IIII")

    def walk(self, source: Source, at: int, stop: int, state: State) -> Iterator[tuple[float, int, int, int, int]]:
        """Time, link type, place and size of every frame, and where the next record begins."""
        stop = min(stop, source.length)
        while at < stop:
            if at + 16 > source.length:
                raise Damaged("record header cut off")
            seconds, fraction, size, _ = self.head.unpack(source.take(at, 16))
            if at + 16 + size > source.length:
                raise Damaged("record cut off")
            yield seconds + fraction / self.ticks, self.link, at + 16, size, at + 16 + size
            at += 16 + size

    def _follows(self, source: Source, at: int, order: str) -> tuple[int, str]:
        """Where the record after a plausible one begins, else -1; and the byte order from there on."""
        if at + 16 > source.length:
            return -1, order
        seconds, fraction, size, whole = self.head.unpack(source.take(at, 16))
        end = at + 16 + size
        fine = 0 < size <= min(whole, LONGEST) and fraction < self.ticks and end <= source.length
        if fine and end + 16 <= source.length:
            # Wrong places often lead to a right one further on, but their time differs from the next.
            fine = abs(self.head.unpack(source.take(end, 16))[0] - seconds) <= 86_400
        return (end if fine else -1), order

    def guess(self, source: Source, first: int, stop: int) -> tuple[int, str]:
        """First place from which plausible records follow, else -1; and its byte order."""
        for base in range(first, min(stop, source.length - 16), 1 << 16):
            size = min(1 << 16, stop - base, source.length - 16 - base)
            raw = np.frombuffer(source.take(base, size + 16), np.uint8).astype(np.int64)
            places = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
            field = [sum(raw[4 * k + i:4 * k + i + size] << places[i] for i in range(4)) for k in (1, 2, 3)]
            fine = (field[0] < self.ticks) & (field[1] > 0) & (field[1] <= np.minimum(field[2], LONGEST))
            for offset in np.flatnonzero(fine).tolist():
                if _chained(self._follows, source, base + offset, self.order):
                    return base + offset, self.order
        return -1, self.order


class Blocks:
    """pcapng: sections of blocks that name their own length at both ends."""

    begin = 0

    def __init__(self, head: bytes):
        self.order = SECTION_ORDER[head[8:12]]

    def walk(self, source: Source, at: int, stop: int, state: State) -> Iterator[tuple[float | None, int | None, int, int, int]]:
        stop = min(stop, source.length)
        while at < stop:
            if at + 12 > source.length:
                raise Damaged("block header cut off")
            spot = source.spot(at, 12)
            if source.held[spot:spot + 4] == b"\x0a\x0d\x0d\x0a":
                order = SECTION_ORDER.get(source.held[spot + 8:spot + 12])
                if order is None:
                    raise Damaged("damaged section header")
                state.section(order)
            kind, size = struct.unpack_from(state.order + "II", source.held, spot)
            if size < 12 or size % 4:
                raise Damaged("damaged block length")
            if at + size > source.length:
                raise Damaged("block cut off")
            if struct.unpack(state.order + "I", source.take(at + size - 4, 4))[0] != size:
                raise Damaged("block lengths differ")
            if kind == INTERFACE:
                state.interface(source.take(at + 8, size - 12))
            elif kind in (PACKET, OLD_PACKET, SIMPLE_PACKET):
                room = size - (16 if kind == SIMPLE_PACKET else 32)
                if room < 0:
                    raise Damaged("damaged packet block")
                if kind == SIMPLE_PACKET:
                    (whole,) = struct.unpack(state.order + "I", source.take(at + 8, 4))
                    link, t, limit = state.simple()
                    yield t, link, at + 12, min(room, whole, limit), at + size
                else:
                    form = "IIIII" if kind == PACKET else "HHIIII"
                    number, *_, high, low, held, whole = struct.unpack(state.order + form, source.take(at + 8, 20))
                    if held > room:
                        raise Damaged("damaged packet block")
                    link, t = state.stamped(number, (high << 32) + low)
                    yield t, link, at + 28, held, at + size
            at += size
            state.at = at

    def _follows(self, source: Source, at: int, order: str) -> tuple[int, str]:
        if at + 12 > source.length:
            return -1, order
        spot = source.spot(at, 12)
        if source.held[spot:spot + 4] == b"\x0a\x0d\x0d\x0a":
            order = SECTION_ORDER.get(source.held[spot + 8:spot + 12], order)
        kind, size = struct.unpack_from(order + "II", source.held, spot)
        fine = (0 < kind < 16 or kind == SECTION) and 12 <= size <= 4 * LONGEST and size % 4 == 0 and at + size <= source.length
        if not fine or struct.unpack(order + "I", source.take(at + size - 4, 4))[0] != size:
            return -1, order
        return at + size, order

    def guess(self, source: Source, first: int, stop: int) -> tuple[int, str]:
        # Sections of either order may have begun in earlier ranges.
        for at in range(first + -first % 4, min(stop, source.length), 4):
            for order in ("<", ">"):
                if _chained(self._follows, source, at, order):
                    return at, order
        return -1, self.order


class State:
    """Byte order and interfaces a walk starts with, and what it has met since: all that ranges hand on."""

    def __init__(self, order: str, faces: list):
        self.order, self.faces, self.reset, self.at = order, list(faces), False, -1

    def section(self, order: str) -> None:
        self.order, self.faces, self.reset = order, [], True

    def interface(self, body: bytes) -> None:
        link, _, longest = struct.unpack_from(self.order + "HHI", body)
        ticks, shift, at = 10**6, 0, 8
        while at + 4 <= len(body):
            code, size = struct.unpack_from(self.order + "HH", body, at)
            value = body[at + 4:at + 4 + size]
            if code == 9 and size == 1:
                ticks = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            elif code == 14 and size == 8:
                (shift,) = struct.unpack(self.order + "q", value)
            elif code == 0:
                break
            at += 4 + size + -size % 4
        self.faces.append([link, longest, ticks, shift])

    def stamped(self, number: int, stamp: int) -> tuple[int | None, float]:
        link, _, ticks, shift = self.faces[number] if number < len(self.faces) else (None, 0, 10**6, 0)
        whole, part = divmod(stamp, ticks)
        return link, shift + whole + part / ticks

    def simple(self) -> tuple[int | None, None, int]:
        link, longest = self.faces[0][:2] if self.faces else (None, 0)
        return link, None, longest or 1 << 32


def _chained(follows, source: Source, at: int, order: str) -> bool:
    for _ in range(_CHAIN):
        at, order = follows(source, at, order)
        if at < 0 or at == source.length:
            break
    return at >= 0


def _form(source: Source) -> Classic | Blocks | None:
    head = source.take(0, min(24, source.length))
    if len(head) == 24 and head[:4] in CLASSIC:
        return Classic(head)
    if head[:4] == b"\x0a\x0d\x0d\x0a" and head[8:12] in SECTION_ORDER:
        return Blocks(head)
    return None


def _walked(path: str, length: int, first: int, stop: int, start: int, order: str | None, size: int) -> Iterator[tuple]:
    """Rows of ``_WALK`` for the ranges of ``size`` bytes between ``first`` and ``stop``; a ``start`` of -1 is guessed."""
    with Source(path, length, stop - first) as source:
        form = _form(source)
        if form is None:
            yield path, length, first, stop, 0 if first == 0 else -1, "", 0, -1, "[]", "", False, "not a capture file"
            return
        if start < 0:
            start, order = (form.begin, form.order) if first == 0 else form.guess(source, first, stop)
        for low in range(first, max(stop, first + 1), size):
            high = min(low + size, length)
            if start < 0 or start >= high:
                # A range without a guess, or inside the header or one record; what is known of the next record stays.
                yield path, length, low, high, start if low == 0 else -1, order, 0, start, "[]", order, False, None
                continue
            state, count, end, error = State(order, []), 0, start, None
            try:
                for *_, end in form.walk(source, start, high, state):
                    count += 1
            except Damaged as damage:
                error = str(damage)
            end = max(end, state.at)
            yield path, length, low, high, start, order, count, end, json.dumps(state.faces), state.order, state.reset, error
            if error:
                return
            start, order = end, state.order


def _walk(size: int):
    """Walks in ranges of ``size`` bytes, for ``mapInPandas``."""
    names = [c.split()[0] for c in _WALK.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = _walked(row.path, row.length, row.first, row.stop, row.start, row.order, size)
                while some := list(islice(found, _BATCH_ROWS)):
                    yield pd.DataFrame(some, columns=names)

    return walk


def _fold(walks: pd.DataFrame) -> pd.DataFrame:
    """Where each range of one file really starts; ``todo`` marks those walked from another place."""
    at, pos, order, faces, rows = 0, 0, "", [], []
    for r in walks.sort_values("first").itertuples(index=False):
        if r.first == 0:
            at, order = r.start, r.order
        if at < 0:  # after a range that is to be walked again: it takes those without a guess along
            at, order = r.start, r.order
            if at < 0:
                rows[-1] = (*rows[-1][:3], r.stop, *rows[-1][4:])
        if at < 0 or at >= r.stop > 0:
            continue
        if r.start == at and r.order == order:
            if at < r.stop:
                rows.append((r.path, r.length, r.first, r.stop, at, order, pos, json.dumps(faces), None, False))
            if r.error is not None:
                rows.append((r.path, r.length, r.stop, r.stop, -1, order, pos + r.count, "[]", r.error, False))
                break
            at, pos, order = r.end, pos + r.count, r.out
            faces = json.loads(r.faces) if r.reset else faces + json.loads(r.faces)
        else:
            rows.append((r.path, r.length, r.first, r.stop, at, order, pos, json.dumps(faces), None, True))
            at = -1
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLAN.split(", ")])


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, file`` of all files below ``path``, numbered by name; nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("file", (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint"))


def plan_ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """A row per range of ``size`` bytes: its true first record and the number of that record in the file.

    Files that cannot be read to their end have one row with ``error``, whose ``pos`` is the number of readable
    records. A wrong guess is walked again until all ranges of all files fit together.
    """
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("bigint")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("n")).select(
        "path", "length", (F.col("n") * size).alias("first"), F.least((F.col("n") + 1) * size, "length").alias("stop"),
        F.lit(-1).cast("bigint").alias("start"), F.lit(None).cast("string").alias("order"),
    )
    walks = cut_lineage(spread(ranges).mapInPandas(_walk(size), _WALK))
    while True:
        plan = cut_lineage(walks.groupBy("path").applyInPandas(_fold, _PLAN))
        again = plan.filter("todo")
        if again.isEmpty():
            return plan.drop("todo")
        fresh = spread(again.select("path", "length", "first", "stop", "start", "order")).mapInPandas(_walk(size), _WALK)
        fresh = cut_lineage(fresh)
        walks = cut_lineage(walks.join(fresh.select("path", "first"), ["path", "first"], "left_anti").select(*fresh.columns).unionByName(fresh))


def spread(ranges: DataFrame) -> DataFrame:
    """Ranges dealt evenly to tasks of about ``RANGE`` bytes, or to all cores if there are few bytes."""
    found = ranges.agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("first")).alias("bytes")).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(found["n"], cores), -(-(found["bytes"] or 0) // RANGE)))


def read_ranges(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Records of all planned ranges: ``path, file, pos, t, link_type, frame``."""
    schema = pa.schema([("path", pa.string()), ("file", pa.int64()), ("pos", pa.int64()), ("t", pa.float64()),
                        ("link_type", pa.int32()), ("frame", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read(row, schema)

    wanted = plan.filter("start >= 0").join(files.select("path", "file"), "path")
    return spread(wanted).mapInArrow(read, _RECORDS)


def _read(row: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    with Source(row["path"], row["length"], row["stop"] - row["first"]) as source:
        form = _form(source)
        if form is None:
            return
        pos, held, rows = row["pos"], 0, []

        def packed() -> pa.RecordBatch:
            times, links, frames = zip(*rows, strict=True)
            columns = [pa.repeat(row["path"], len(rows)), pa.repeat(pa.scalar(row["file"], pa.int64()), len(rows)),
                       pa.array(range(pos - len(rows), pos), pa.int64()), pa.array(times, pa.float64()),
                       pa.array(links, pa.int32()), pa.array(frames, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        try:
            for t, link, at, size, _ in form.walk(source, row["start"], row["stop"], State(row["order"], json.loads(row["faces"]))):
                rows.append((t, link, source.take(at, size)))
                pos, held = pos + 1, held + size
                if len(rows) == _BATCH_ROWS or held >= _BATCH_BYTES:
                    yield packed()
                    held, rows = 0, []
        except Damaged:
            pass  # the plan bears the error
        if rows:
            yield packed()
