"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of each of its prefixes
modulo a prime, so the hash of any span is one subtraction and one multiplication.
Equality of any two spans, and by binary search their longest common extension,
need no further look at the text. The fingerprint of a text is the hash of the
whole and a sketch: the least hashes of all its spans of ``SPAN`` code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded

#: Primes below 2^31, so that products fit 64 bits, and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 16
SKETCH = 32

_powers: list[np.ndarray] = [np.ones(1, np.int64) for _ in MODULI]


def _power(n: int) -> list[np.ndarray]:
    """Powers of each base, at least ``n``, by doubling."""
    for i, (base, modulus) in enumerate(zip(BASES, MODULI, strict=True)):
        while len(_powers[i]) < n:
            known = _powers[i]
            step = known[-1] * base % modulus
            _powers[i] = np.concatenate((known, known * step % modulus))
    return _powers


class Prefixes:
    """Prefix arrays of one text (null: empty), over code points."""

    def __init__(self, text: str | None):
        codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64) + 1
        self.size = n = len(codes)
        self.sums = []
        for power, modulus in zip(_power(n + 1), MODULI, strict=True):
            terms = codes * power[:n] % modulus
            # Terms are below 2^31, so sums of up to 2^32 of them are exact.
            self.sums.append(np.concatenate((np.zeros(1, np.int64), np.cumsum(terms) % modulus)))

    def span(self, first: int, last: int, place: int) -> tuple[int, ...]:
        """Hash of the span, moved to ``place`` (at least ``first``): equal spans moved to one place hash alike."""
        power = _power(place + 1)
        return tuple(
            (int(s[last]) - int(s[first])) * int(p[place - first]) % m
            for s, p, m in zip(self.sums, power, MODULI, strict=True)
        )

    def whole(self) -> int:
        return int(self.sums[0][-1]) << 31 | int(self.sums[1][-1])

    def sketch(self) -> np.ndarray:
        """The ``SKETCH`` least distinct hashes of all spans of ``SPAN`` code points; of the whole if it is shorter."""
        if not self.size:
            return np.empty(0, np.int64)
        width, s, modulus = min(SPAN, self.size), self.sums[0], MODULI[0]
        found = (s[width:] - s[:-width]) % modulus
        # Move every span to the same place: the power falls as the position grows.
        found = found * _power(self.size + 1)[0][self.size - width :: -1] % modulus
        # A power that depends on the length would tell equal spans of two texts apart; divide it out.
        found = found * pow(int(_powers[0][self.size - width]), -1, modulus) % modulus
        least = found if len(found) <= 4 * SKETCH else np.partition(found, 4 * SKETCH)[: 4 * SKETCH]
        least = np.unique(least)
        if len(least) < SKETCH:
            least = np.unique(found)
        return least[:SKETCH]

    def fingerprint(self) -> str:
        """Length and hash of the whole, then the sketch, as hex digits."""
        return f"{self.size:08x}{self.whole():016x}" + "".join(f"{v:08x}" for v in self.sketch().tolist())


def common_extension(a: Prefixes, b: Prefixes, i: int = 0, j: int = 0) -> int:
    """Code points that the texts share from positions ``i`` and ``j`` on, by binary search."""
    low, high = 0, min(a.size - i, b.size - j)
    place = max(i, j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle, place) == b.span(j, j + middle, place):
            low = middle
        else:
            high = middle - 1
    return low


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Jaccard) of two fingerprints: that of the least hashes of their union."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(24, len(f), 8)} for f in (a, b))
    if not x or not y:
        return 0.0
    union = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in union) / len(union)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, shared_prefix long"
)


def _record(doc: int | None, text: str, own: Prefixes, mark: str, after: str, after_mark: str) -> tuple:
    edited = edit(text, after)
    other = Prefixes(edited)
    other_mark = other.fingerprint()
    return (doc, own.size, hashlib.sha256(edited.encode()).hexdigest(), mark, other_mark, likeness(mark, other_mark),
            likeness(mark, after_mark), common_extension(own, other))


def _rows(records: list[tuple]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split(" ")[1]] for c in SCHEMA.split(", ")]
    columns = zip(*records, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every document but the partition's last, which needs the next partition."""
    last = None
    for batch in batches:
        records = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = Prefixes(text)
            mark = own.fingerprint()
            if last:
                records.append(_record(*last, text, mark))
            last = doc, text, own, mark
        if records:
            yield _rows(records)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last document of a partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first if first is not None else batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1)
    if first is not None:
        columns = [pa.concat_arrays([first.column(i), last.column(i)]) for i in (0, 1, 2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([True, False])], names=["doc_id", "text", "part", "head"])


def _joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = []
        for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Prefixes(text)
            records.append(_record(doc, text, own, own.fingerprint(), after, Prefixes(after).fingerprint()))
        if records:
            yield _rows(records)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness to each other and to the next document's.

    The next document is that of ascending doc_id, the first one after the last.
    A null text is empty, and an empty text's fingerprint has no sketch: it is
    like itself (1) and unlike any other (0). Rows without doc_id come first,
    rows of one doc_id by the hash of their text. Extra columns are ignored, an
    empty table gives an empty result, and a single document follows itself.
    Texts cross the network once, into ranges of doc_id; only the two documents at
    each border of ranges meet again.
    """
    spark = docs.sparkSession
    bounded(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # With a fixed number the adaptive plan leaves the ranges as they are, so both readers see the same.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    numbered = placed.withColumn("part", F.spark_partition_id())
    ends = numbered.mapInArrow(_ends, "doc_id long, text string, part int, head boolean")
    # Two rows a range: their order is found on the numbers of the ranges alone.
    numbers = ends.where("head").select("part").withColumn(
        "after", F.lead("part").over(Window.orderBy("part"))
    ).withColumn("first", F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    numbers = numbers.select("part", F.coalesce("after", "first").alias("after"))
    heads = ends.where("head").select(F.col("part").alias("after"), F.col("text").alias("next"))
    open_ = ends.where("not head").join(numbers, "part").join(heads, "after").select("doc_id", "text", "next")
    return placed.mapInArrow(_along, SCHEMA).unionByName(open_.mapInArrow(_joints, SCHEMA))
