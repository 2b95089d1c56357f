"""Phrase collocations by stripes: every prefix keys a counter of the words that follow it.

A stripe is a prefix of up to three words with its next words and their counts.
Tasks make stripes of their own texts, the stripes of one prefix meet and are
added up word by word, and the sums hold everything: the counts of a prefix's
extensions, the most frequent one, which decides whether a longer phrase makes the
prefix redundant, and each prefix's own count, which is its entry in the stripe of
its first words. The empty prefix counts the words.

A phrase cannot be more frequent than its parts. So each pass over the texts only
counts phrases whose both parts of one word less were found frequent by the pass
before; tasks know those from a bitmap of 16 to 32 bits a counted part, ``MOST_BITS``
at most. False hits, also those of a full bitmap, cost time and are dropped by
their counts.

Stripes that begin with a word whose pairs reach 1/1024 of all words (there cannot
be more than 1024 such words) are cut into ``PARTS`` by next word before they meet, as
that of the empty prefix is. Words are 64-bit keys until the phrases are chosen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded, discard, staged

LONGEST = 4
LEAST = 30
FIRST = 2000
COVERED = 80
UNKNOWN = "und"

#: Bytes of text of one language whose stripes are made at once.
BLOCK = 6 << 20
PARTS = 64
HEAVY = 1024
MOST_BITS = 1 << 28
#: Stands for no word; no key has this value.
NONE = 0

PREFIX = ["p1", "p2", "p3"]
STRIPES = "lang string, p1 long, p2 long, p3 long, part int, word string, nexts array<long>, counts array<long>"
MERGED = "lang string, p1 long, p2 long, p3 long, part int, word string, total long, best long, nexts array<long>, counts array<long>"

_BYTE = np.random.default_rng(11).integers(1, 2**64, 256, np.uint64)
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09]] = 0
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 1
_EDGE = re.compile(rb"[ .,;:!?\x09-\x0d]")

Member = Callable[[np.ndarray], np.ndarray]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """One key for each phrase, given as a column per word; that of a single word is the word's."""
    key = words[0]
    for word in words[1:]:
        key = _mix(_mix(key.view(np.uint64)) + word.view(np.uint64)).view(np.int64)
    return key


class Words:
    """Keys of the words of a block, the piece each lies in (from 0), the pieces that end, and where words stand."""

    def __init__(self, data: bytes, lang: str):
        codes = np.frombuffer(data, np.uint8)
        kind = _KIND[codes]
        inside = kind == 2
        turns = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        self.data, self.start, self.end = data, turns[::2], turns[1::2]
        ended = np.cumsum(kind == 1)
        self.piece = ended[self.start]
        self.ended = int(ended[-1]) if len(ended) else 0
        size = self.end - self.start
        begin = np.cumsum(size) - size
        self.key = np.empty(0, np.int64)
        if len(size):
            # An odd random factor a place: no two words are alike by their structure.
            factor = _mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            at = np.arange(int(size.sum())) - np.repeat(begin, size)
            sums = np.add.reduceat(_BYTE[codes[inside]] * factor[at], begin)
            seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
            key = _mix(sums + seed).view(np.int64)
            self.key = np.where(key == NONE, 1, key)


def _extended(prefix: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense numbers of (prefix number, word number) pairs, and the prefix and word of each number."""
    pairs, number = np.unique(prefix * words + word, return_inverse=True)
    return number, pairs // words, pairs % words


def _known(words: Words, length: int, member: Member | None, tail: tuple | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the words, where a known phrase of ``length`` words begins, and how many words a block before had counted."""
    key, piece, skip = words.key, words.piece, 0
    if tail is not None:
        key, piece, skip = np.concatenate((tail[0], key)), np.concatenate((tail[1], piece)), len(tail[0])
    known = np.zeros(len(key), bool)
    at = np.arange(max(len(key) - length + 1, 0))
    if length > 1:
        at = at[piece[at] == piece[at + length - 1]]
    if length:
        known[at] = member(gram_keys([key[at + k] for k in range(length)]))
    if length == 1:  # longer phrases that overlap lie in one piece anyway
        known[:-1] &= piece[1:] == piece[:-1]
    return key, known, skip


def block_stripes(words: Words, length: int, member: Member | None, tail: tuple | None = None) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Prefix columns, next words and counts of the entries of a block whose prefixes have ``length`` words.

    A phrase counts where its last word stands, if the phrases of ``length`` words
    at its begin and its end are members. With ``tail``, the last words of the
    block before, the block continues a text.
    """
    key, known, skip = _known(words, length, member, tail)
    if length == 0:
        nexts, count = np.unique(key[skip:], return_counts=True)
        return (np.zeros(len(nexts), np.int64),) * 3, nexts, count
    if length == 1:
        at = np.flatnonzero(known[:-1])
        at = at[member(key[at + 1])]
    else:
        at = np.flatnonzero(known[:-1] & known[1:])
    at = at[at + length >= skip]
    distinct, number = np.unique(np.concatenate([key[at + k] for k in range(length + 1)]), return_inverse=True)
    number = number.reshape(length + 1, -1)
    current, tables = number[0], []
    for k in range(1, length + 1):
        current, *table = _extended(current, number[k], max(len(distinct), 1))
        tables.append(table)
    count = np.bincount(current)
    picked, columns = np.arange(len(count)), []
    for prefix, word in reversed(tables):
        columns.append(distinct[word[picked]])
        picked = prefix[picked]
    columns.append(distinct[picked])
    nexts, *prefix = columns
    return (*prefix[::-1], *[np.zeros(len(count), np.int64)] * (3 - length)), nexts, count


def _as_rows(lang: str, prefix: tuple, nexts: np.ndarray, counts: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch | None:
    """Entries as a row per prefix and part; a heavy prefix has ``PARTS`` of them, by next word."""
    part = np.where(np.isin(prefix[0], heavy), (nexts.view(np.uint64) % np.uint64(PARTS)).astype(np.int64), -1)
    if not len(nexts):
        return None
    order = np.lexsort((nexts, part, *prefix[::-1]))
    columns = [x[order] for x in (*prefix, part)]
    begins = np.append(True, np.any([x[1:] != x[:-1] for x in columns], axis=0))
    return _batch([lang] * int(begins.sum()), [x[begins] for x in columns], None, [], np.flatnonzero(begins), nexts[order], counts[order])


def _batch(langs: list, columns: list, words: list | None, extra: list, begins: np.ndarray, nexts, counts) -> pa.RecordBatch:
    edge = pa.array(np.append(begins, len(nexts)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int64))) for x in (nexts, counts)]
    columns = [*[pa.array(x.astype(np.int64)) for x in columns[:3]], pa.array(columns[3].astype(np.int32))]
    names = [*PREFIX, "part", "word", *(("total", "best") if extra else ()), "nexts", "counts"]
    word = pa.array(words or [None] * len(langs), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), *columns, word, *[pa.array(x.astype(np.int64)) for x in extra], *lists], names=["lang", *names]
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words, tuple | None]]:
    """Blocks of text of one language: short texts together, long ones in slices that know the last words before."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, data = lang.as_py(), (text.as_py() or "").encode().lower()
            if len(data) <= BLOCK:
                held.setdefault(lang, []).append(data)
                size += len(data)
            else:
                tail, begin = None, 0
                while begin < len(data):
                    edge = _EDGE.search(data, begin + BLOCK)
                    end = edge.start() if edge else len(data)
                    words = Words(data[begin:end], lang)
                    yield lang, words, tail
                    last = words.key, words.piece - words.ended
                    if tail is not None:
                        last = tuple(np.concatenate(x) for x in zip((tail[0], tail[1] - words.ended), last, strict=True))
                    tail, begin = tuple(x[1 - LONGEST :] for x in last), end
            if size > BLOCK:
                yield from ((lang, Words(b"\n".join(texts), lang), None) for lang, texts in held.items())
                held, size = {}, 0
    yield from ((lang, Words(b"\n".join(texts), lang), None) for lang, texts in held.items())


def _stripes(docs: DataFrame, length: int, bitmap=None, heavy: list[int] | None = None) -> DataFrame:
    """The stripes of every task, unmerged; with pairs also the words in them, as rows with ``word`` (once a task)."""
    whole = np.array([NONE] if length == 0 else heavy, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, sent = None, np.empty(0, np.int64)
        if bitmap is not None:
            bits = np.frombuffer(bitmap.value, np.uint8)

            def member(keys: np.ndarray) -> np.ndarray:
                return in_bitmap(bits, keys)

        for lang, words, tail in _blocks(batches):
            made = _as_rows(lang, *block_stripes(words, length, member, tail), whole)
            if made is not None:
                yield made
            if length == 2:
                key, known, skip = _known(words, length, member, tail)
                wanted = (known | np.append(False, known[:-1])[: len(key)])[skip:]
                if skip:  # the words of the tail were in a block that may not have known them
                    wanted |= np.isin(words.key, key[:-1][known[:-1]]) | np.isin(words.key, key[1:][known[:-1]])
                here, at = np.unique(words.key[wanted], return_index=True)
                fresh = ~np.isin(here, sent)
                here, at = here[fresh], np.flatnonzero(wanted)[at[fresh]]
                if len(here):
                    sent = np.union1d(sent, here)
                    spelt = [words.data[s:e].decode() for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
                    zero = np.zeros(len(here), np.int64)
                    yield _batch([lang] * len(here), [here, zero, zero, zero - 2], spelt, [], zero, zero[:0], zero[:0])

    return docs.mapInArrow(run, STRIPES)


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of the same prefix and part added up, entries under ``least`` left out, with total and largest entry.

    The rows of one prefix come one after the other, so a task holds an Arrow
    batch of them and the sum so far.
    """
    keys = ["lang", *PREFIX, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            done, rest = _added(table, keys)
            held = rest.to_batches()
            yield from _finished(done, least)
        for batch in held:
            yield from _finished(_added(pa.Table.from_batches([batch]), keys, close=True)[0], least)

    dealt = stripes.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, MERGED)


def _added(table: pa.Table, keys: list[str], close: bool = False) -> tuple[pa.Table, pa.Table]:
    """Rows of the same stripe added up, all but the last stripe and that one, which may go on."""
    table = table.combine_chunks()
    columns = [table.column(c).to_numpy() for c in (*PREFIX, "part")]
    langs = np.asarray(table.column("lang").combine_chunks().dictionary_encode().indices)
    changes = [x[1:] != x[:-1] for x in (*columns, langs)]
    begins = np.append(True, np.any(changes, axis=0))
    nexts, counts = (table.column(c).combine_chunks() for c in ("nexts", "counts"))
    sizes = np.diff(nexts.offsets.to_numpy())
    owner = np.repeat(np.cumsum(begins) - 1, sizes)
    nexts, counts = (x.flatten().to_numpy() for x in (nexts, counts))
    order = np.lexsort((nexts, owner))
    owner, nexts = owner[order], nexts[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (nexts[1:] != nexts[:-1]))[: len(order)]
    at = np.flatnonzero(fresh)
    counts = np.add.reduceat(counts[order], at) if len(at) else counts
    owner, nexts = owner[fresh], nexts[fresh]
    edge = np.searchsorted(owner, np.arange(int(begins.sum()) + 1)).astype(np.int32)
    rows = table.select(["lang", *PREFIX, "part", "word"]).take(pa.array(np.flatnonzero(begins)))
    for name, values in (("nexts", nexts), ("counts", counts)):
        rows = rows.append_column(name, pa.ListArray.from_arrays(pa.array(edge), pa.array(values)))
    cut = rows.num_rows if close else rows.num_rows - 1
    return rows.slice(0, cut), rows.slice(cut).combine_chunks()


def _finished(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Sum of the counts, largest entry and the entries of ``least`` or more; stripes without any go, but for words of all."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    lists = [rows.column(c).combine_chunks() for c in ("nexts", "counts")]
    sizes = np.diff(lists[0].offsets.to_numpy())
    owner = np.repeat(np.arange(rows.num_rows), sizes)
    nexts, counts = (x.flatten().to_numpy() for x in lists)
    total, best = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    np.add.at(total, owner, counts)
    kept = counts >= least
    np.maximum.at(best, owner[kept], counts[kept])
    stays = (best > 0) | (rows.column("p1").to_numpy() == NONE) | (rows.column("part").to_numpy() == -2)
    number = np.cumsum(stays) - 1
    begins = np.searchsorted(number[owner[kept]], np.arange(int(stays.sum())))
    columns = [rows.column(c).to_numpy()[stays] for c in (*PREFIX, "part")]
    words = rows.column("word").filter(pa.array(stays)).to_pylist()
    langs = rows.column("lang").filter(pa.array(stays)).to_pylist()
    if langs:
        yield _batch(langs, columns, words, [total[stays], best[stays]], begins, nexts[kept], counts[kept])


def key_bitmap(keys: DataFrame, most: int):
    """A broadcast bitmap of the column ``key``, of 16 bits or more a key and at most ``most``."""
    count = keys.count()
    bits = min(most, 1 << max(16, (16 * count - 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    # A power of two up to 2^28: the sums of 32 bits reach the driver, never keys.
    cells = keys.groupBy(F.shiftright(place, 5).cast("int").alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((key & {bits - 1}) & 31 as int))")).alias("set")
    )
    image = np.zeros(bits // 32, np.uint32)
    for batch in cells.toArrow().to_batches():
        image[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(image.tobytes())


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys hit a bitmap of :func:`key_bitmap`, given as bytes."""
    at = keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _entries(merged: DataFrame) -> DataFrame:
    """``lang, p1, p2, p3, next, a`` of every kept entry."""
    both = F.explode(F.arrays_zip("nexts", "counts")).alias("e")
    return merged.where("part > -2").select("lang", *PREFIX, both).select("lang", *PREFIX, F.col("e.nexts").alias("next"), F.col("e.counts").alias("a"))


def _heavy(counted: DataFrame, n: int) -> list[int]:
    """Words that begin a phrase with 1/1024 of all occurrences or more; there are at most 1024."""
    found = counted.groupBy("p1").agg(F.max("a").alias("a")).where(F.col("a") * HEAVY >= n).select("p1").collect()
    return [row[0] for row in found]


def _gram_key(*words: str) -> Column:
    """:func:`gram_keys` as a column."""

    @F.arrow_udf("long")
    def gram_key(*columns: pa.Array) -> pa.Array:
        return pa.array(gram_keys([c.to_numpy() for c in columns]))

    return gram_key(*words)


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, covered: int = COVERED, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``first`` best phrases of each language.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty); other columns
    are not read, so their names cannot clash. A-Z are lower-cased, texts are split at
    ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``;
    phrases of 2 to 4 words lie within a piece. A phrase counts ``a`` = ``least``
    occurrences or more, overlapping ones too; its score is
    ``floor(2000000 a / (l + r))`` at the cut of lowest score (ties: the first
    cut), ``l`` and ``r`` being the counts of the parts, in exact decimals. Phrases that
    lie in a longer phrase with ``covered`` percent of their count or more go.
    Order: score and ``a`` falling, then the phrase's UTF-8 bytes. Long texts are
    read whole, in slices; repeated rows count as often as they come; an empty table,
    or one without frequent phrases, gives no rows. Distinct words share a 64-bit
    key with a probability of 2^-64 a pair; a chosen key with two words is an error.
    """
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    words = staged(_merged(_stripes(texts, 0), least), "words")
    sizes = words.groupBy("lang").agg(F.sum("total").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    longer, counted = [], _entries(words).select(F.col("next").alias("p1"), "a")
    for length, key in enumerate((F.col("p1"), _gram_key("p1", "next"), _gram_key("p1", "p2", "next")), 1):
        seen = key_bitmap(counted.select(key.alias("key")), most_bits)
        made = _merged(_stripes(texts, length, seen, _heavy(counted, n)), least)
        longer.append(staged(made, f"stripes-{length}"))
        seen.unpersist()
        counted = _entries(longer[-1])
    found = staged(_ranked(words, reduce(DataFrame.unionByName, longer), first, covered), "phrases")
    spelt = longer[1].where("part = -2").select(F.col("p1").alias("key"), "word")
    out = _spelt(found, spelt, first).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
    out = staged(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(words, *longer, found)
    return out


def _ranked(words: DataFrame, stripes: DataFrame, first: int, covered: int) -> DataFrame:
    """The best ``first`` of each language and all that tie with the last of them, as keys w1 to w4."""
    none = F.lit(0).cast("long")
    entries = _entries(stripes)
    size = F.when(F.col("p2") == 0, 2).when(F.col("p3") == 0, 3).otherwise(4)
    phrases = entries.select("lang", F.array(*PREFIX).alias("p"), "next", "a", size.alias("size"))
    phrase = F.concat(F.slice("p", F.lit(1), F.col("size") - 1), F.array("next"))
    phrases = phrases.select("lang", phrase.alias("w"), "a", "size")

    # Counts of one to three words: entries of shorter prefixes.
    def part(begin, count):
        return F.struct(*[F.when(F.lit(k) < count, F.get("w", begin + k)).otherwise(none).alias(f"w{k + 1}") for k in range(3)])

    counted = _entries(words).select(F.struct(F.col("next").alias("w1"), none.alias("w2"), none.alias("w3")).alias("part"), "a")
    counted = counted.union(phrases.where("size < 4").select(part(F.lit(0), F.col("size")), "a"))
    cuts = phrases.select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(0), F.col("k")).alias("left"), part(F.col("k"), F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(counted.toDF("left", "l"), "left").join(counted.toDF("right", "r"), "right")
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    scored = cuts.groupBy("lang", "w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The most frequent extension to the right is the stripe's own; those to the left are entries of other stripes.
    right = stripes.where("part > -2 AND p2 <> 0").select(F.array(*PREFIX).alias("p"), "best")
    right = right.select(F.filter("p", lambda x: x != 0).alias("w"), "best")
    left = phrases.where("size > 2").select(F.slice("w", F.lit(2), F.col("size") - 1).alias("w"), F.col("a").alias("best"))
    best = right.union(left).groupBy("w").agg(F.max("best").alias("best"))
    fresh = scored.join(best, "w", "left").where(
        F.expr(f"best IS NULL OR 100 * cast(best as decimal(20, 0)) < {covered} * cast(a as decimal(20, 0))")
    )
    fresh = fresh.select("lang", "w", "a", "cut.score", "cut.l", "cut.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    return fresh.withColumn("place", F.rank().over(order)).where(F.col("place") <= first)


def _spelt(found: DataFrame, spelt: DataFrame, first: int) -> DataFrame:
    """Words in place of keys, and the final order."""
    number = F.struct("lang", "w").alias("id")
    parts = found.select(number, F.posexplode("w").alias("at", "key")).join(spelt.groupBy("key").agg(
        F.min("word").alias("word"), F.max("word").alias("other")), "key")
    parts = parts.select("id", "at", F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(
        F.raise_error(F.lit("two words share a key"))).alias("word"))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    names = parts.groupBy("id").agg(phrase.alias("phrase"))
    rows = found.withColumn("id", F.struct("lang", "w")).join(names, "id")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
