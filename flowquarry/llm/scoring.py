"""Language-model scores of whole texts: a bigram model with a Dirichlet prior, in sharded Elias-Fano tries.

The probability of a word w after v is (c(vw) + mu p(w)) / (c(v) + mu), with
p(w) = (c(w) + 1) / (N + V + 1) as in the base score. Its logarithm splits into
parts that need one table look-up each and can be added in any order:

    log p(w)  +  log(mu / (c(v) + mu))  +  log(1 + c(vw) / (mu p(w)))

The last part is zero for unseen pairs, and needs nothing about v but the pair's
count. So words with their preceding words are dealt to shards by w, each shard
counts its own pairs, builds its trie and answers for its own occurrences in the
same task, and only sums per document leave it. Words so frequent that they would
fill a shard are dealt by the pair instead; their counts are broadcast, and as
each has more than a quarter of a shard's average there are at most 4 per shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import ROWS_PER_BATCH, bounded, discard, held_out, staged
from flowquarry.llm.succinct import CHILD_BITS, Trie, mapped

#: Weight of the prior, in words: how often a context must be seen to count as much as the words alone.
PRIOR = 400.0
#: Training tokens a shard holds, about.
SHARD_TOKENS = 1_500_000
#: Distinct words a task adds up before it passes them on.
WORDS_HELD = 1_000_000

#: No word has white space, so these hashes are no word's.
END, BEGIN = (xxhash.xxh64_intdigest(mark, 0) for mark in (b"\n", b"\t"))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes, number of every token, tokens per text); A-Z are lower-cased, null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w, 0) for w in words], np.uint64)
    tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if "" in words:  # what white space at the edges of a text leaves
        keep = tokens != words.index("")
        tokens, owner = tokens[keep], owner[keep]
    return hashes, tokens, np.bincount(owner, minlength=len(texts))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word long, count long``: hashes of the words of all texts, and the end, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "count"])

        for batch in batches:
            hashes, tokens, _ = hashed_words(batch.column(0))
            both = np.concatenate((words, hashes, [np.uint64(END)]))
            weights = np.concatenate((counts, np.bincount(tokens, minlength=len(hashes)), [batch.num_rows]))
            words, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, weights).astype(np.int64)
            words, counts = words[counts > 0], counts[counts > 0]
            if len(words) > WORDS_HELD:
                yield out()
                words, counts = words[:0], counts[:0]
        if len(words):
            yield out()

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, count long")
    return found.groupBy("word").agg(F.sum("count").alias("count"))


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    mixed = (words ^ (words >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _deal(shards: int, hot):
    """Rows (shard, batch) of a batch of documents: words, the words before them, and in which documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        # Places of documents in a batch are 16-bit numbers, whatever size of batch the session asks for.
        for batch in (b.slice(i, ROWS_PER_BATCH) for b in batches for i in range(0, b.num_rows, ROWS_PER_BATCH)):
            number += 1
            ids, out, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            hashes, tokens, sizes = hashed_words(texts)
            n, end = len(texts), len(hashes)
            hashes = np.concatenate((hashes, np.array([END, BEGIN], np.uint64)))
            owner = np.repeat(np.arange(n), sizes + 1)
            word = np.full(len(owner), end)
            word[np.arange(len(tokens)) + np.repeat(np.arange(n), sizes)] = tokens
            before = np.concatenate(([end + 1], word[:-1]))
            before[np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))] = end + 1
            # One entry per word, word before it and document, with its count; sorted so.
            key = (word * (end + 2) + before) * n + owner
            key, times = np.unique(key, return_counts=True)
            owner, pair = key % n, key // n
            w, v = hashes[pair // (end + 2)], hashes[pair % (end + 2)]
            at = _shard(hashes, shards)
            frequent = np.isin(hashes, hot.value)
            place = np.where(frequent[pair // (end + 2)], _shard(w ^ (v * np.uint64(3)), shards), at[pair // (end + 2)])
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(shards + 1))
            rows = []
            for shard in range(shards):
                own = order[edges[shard] : edges[shard + 1]]
                if len(own) or not shard:
                    head = pa.array([ids.to_pylist() if not shard else None], pa.list_(pa.int64()))
                    rows.append((shard, w[own].tobytes(), (v[own] >> np.uint64(64 - CHILD_BITS)).astype("<u8").view(np.uint8)
                                 .reshape(-1, 8)[:, : CHILD_BITS // 8].tobytes(), owner[own].astype("<u2").tobytes(),
                                 times[own].astype("<u4").tobytes(), head))
            heads = pa.concat_arrays([r[5] for r in rows])
            flags = np.where(out, 1, 0).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()),
                    *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)),
                    pa.array([flags] * len(rows), pa.binary()), heads,
                    pa.array([(sizes + 1).astype("<u4").tobytes() if not r[0] else None for r in rows], pa.binary()),
                ],
                names=["shard", "batch", "words", "before", "docs", "times", "out", "ids", "sizes"],
            )

    return run


DEALT = ("shard int, batch long, words binary, before binary, docs binary, times binary, out binary, ids array<long>, "
         "sizes binary")
PARTS = "batch long, ids array<long>, out binary, sizes binary, docs binary, known binary, base binary, score binary"


class Shard:
    """Entries of one shard, its counts and its trie."""

    def __init__(self, table: pa.Table, hot: np.ndarray, hot_counts: np.ndarray, total: int, distinct: int, prior: float):
        rows = table.select(["words", "before", "docs", "times", "out"]).to_pylist()
        self.lengths = np.array([len(r["words"]) // 8 for r in rows])
        self.docs = np.frombuffer(b"".join(r["docs"] for r in rows), "<u2")
        self.times = np.frombuffer(b"".join(r["times"] for r in rows), "<u4")
        learnt = [np.frombuffer(r["out"], np.uint8) == 0 for r in rows]
        train = np.concatenate([x[d] for x, d in zip(learnt, np.split(self.docs, np.cumsum(self.lengths)[:-1]), strict=True)]) \
            if len(self.docs) else np.empty(0, bool)
        low = np.frombuffer(b"".join(r["before"] for r in rows), np.uint8).reshape(-1, CHILD_BITS // 8)
        words = np.frombuffer(b"".join(r["words"] for r in rows), "<u8")
        del rows  # arrays as long as the shard go as soon as they can
        self.words, word_at = np.unique(words, return_inverse=True)
        del words
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, : CHILD_BITS // 8] = low
        del low
        keys = keys.view("<u8").reshape(-1)
        keys |= word_at.astype(np.uint64) << np.uint64(CHILD_BITS)
        del word_at
        keys, self.pair_at = np.unique(keys, return_inverse=True)
        self.pair_word = (keys >> np.uint64(CHILD_BITS)).astype(np.int64)
        self.pair_before = keys & np.uint64((1 << CHILD_BITS) - 1)
        pairs = np.bincount(self.pair_at, self.times * train, len(keys))
        counts = np.bincount(self.pair_word, pairs, len(self.words))
        at = np.searchsorted(hot, self.words) if len(hot) else np.zeros(len(self.words), np.int64)
        found = np.zeros(len(self.words), bool) if not len(hot) else hot[np.minimum(at, len(hot) - 1)] == self.words
        counts[found] = hot_counts[at[found]]
        self.counts = counts
        # The model holds what was learnt and nothing else.
        known = counts > 0
        rank = np.cumsum(known) - 1
        alone = np.log10((counts[known] + 1) / (total + distinct + 1))
        back = np.where(self.words[known] == END, 0.0, np.log10(prior / (counts[known] + prior)))
        seen = pairs > 0
        parent = rank[self.pair_word[seen]]
        gain = np.log10(1 + pairs[seen] / (prior * 10 ** alone[parent]))
        self.trie = Trie.build(self.words[known], alone, back, parent, self.pair_before[seen], gain)
        self.sizes = int(known.sum()), int(seen.sum())
        self.unknown = math.log10(1 / (total + distinct + 1))

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, sum of log10(count + 1), sum of log10 probabilities) of every entry, from the mapped trie."""
        trie = Trie(mapped(self.trie))
        ranks = trie.find(self.words)
        one = np.full(len(ranks), self.unknown)
        hit = ranks >= 0
        alone, back = trie.values(ranks[hit])
        one[hit] = alone + back
        whole = one[self.pair_word] + trie.gains(ranks[self.pair_word], self.pair_before)
        word = self.pair_word[self.pair_at]
        return self.times * (self.counts[word] > 0), self.times * np.log10(self.counts[word] + 1), self.times * whole[self.pair_at]


def _model(docs: DataFrame, learn: Column, prior: float, shard_tokens: int):
    """Counts of the corpus, and the dealt entries with a function that makes a shard of a group of them."""
    spark = docs.sparkSession
    bounded(spark)
    counts = staged(word_counts(docs.where(learn)), "words")
    facts = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"),
                       F.coalesce(F.max(F.when(F.col("word") == np.uint64(END).astype(np.int64).item(), F.col("count"))), F.lit(0))).first()
    total, distinct, texts = (int(x) for x in facts)
    shards = max(1, math.ceil(total / shard_tokens))
    frequent = sorted((r.word % 2**64, r["count"]) for r in counts.where(F.col("count") * 4 * shards > total).collect()) if shards > 1 else []
    discard(counts)
    hot, hot_counts = np.array([w for w, _ in frequent], np.uint64), np.array([c for _, c in frequent], np.int64)
    sent = spark.sparkContext.broadcast(hot)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learn).alias("out"), F.col("text").cast("string").alias("text"))
    dealt = rows.mapInArrow(_deal(shards, sent), DEALT)

    def shard(table: pa.Table) -> Shard:
        return Shard(table, hot, hot_counts, total, distinct, prior)

    return dealt, shard, total, distinct, texts


def tries(docs: DataFrame, learn: Column, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The model itself: ``shard, words, pairs, trie``, a compact buffer per shard for ``succinct.Trie``."""
    dealt, shard, *_ = _model(docs, learn, prior, shard_tokens)

    def run(table: pa.Table) -> pa.Table:
        made = shard(table)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "words": [made.sizes[0]],
                         "pairs": [made.sizes[1]], "trie": pa.array([made.trie], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(run, "shard int, words long, pairs long, trie binary")


def score(docs: DataFrame, learn: Column, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, out, n_tokens, n_known, train_tokens, base_score, score`` of every row, learnt from those where ``learn`` holds.

    A text is its words and one end. A null or empty text is the end alone. All
    texts are read whole; rows without doc_id are scored like any other; repeated
    rows count and are scored each; extra columns are ignored. If nothing is learnt
    every token is unknown and has probability 1; an empty table has no scores.
    """
    dealt, shard, total, distinct, texts = _model(docs, learn, prior, shard_tokens)

    def parts(table: pa.Table) -> pa.Table:
        made = shard(table)
        values, ends = made.scores(), np.cumsum(made.lengths)
        rows = []
        for i, (a, b) in enumerate(zip(ends - made.lengths, ends, strict=True)):
            # One sum a document that occurs; docs are below 2^16.
            own, place = np.unique(made.docs[a:b], return_inverse=True)
            known, base, score = (np.bincount(place, v[a:b], len(own)) for v in values)
            rows.append((own.astype("<u2").tobytes(), known.astype("<u4").tobytes(), base.astype("<f8").tobytes(),
                         score.astype("<f4").tobytes()))
        columns = [table.column(c).combine_chunks() for c in ("batch", "ids", "out", "sizes")]
        columns += [pa.array([r[i] for r in rows], pa.binary()) for i in range(4)]
        return pa.Table.from_arrays(columns, names=[c.split(" ")[0] for c in PARTS.split(", ")])

    first = math.log10(prior / (texts + prior))

    def sums(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        n = len(head["ids"])
        known, base, score = np.zeros(n, np.int64), np.zeros(n), np.full(n, first)
        for r in sorted(rows, key=lambda r: r["docs"]):  # in a fixed order, as sums of floats depend on it
            at = np.frombuffer(r["docs"], "<u2")
            known[at] += np.frombuffer(r["known"], "<u4")
            base[at] += np.frombuffer(r["base"], "<f8")
            score[at] += np.frombuffer(r["score"], "<f4")
        tokens = np.frombuffer(head["sizes"], "<u4").astype(np.int64)
        base -= tokens * math.log10(total + distinct + 1)
        out = np.frombuffer(head["out"], np.uint8) == 1
        return pa.Table.from_arrays(
            [pa.array(head["ids"], pa.int64()), pa.array(out), pa.array(tokens), pa.array(known), pa.array(np.full(n, total)),
             pa.array(base), pa.array(score)],
            names=["doc_id", "out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    made = dealt.groupBy("shard").applyInArrow(parts, PARTS)
    schema = "doc_id long, out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return made.groupBy("batch").applyInArrow(sums, schema)


def training(modulus: int = 7) -> Column:
    """Rows to learn from: those with a doc_id that is not held out."""
    return F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus)
