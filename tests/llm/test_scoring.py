import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import scoring
from flowquarry.llm.queries import scored_documents
from flowquarry.llm.succinct import Sequence, Trie, build_sequence, mapped


@pytest.mark.parametrize("top", [1, 255, 2**20, 2**41, 2**64 - 1])
def test_sequences(top):
    random.seed(top)
    for n in (0, 1, 2, 1000):
        values = np.array(sorted(random.randint(0, top) for _ in range(n)), np.uint64)
        made = Sequence(build_sequence(values))
        assert (made[np.arange(n)] == values).all()
        asked = np.array([random.randint(0, top) for _ in range(300)] + values.tolist(), np.uint64)
        if n:
            assert (made.successor(asked) == np.searchsorted(values, asked)).all()
        first = np.array([random.randint(0, n) for _ in asked], np.int64)
        last = np.array([random.randint(f, n) for f in first], np.int64)
        if n:
            want = [f + np.searchsorted(values[f:e], x) for x, f, e in zip(asked, first, last, strict=True)]
            assert (made.successor(asked, first, last) == want).all()


def test_trie():
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 2**64, 500, np.uint64))
    pairs = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 400, 3000), rng.integers(0, 2**40, 3000), strict=True)})
    parent, child = np.array([p for p, _ in pairs]), np.array([c for _, c in pairs], np.uint64)
    alone, back, gain = rng.normal(size=len(words)), rng.normal(size=len(words)), rng.random(len(pairs))
    trie = Trie(mapped(Trie.build(words, alone, back, parent, child, gain)))
    assert (trie.find(words) == np.arange(len(words))).all() and (trie.find(words + np.uint64(1)) == -1).all()
    assert np.allclose(trie.gains(parent, child), gain, atol=1e-4)
    assert (trie.gains(np.array([3, -1]), child[:2] + np.uint64(1)) == 0).all()
    assert np.allclose(trie.values(np.arange(len(words)))[0], alone, atol=1e-3)
    empty = Trie(mapped(Trie.build(words[:0], alone[:0], back[:0], parent[:0], child[:0], gain[:0])))
    assert (empty.find(words) == -1).all() and (empty.gains(np.array([-1]), child[:1]) == 0).all()


def plain(docs, learn, prior=scoring.PRIOR):
    """{doc: (tokens, known, N, base, score)} from dictionaries."""
    tokens = {d: [w.lower() for w in (t or "").encode().split()] + [None] for d, t in docs.items()}
    ones, twos, starts = Counter(), Counter(), 0
    for d in docs:
        if learn(d):
            starts += 1
            ones.update(tokens[d])
            twos.update(zip([0, *tokens[d]], tokens[d], strict=False))
    total, kinds = sum(ones.values()), len(ones)
    out = {}
    for d, own in tokens.items():
        base = sum(math.log10((ones[w] + 1) / (total + kinds + 1)) for w in own)
        score = 0.0
        for v, w in zip([0, *own], own, strict=False):
            p = (ones[w] + 1) / (total + kinds + 1)
            context = starts if v == 0 else ones[v]
            score += math.log10((twos[v, w] + prior * p) / (context + prior))
        out[d] = (len(own), sum(ones[w] > 0 for w in own), total, base, score)
    return out


def check(rows, want):
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        tokens, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, abs=2e-3 * tokens)


def test_query_against_dictionaries(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    rows = scored_documents(spark, folder).collect()
    check(rows, plain(docs, lambda d: d not in held))
    assert {r.doc_id for r in rows if r.held_out} == held
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_add_up_to_one():
    text = {1: "a b a c a b", 2: "b a a"}
    want = plain(text, lambda d: True)
    ones = {"a", "b", "c", None}
    # After "a": every known word, and one unknown.
    parts = [plain(text | {9: f"a {w}" if w else "a"}, lambda d: d < 9)[9] for w in ["a", "b", "c", "zz"]]
    assert want and len(ones) == 4
    first = plain(text | {9: "a"}, lambda d: d < 9)[9]
    after = [10 ** (p[4] - math.log10(_end(text, w))) for p, w in zip(parts, ["a", "b", "c", "zz"], strict=True)]
    start = 10 ** first[4] / _end(text, "a")
    assert sum(a / start for a in after) + _end(text, "a") == pytest.approx(1)


def _end(text, v, prior=scoring.PRIOR):
    """Probability of the end after ``v``."""
    own = [[*t.split(), None] for t in text.values()]
    ones = Counter(w for ws in own for w in ws)
    twos = Counter(p for ws in own for p in zip(ws, ws[1:], strict=False))
    p = (ones[None] + 1) / (sum(ones.values()) + len(ones) + 1)
    return (twos[v, None] + prior * p) / (ones[v] + prior)


def test_shards_and_frequent_words(spark):
    random.seed(3)
    docs = {i: " ".join(random.choice(["the", "the", "the", "of", f"w{random.randrange(300)}"]) for _ in range(random.randrange(80)))
            for i in range(150)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") % 5 != 1
    want = plain(docs, lambda d: d % 5 != 1)
    for size in (300, 10**9):
        check(scoring.score(table, learn, shard_tokens=size).collect(), want)
    made = scoring.tries(table, learn, shard_tokens=300).collect()
    assert len(made) > 5 and all(Trie(mapped(bytes(r.trie))).words.n == r.words for r in made)


def test_edge_rows(spark):
    rows = [(1, "A b"), (2, None), (3, ""), (4, " \n "), (5, "whale " * 70000), (6, "a b"), (6, "a b"), (None, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as out", "3 as word")
    got = scoring.score(docs, scoring.training()).collect()
    assert len(got) == 8 and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    by = {r.doc_id: r for r in got}
    assert by[None].score == by[6].score == by[1].score and by[None].n_tokens == 3 and by[5].n_tokens == 70001
    assert scoring.score(docs.where("1 = 0"), scoring.training()).count() == 0
    nothing = scoring.score(docs, F.lit(False)).collect()
    assert len(nothing) == 8 and {(r.n_known, r.base_score, round(r.score, 6)) for r in nothing} == {(0, 0.0, 0.0)}
