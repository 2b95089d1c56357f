import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowquarry.llm import packing
from flowquarry.llm.queries import packed_documents


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, ids_of, window=2048):
    """Every id of every document lies in one piece; sequences are gapless and full, or of a power of two."""
    sequences, found = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        found[r.doc_id].append(r)
        part = ids_of[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and r.doc_tokens == len(ids_of[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        total = sum(r.length for r in own)
        assert total <= window and total & (total - 1) == 0
    for doc, ids in ids_of.items():
        own = sorted(found[doc], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(ids)


def test_query_against_whole_tokenizer(spark, folder, encode):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(packed_documents(spark, folder).collect(), {d: encode(t) for d, t in docs.items()})


def test_words_encode_as_in_whole_texts(encode):
    texts = ["It's <|endoftext|> o'clock, ÀÉ é naïve", "Ångstrom  x y\u0085z\x1cq", "漢字 한국어 🙂🙂 ..,, 123a4", None, "  "]
    shard = packing.Shard(pa.array(texts), packing.WordEncoder(packing.default_tokenizer()))
    for i, text in enumerate(texts):
        assert shard.ids[shard.starts[i] : shard.ends[i]].tolist() == encode(text)


def test_scores_are_bm25():
    texts = ["a b c c", "a c d", "e f", "g h", "b b x", "y z", None]
    shard = packing.Shard(pa.array(texts), packing.WordEncoder(packing.default_tokenizer()))
    words = [(t or "").split() for t in texts]
    n, mean = len(texts), sum(map(len, words)) / len(texts)

    def score(query, doc):
        out = 0.0
        for term in set(query):
            df, tf = sum(term in w for w in words), Counter(doc)[term]
            if 1 < df < n / 2 and tf:
                norm = tf + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)
                out += math.log((n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / norm
        return out

    for i in range(n):
        assert shard.scores(i) == pytest.approx([score(words[i], words[j]) for j in range(n)], rel=1e-5)


def test_windows_hold_neighbours(spark):
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(4)]
    rows = [(i, " ".join(topics[i % 4][(i + k) % 30] for k in range(20))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, window=256).collect()
    by = defaultdict(set)
    for r in pieces:
        assert len(r.ids) == r.length
        by[r.sequence_id].add(r.doc_id % 4)
    assert sum(map(len, by.values())) / len(by) < 2  # chance would mix nearly all four topics


def test_edge_rows(spark, encode):
    long_text = "whale " * 40000
    rows = [(1, None), (2, ""), (3, " \n "), (4, long_text), (5, "x"), (None, "lost words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as length")
    check(packing.pack(docs, with_ids=False).collect(), {i: encode(t) for i, t in rows})
    twice = packing.pack(docs.where("doc_id = 5").union(docs.where("doc_id = 5"))).collect()
    assert sum(r.length for r in twice) == 2 * len(encode("x"))
    assert packing.pack(docs.where("1 = 0")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, window=100)
