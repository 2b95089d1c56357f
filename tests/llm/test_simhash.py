import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from flowquarry.llm import simhash
from flowquarry.llm.components import connected
from flowquarry.llm.queries import near_documents


def plain_simhash(text, k=3):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_query_against_brute_force(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    marks = {d: plain_simhash(t) for d, t in docs.items()}
    near = [(a, b) for a in docs for b in docs if a < b and (marks[a] ^ marks[b]).bit_count() <= 3]
    want = plain_components(docs, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_documents(spark, folder).collect()}
    assert got == {d: (f"{marks[d]:016x}", want[d]) for d in docs}


@pytest.mark.parametrize("size", [12, 300, 3000])
def test_links_of_clustered_fingerprints(spark, size):
    random.seed(size)
    marks = set()
    while len(marks) < size:
        mark = random.choice([0, 2**63 + 5, 0x0123456789ABCDEF])
        for _ in range(random.randrange(4 if size < 1000 else 9)):
            mark ^= 1 << random.randrange(64 if size < 1000 else 20)
        marks.add(mark)
    signed = [m - 2**64 if m >> 63 else m for m in marks]
    links = simhash.near_links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    got = plain_components(marks, [(r.a % 2**64, r.b % 2**64) for r in links.collect()])
    order = sorted(marks)
    want = plain_components(marks, [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if (a ^ b).bit_count() <= 3])
    assert got == want


def test_long_lists_over_both_signs():
    """Lists as Spark sorts them, by the signed fingerprint, several in one partition; partners may differ in bits 56 to 63."""
    random.seed(11)
    lists = []
    for _ in range(3):
        marks = {random.getrandbits(24) << 40 for _ in range(900)}
        marks |= {m ^ 1 << random.randrange(40, 48) ^ 1 << random.randrange(48, 56) ^ 1 << random.randrange(56, 64) for m in marks}
        lists.append(np.sort(np.array(list(marks), np.uint64).view(np.int64)))
    keys = np.repeat(np.arange(3), [len(x) for x in lists])
    postings = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(lists))], names=["key", "fp"])
    links = pa.Table.from_batches(simhash._links(3)(iter([postings]))).to_pandas()
    got = plain_components(set(np.concatenate(lists).tolist()), zip(links.a.tolist(), links.b.tolist(), strict=True))
    for marks in lists:
        left, right = np.nonzero(np.triu(np.bitwise_count(marks.view(np.uint64)[:, None] ^ marks.view(np.uint64)) <= 3, 1))
        assert len(left) >= 800 and all(got[a] == got[b] for a, b in zip(marks[left].tolist(), marks[right].tolist(), strict=True))


def test_components_of_chains_and_stars(spark):
    random.seed(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(100)] + [(5000, 5001), (5001, 5000), (9, 9)]
    random.shuffle(edges)
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(100)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 303
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    long_text = "alpha beta gamma delta epsilon " * 30000  # an odd number of shingles: no bit is near half
    rows = [(7, "a b c d e"), (3, "A B\tC\nd e"), (9, None), (8, ""), (8, ""), (1, "x"), (None, "a b c d e"),
            (20, long_text), (21, long_text + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as kept", "3 as component_id")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (1, 1), (3, 3), (7, 3), (8, 8), (8, 8), (9, 8), (20, 20), (21, 20)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 8, 20]
    assert simhash.near_duplicates(docs.where("1 = 0")).count() == 0
    assert simhash.deduplicate(docs.where("1 = 0")).count() == 0
