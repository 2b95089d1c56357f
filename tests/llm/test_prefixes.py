import hashlib
import random

import pytest

from flowquarry.llm import prefixes
from flowquarry.llm.prefixes import Prefixes, common_extension, edit, likeness
from flowquarry.llm.queries import fingerprinted_documents


def plain_hash(text):
    """The hash of a text from its definition."""
    return tuple(sum((ord(c) + 1) * pow(b, i, m) for i, c in enumerate(text)) % m
                 for b, m in zip(prefixes.BASES, prefixes.MODULI, strict=True))


def plain_sketch(text):
    if not text:
        return []
    width = min(prefixes.SPAN, len(text))
    return sorted({plain_hash(text[i : i + width])[0] for i in range(len(text) - width + 1)})[: prefixes.SKETCH]


def test_spans_and_extensions():
    random.seed(1)
    a = "".join(random.choice("aé漢🙂") for _ in range(300))
    b = a[50:200] + "x" + a[201:]
    x, y = Prefixes(a), Prefixes(b)
    assert (x.whole() >> 31, x.whole() & 0x7FFFFFFF) == plain_hash(a)
    for _ in range(300):
        i, j, n = random.randrange(200), random.randrange(100), random.randrange(60)
        same = x.span(i, i + n, 300) == y.span(j, j + n, 300)
        assert same == (a[i : i + n] == b[j : j + n])
        want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert common_extension(x, y, i, j) == want
    assert common_extension(x, y, 50, 0) == 150
    for text in (a, a[:5], "", "ab" * 500, a * 20):
        assert Prefixes(text).sketch().tolist() == plain_sketch(text)


def test_likeness():
    random.seed(2)
    a = "".join(random.choice("abcdefgh ") for _ in range(4000))
    marks = [Prefixes(t).fingerprint() for t in (a, a[:2000] + a[2100:], a[::-1], "", "")]
    assert likeness(marks[0], marks[0]) == 1 and likeness(marks[0], marks[1]) > 0.8
    assert likeness(marks[0], marks[2]) == 0 and likeness(marks[3], marks[4]) == 1 and likeness(marks[0], marks[3]) == 0


def plain(docs):
    """Every column from its definition; docs are (doc_id, text) in order."""
    out = []
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        edited = edit(text, after)
        marks = [Prefixes(t).fingerprint() for t in (text, edited, after)]
        shared = next((k for k, (p, q) in enumerate(zip(text, edited, strict=False)) if p != q), min(len(text), len(edited)))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
                    likeness(marks[0], marks[1]), likeness(marks[0], marks[2]), shared))
    return out


def test_query_against_plain_python(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = sorted(tuple(r) for r in fingerprinted_documents(spark, folder).collect())
    assert got == plain(docs)
    marks = {}
    for (_, text), row in zip(docs, got, strict=True):
        assert marks.setdefault(text, row[3]) == row[3]
    assert len(set(marks.values())) == len(marks)


@pytest.mark.parametrize("rows", [[(5, "only one é text")], [(None, "x" * 40), (1, None), (2, ""), (3, "ab"), (9, "long " * 50000)], []])
def test_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as next", "2 as part")
    got = sorted((tuple(r) for r in prefixes.fingerprints(docs).collect()), key=lambda r: r[0] or 0)
    assert got == plain(rows)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text " * 9)] * 3 + [(2, "other")], "doc_id long, text string")
    got = prefixes.fingerprints(docs).collect()
    assert len(got) == 4 and sorted(r.near_next for r in got) == [0, 0, 1, 1]
