import random
import re
from collections import defaultdict

import numpy as np

from flowquarry.llm import substrings
from flowquarry.llm.substrings import LEAST, SHINGLE, WINDOW

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def plain_paragraphs(docs):
    """{(doc, first, last): source} of whole paragraphs, every pair compared."""
    found = []
    for doc, text in docs.items():
        at = 0
        for line in (text or "").split("\n"):
            spans = list(WORD.finditer(line))
            if len(spans) >= LEAST:
                words = [m.group().encode().lower() for m in spans]
                found.append((doc, at + spans[0].start(), at + spans[-1].end(), shingles(words)))
            at += len(line) + 1
    by = defaultdict(list)
    for i, f in enumerate(found):
        for s in f[3]:
            by[s].append(i)
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for own in by.values():
        for i in own[1:]:
            a, b = found[own[0]][3], found[i][3]
            for j in [own[0]] if len(own) > 50 else own:
                a = found[j][3]
                if find(i) != find(j) and len(a & b) >= 0.8 * len(a | b):
                    root[find(i)] = find(j)
    least = {}
    for i, f in enumerate(found):
        least[find(i)] = min(least.get(find(i), f[0]), f[0])
    return {f[:3]: least[find(i)] for i, f in enumerate(found) if f[0] != least[find(i)]}


def covered(spans):
    out = defaultdict(set)
    for doc, first, last in spans:
        out[doc] |= set(range(first, last))
    return out


def test_bands_are_tuned():
    bands, rows = substrings.tune()
    assert bands <= substrings.MOST_BANDS and (1 - 0.8**rows) ** bands <= substrings.MISS
    assert substrings.tune(1.0) == (1, 64)


def test_units_against_plain_python():
    random.seed(3)
    text = "\n".join(" ".join(random.choice(["é", "Ab", "c", "dd", "ß."]) for _ in range(random.randrange(70))) for _ in range(12))
    text = " \t" + text
    units, words = substrings.Units(text), list(WORD.finditer(text))
    assert [text[a:b] for a, b in zip(units.start, units.end, strict=True)] == [m.group() for m in words]
    same = substrings.Units("x y " + text)
    assert (same.shingles[2:] == units.shingles).all() and len(np.unique(units.shingles)) == len(
        shingles([m.group().encode().lower() for m in words]))
    gaps = np.diff(np.concatenate((units.anchors, [len(words)])))
    assert units.anchors[0] < WINDOW and gaps[:-1].max() <= WINDOW


def test_query_holds_all_repeated_paragraphs(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = substrings.repeated_spans(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    got = covered((r.doc_id, r.first, r.last) for r in rows)
    want = plain_paragraphs(docs)
    missed = [k for k in want if not set(range(k[1], k[2])) <= got[k[0]]]
    assert len(missed) <= 0.01 * len(want)
    # Whatever goes is part of a repeated paragraph, or its words stand in an earlier document too.
    lower = {d: b" ".join(w.encode().lower() for w in WORD.findall(t or "")) for d, t in docs.items()}
    lines = covered(want)
    for r in rows:
        rest = sorted(set(range(r.first, r.last)) - lines[r.doc_id])
        if len(rest) == r.last - r.first:
            words = [w.encode().lower() for w in WORD.findall(docs[r.doc_id][r.first : r.last])]
            assert len(words) >= LEAST and any(b" ".join(words[:LEAST]) in lower[d] for d in docs if d < r.doc_id)


def test_planted_passages_and_clean_documents(spark):
    random.seed(11)

    def prose(n):
        return " ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    passage, near = prose(51), prose(80).split()
    edited = [*near[:40], "changed", *near[41:]]
    rows = [(i, f"{prose(30)} {passage} {prose(40)}\n{prose(20)}") for i in (4, 9, 30)]
    rows += [(i, f"{prose(10)}\n{' '.join(w)}\n{prose(10)}") for i, w in ((5, near), (6, edited), (7, near))]
    rows += [(100 + i, f"{prose(60)}\n{prose(60)}") for i in range(40)] + [(50, "tick tock " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeated_spans(docs).collect()
    assert {(r.doc_id, r.source_id) for r in spans} == {(9, 4), (30, 4), (6, 5), (7, 5)}
    texts = dict(rows)
    for r in spans:
        part = texts[r.doc_id][r.first : r.last]
        assert part in (passage if r.doc_id in (9, 30) else " ".join(near) + " " + " ".join(edited))
        assert len(part.split()) >= (51 - 2 * WINDOW if r.doc_id in (9, 30) else 80)


def test_star_misses_are_found(spark):
    """b resembles a and c, but a and c not each other, whichever of them leads a band."""
    random.seed(5)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    step = [[f"{w}x" if i in changed else w for i, w in enumerate(base)] for changed in ({10, 11}, set(), {90, 91})]
    chain = [(i + 1, " ".join(w)) for i, w in enumerate(step)]
    rows = substrings.repeated_spans(spark.createDataFrame(chain, "doc_id long, text string"), threshold=0.9).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == {(2, 1), (3, 1)}


def test_long_lists_of_edited_copies(spark, monkeypatch):
    """Copies of one paragraph with edits of their own: alike to the original, hardly to each other; in blocks and in pairs."""
    random.seed(12)
    base = [f"w{random.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(f"{w}x" if k == i % 60 else w for k, w in enumerate(base))) for i in range(1, 60)]
    long = WINDOW + substrings.LEAST + 4  # the length from which a passage inside paragraphs is always found
    twins = [(100 + i, " ".join([*base[:long], *[f"t{i // 2}u{k}" for k in range(58 - long)], str(i)])) for i in range(40)]
    docs = spark.createDataFrame([*rows, (60, " ".join(base)), (61, " ".join(base)), *twins], "doc_id long, text string")
    found = []
    for short, block in ((16, 256), (16, 8), (1000, 256)):
        monkeypatch.setattr(substrings, "SHORT", short)
        monkeypatch.setattr(substrings, "BLOCK", block)
        found.append({(r.doc_id, r.first, r.last, r.source_id) for r in substrings.repeated_spans(docs).collect()})
    assert found[0] == found[1] == found[2]
    assert {(d, s) for d, _, _, s in found[0] if d < 100} == {(i, 1) for i in range(2, 62)}
    # Twins share 58 of 59 words with each other, and a passage of the promised length with all others and the originals.
    assert {d for d, _, _, _ in found[0] if d >= 100} == {100 + i for i in range(40)}


def test_edge_rows(spark):
    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, line), (2, line.upper()), (2, line.upper()), (None, line), (3, None), (4, ""), (5, "short line"),
            (6, "é " + line + "\nü " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as starts", "0L as n_chars", "2 as first")
    spans = substrings.repeated_spans(docs)
    assert {(r.doc_id, r.first, r.last, r.source_id) for r in spans.collect() if r.doc_id == 2} == {(2, 0, len(line), 1)}
    out = substrings.cut(docs, spans)
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=str)
    assert out.columns == docs.columns and len(got) == len(rows)
    assert (1, line, 0) in got and got.count((2, "", 0)) == 2 and (3, None, 0) in got and (0, line, 0) in got
    assert next(t for d, t, _ in got if d == 6).endswith("ü ")
    assert substrings.repeated_spans(docs.where("1 = 0")).count() == 0
    assert substrings.cut(docs.where("1 = 0"), spans).count() == 0
