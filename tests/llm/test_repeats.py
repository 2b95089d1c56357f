import hashlib
import random

import pytest

from flowquarry.llm import repeats
from flowquarry.llm.queries import SQL, documents_without_repeats
from oracle import differences


def plain_repeats(contexts, least):
    """Strings that occur twice with differing neighbours on both sides, and where."""
    places = {}
    for i, text in enumerate(contexts):
        for j in range(len(text)):
            for end in range(j + least, len(text) + 1):
                places.setdefault(text[j:end], []).append((i, j))
    out = set()
    for string, at in places.items():

        def differ(step, string=string, at=at):
            seen = [contexts[i][k : k + 1] or n if k >= 0 else n for n, (i, j) in enumerate(at) for k in [j + step]]
            return len(set(seen)) > 1

        if len(at) > 1 and differ(-1) and differ(len(string)):
            out.add((len(string), tuple(sorted(at))))
    return out


def plain_cut(rows, least):
    """Every row with what is left of its text, from the definition."""
    count = {}
    texts = [(text or "").encode() for _, text in rows]
    for data in texts:
        for i in range(len(data) - least + 1):
            count[data[i : i + least]] = count.get(data[i : i + least], 0) + 1
    out = []
    for (doc, _), data in zip(rows, texts, strict=True):
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            if count[data[i : i + least]] > 1:
                gone[i : i + least] = b"\x01" * least
        spans = [(i, next((j for j in range(i, len(data)) if not gone[j]), len(data)) - i)
                 for i in range(len(data)) if gone[i] and (not i or not gone[i - 1])]
        out.append((doc, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def cut(spark, rows, least):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, begin int, _id string")
    found = repeats.without_repeats(docs.repartition(3), least=least).collect()
    assert all(r.begin == 5 and r["_id"] == "x" for r in found)
    return sorted(((r.doc_id, r.repeats.n_bytes, [tuple(s) for s in r.repeats.spans], bytes(r.repeats.kept)) for r in found), key=repr)


def corpus(seed):
    random.seed(seed)
    letters = "abcdefghijklmnop é漢\n"

    def text(n, k=len(letters)):
        return "".join(random.choice(letters[:k]) for _ in range(n))

    shared = [text(n) for n in (19, 20, 21, 45, 90, 300)]
    rows = []
    for i in range(60):
        parts = [random.choice([text(random.randrange(60)), random.choice(shared), random.choice(shared)[3:-2]]) for _ in range(random.randrange(9))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 200), (101, "a" * 70), (102, "a" * 20), (103, "a" * 19), (104, text(150, 2)), (105, rows[4][1]), (4, rows[4][1])]
    rows += [(None, rows[7][1]), (None, rows[7][1]), (None, None), (106, ""), (None, "short"), (107, text(3000) + rows[9][1] + text(2000, 3))]
    edited = list(rows[9][1] + shared[5])
    edited[len(edited) // 2] = "!"
    return [*rows, (108, "".join(edited)), (109, "".join(edited[7:]))]


def test_maximal_repeats():
    random.seed(1)
    for _ in range(300):
        contexts = [bytes(random.choice(b"ab" if random.random() < 0.9 else b"abc") for _ in range(random.randrange(25)))
                    for _ in range(random.randrange(1, 5))]
        least = random.choice([1, 2, 3, 5])
        found = repeats.maximal_repeats(contexts, least)
        assert {(n, tuple(sorted(zip(c.tolist(), p.tolist(), strict=True)))) for n, c, p in found} == plain_repeats(contexts, least)


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"BLOCK": 64, "SEARCH": 100}), (3, {"CROWD": 1}), (4, {"CROWD": 2, "BLOCK": 100}),
                                            (5, {"MOST_BITS": 1 << 10, "HELD": 500})])
def test_against_definition(spark, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(repeats, name, value)
    rows = corpus(seed)
    assert cut(spark, rows, 20) == plain_cut(rows, 20)


def test_groups_name_all_occurrences(spark):
    rows = [r for r in corpus(6) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r: t.encode() for r, t in rows if t}
    strings, covered = {}, {r: bytearray(len(t)) for r, t in texts.items()}
    for row in repeats.repeat_groups(docs, least=20).collect():
        data = texts[row.doc_id][row.begin : row.begin + row.length]
        assert len(data) >= 20 and hashlib.blake2b(data, digest_size=16).digest() == bytes(row.group)
        strings.setdefault(data, set()).add((row.doc_id, row.begin))
        covered[row.doc_id][row.begin : row.begin + row.length] = b"\x01" * row.length
    # Each group has occurrences in two places or in a row that comes twice, and together they cover all that repeats.
    for doc, _, spans, _ in plain_cut(rows, 20):
        if doc in covered:
            assert sum(covered[doc]) == sum(n for _, n in spans)
    assert sum(len(v) > 2 for v in strings.values()) > 20


def test_empty(spark):
    assert cut(spark, [], 20) == []
    assert cut(spark, [(1, None), (2, "x" * 10)], 20) == [(1, 0, [], b""), (2, 10, [], b"x" * 10)]


def test_query_against_sql(spark, folder, duck):
    assert differences(documents_without_repeats(spark, folder), duck, SQL["op12_repeats"]) == []
