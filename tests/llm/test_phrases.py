import random
import re
from collections import Counter

import pytest

from flowquarry.llm import phrases
from flowquarry.llm.queries import SQL, phrase_collocations
from oracle import differences

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows, least, first=2000):
    """The contract from its words."""
    counts, out = {}, []
    for lang, text in rows:
        count = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = re.findall(r"[^\x20\x09]+", piece)
            count.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    for lang, count in counts.items():
        n = sum(a for g, a in count.items() if len(g) == 1)
        candidates = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        found = []
        for gram, a in candidates.items():
            inside = [b for g, b in candidates.items() if len(g) > len(gram) and any(
                g[i : i + len(gram)] == gram for i in range(len(g)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, _, left, right = min((2000000 * a // (count[gram[:k]] + count[gram[k:]]), k, count[gram[:k]], count[gram[k:]])
                                        for k in range(1, len(gram)))
            found.append((-score, -a, " ".join(gram).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


def corpus(seed, n):
    random.seed(seed)
    vocabulary = ["the", "The", "of", "über", "New", "york", "漢字", "c++", "x" * 300, "\x00", "state-of", "🙂"]
    stock = [" ".join(random.choice(vocabulary) for _ in range(random.randrange(2, 6))) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = [random.choice([*stock, *vocabulary, random.choice(LOWER) * 2]) for _ in range(random.randrange(40))]
        rows.append((random.choice(["en", "de", None, "und", ""]), "".join(p + random.choice([" ", "\t", "  ", ". ", "\n", ",", " \r\n"]) for p in parts)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, word string")


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"BLOCK": 64}), (3, {"HEAVY": 1 << 40}), (4, {"MOST_BITS": 1 << 16}),
                                            (5, {"BLOCK": 500, "HEAVY": 1 << 40, "PARTS": 3})])
def test_against_definition(spark, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(seed, 250) + [("en", None), ("en", ""), (None, None), ("xx", " ."), ("en", "new york " * 700)]
    got = phrases.collocations(table(spark, rows), least=10, first=25).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 10, 25)
    assert len(got) > 60


def test_full_bitmap(spark):
    """A bitmap too small for its keys lets everything through and changes nothing."""
    rows = corpus(6, 250)
    few = phrases.collocations(table(spark, rows), least=10, most_bits=32).collect()
    assert sorted(tuple(r) for r in few) == plain(rows, 10)


def test_slices_join(monkeypatch):
    """Stripes of a text cut anywhere are those of the whole text."""
    monkeypatch.setattr(phrases, "BLOCK", 1 << 20)
    text = corpus(7, 1)[0][1] + "a b c d. e f a b c d e " * 40
    everything = lambda keys: keys == keys

    def entries(block, length):
        monkeypatch.setattr(phrases, "BLOCK", block)
        import pyarrow as pa
        batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
        total = Counter()
        for _, words, tail in phrases._blocks(iter([batch])):
            prefix, nexts, counts = phrases.block_stripes(words, length, everything, tail)
            for *key, count in zip(*prefix, nexts, counts, strict=True):
                total[tuple(int(k) for k in key)] += int(count)
        return total

    for length in (0, 1, 2, 3):
        whole = entries(1 << 20, length)
        assert all(entries(block, length) == whole for block in (1, 2, 3, 7, 50))


def test_counts_beyond_64_bits(spark, tmp_path):
    """Scores and the rule of longer phrases are exact where products pass 64 bits."""
    big = 1 << 61
    schema = "'en' as lang, {} as p1, {} as p2, 0L as p3, -1 as part, cast(null as string) as word, {} as total, 0L as best"

    def stripe(p1, p2, nexts, counts):
        found = spark.range(1).selectExpr(*schema.format(f"{p1}L", f"{p2}L", f"{sum(counts)}L").split(", "))
        return found.selectExpr("*", f"array({','.join(f'{x}L' for x in nexts)}) as nexts", f"array({','.join(f'{x}L' for x in counts)}) as counts")

    words = stripe(0, 0, [5, 6], [big, big + 1])
    pairs = stripe(5, 0, [6], [big - 3])
    row = phrases._ranked(words, pairs, 10, 80).first()
    assert (row.a, row.l, row.r, row.score) == (big - 3, big, big + 1, 2000000 * (big - 3) // (2 * big + 1))


def test_empty(spark):
    found = phrases.collocations(table(spark, []))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == 0
    assert phrases.collocations(table(spark, [("en", "too few words")])).count() == 0


def test_query_against_sql(spark, folder, duck):
    assert differences(phrase_collocations(spark, folder), duck, SQL["op11_phrases"]) == []
