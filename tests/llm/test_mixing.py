import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowquarry.llm import mixing
from flowquarry.llm.queries import mixed_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, total, most):
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in free)
        rest = total - sum(fixed.values())
        share = {i: rest * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_query_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    by = defaultdict(int)
    for d in docs:
        by[d.source] += size[d.doc_id]
    names = sorted(by)
    want = dict(zip(names, plain_targets([by[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))],
                                         1.5 * sum(size.values()), 2), strict=True))
    rows = {r.doc_id: r for r in mixed_sources(spark, folder).collect()}
    assert len(rows) == len(docs) and sum(want.values()) == pytest.approx(1.5 * sum(size.values()))
    taken = defaultdict(int)
    for d in docs:
        r = rows[d.doc_id]
        assert (r["size"], r.source_size) == (size[d.doc_id], by[d.source])
        assert r.target == pytest.approx(want[d.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[d.source] += r.taken
    longest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= longest / 2 + 1 for s in names)
    again = {r.doc_id: r for r in mixed_sources(spark, folder).repartition(5).collect()}
    assert again == rows


def test_flow_is_cheapest():
    words = {("a",): 100, ("b",): 10, ("a", "b"): 50}
    given = mixing.flow(words, {"a": 60, "b": 90}, 2)
    got = {s: sum(n for (p, q), n in given.items() if q == s) for s in "ab"}
    assert got == {"a": 60, "b": 90}
    # b has 60 words of its own in one copy: 30 more need second copies; a needs none, as ("a",) alone covers it.
    assert given[("a",), "a"] == 60 and given[("b",), "b"] + given[("a", "b"), "b"] == 90


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 7), ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else ["b", None]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>").selectExpr("*", "1 as size", "2 as mixed")
    got = mixing.mix(docs, F.col("of"), weights=(1, 2, 1), total=1.2)
    assert got.columns == [*docs.columns, "mixed_"]
    taken, target = defaultdict(int), {}
    for r in got.collect():
        assert len(r.mixed_.homes) <= 2 and set(r.mixed_.homes) <= set(r.of)
        target |= {t.source: t.target for t in r.mixed_.targets}
        for home in r.mixed_.homes:
            taken[home] += r.mixed_["size"]
    assert set(target) == {"a", "b", None}
    assert all(abs(taken[s] - target[s]) <= 15 for s in target)
    assert mixing.take(docs, F.col("of"), total=1.2).columns == docs.columns


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "z " * 50000, "b"), (5, "q", "a"), (5, "q", "a"),
            (None, "n n", "b"), (None, "m", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, F.array("source")).collect()
    assert len(got) == 8 and {r.doc_id: r.mixed["size"] for r in got if r.doc_id}[4] == 50000
    assert len({tuple(r.mixed.homes) for r in got if r.doc_id == 5}) == 1
    assert mixing.mix(docs.where("1 = 0"), F.array("source")).count() == 0
    assert mixing.mix(docs.where("text = ''"), F.array("source")).first().mixed["size"] == 0


def test_targets_stop_at_twice_the_size():
    assert mixing.shared_targets([10, 100, 100], [3, 1, 2], 315, 2) == [20, pytest.approx(295 / 3), pytest.approx(590 / 3)]
    assert mixing.shared_targets([], [], 0, 2) == [] and mixing.shared_targets([0, 0], [1, 1], 0, 2) == [0, 0]


def test_targets_of_a_table(spark):
    rows = [(i, (i * 7919) % 1000 + (5000 if i % 11 == 0 else 0), float((3, 1, 2)[i % 3])) for i in range(200)]
    table = spark.createDataFrame(rows, "n long, size long, weight double")
    total = 1.5 * sum(r[1] for r in rows)
    got = {r.n: r.target for r in mixing.with_targets(table, total, 2).collect()}
    want = mixing.shared_targets([r[1] for r in rows], [r[2] for r in rows], total, 2)
    assert [got[r[0]] for r in rows] == pytest.approx(want) and len({t == 2 * r[1] for t, r in zip(want, rows, strict=True)}) == 2
    assert mixing.with_targets(table.where("1 = 0"), 0, 2).count() == 0
    assert {r.target for r in mixing.with_targets(table.withColumn("size", F.lit(0)), 0, 2).collect()} == {0}


def test_fifty_thousand_sources(spark):
    """More sources than any driver list should hold; a third of the words in one of them, some overlapping in pairs."""
    n = 50_000
    docs = spark.range(2 * n + n // 50).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("hot")))
        .when(F.col("id") < 2 * n, F.array(F.format_string("site%06d", F.col("id") % n)))
        .otherwise(F.array(F.format_string("site%06d", F.col("id") % n), F.format_string("site%06d", F.col("id") % n + 1))).alias("of"),
    )
    rows = mixing.mix(docs, F.col("of")).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert set(r.mixed.homes) <= set(r.of) and len(r.mixed.homes) <= 2
        for t in r.mixed.targets:
            target[t.source] = t.target
            size[t.source] += r.mixed["size"]
        for home in r.mixed.homes:
            taken[home] += r.mixed["size"]
    names = sorted(size)
    weights = [(3, 1, 2)[i % 3] for i in range(len(names))]
    want = plain_targets_sorted([size[s] for s in names], weights, 1.5 * sum(r.mixed["size"] for r in rows), 2)
    assert len(names) > 40_000 and [target[s] for s in names] == pytest.approx(want)
    shared = {s for r in rows if len(r.of) > 1 for s in r.of}
    assert len(shared) > 900 and all(abs(taken[s] - target[s]) <= 5 / 2 + 1 for s in names if s not in shared)
    # Every source of a group is stopped here: the largest flow takes all documents of the groups as often as allowed.
    assert all(target[s] == 2 * size[s] for s in shared)
    assert all(len(r.mixed.homes) == 2 for r in rows if shared & set(r.of))


def plain_targets_sorted(sizes, weights, total, most):
    """Stopped sources are those of least size per weight: found one by one, in that order."""
    left, rest, out = sum(weights), total, [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i]):
        out[i] = min(most * sizes[i], rest * weights[i] / left)
        rest, left = rest - out[i], left - weights[i]
    return out
