import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import forest
from flowquarry.llm.queries import nearest_vectors


def plain(rows, k=20):
    """{query: [(id, score)]} from every pair."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_and_exact_scores(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = plain(rows)
    got = nearest_vectors(spark, folder).collect()
    by = {q: sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"]) for q in want}
    vectors = {i: np.array(x, float) for i, x in rows}
    hits = 0
    for q, own in by.items():
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        keys = [(-r.score, r.vec_id) for r in own]
        assert keys == sorted(keys)
        assert all(r.score == pytest.approx(float(vectors[q] @ vectors[r.vec_id]), abs=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in want[q]})
    assert len(got) == 20 * len(want) and hits / (20 * len(want)) > 0.9


def test_candidates_share_the_longest_prefixes():
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 8))
    made = forest.Forest(x, float(np.linalg.norm(x, axis=1).max()), trees=5)
    q = random.normal(size=(30, 8))
    strings = made._strings(np.column_stack((q, np.zeros(30))))
    own = np.empty_like(made.sorted)
    np.put_along_axis(own, made.order, made.sorted, axis=1)
    for i, at in enumerate(made.candidates(q, 40)):
        depth = np.array([[forest.BITS - int(a ^ b).bit_length() for a in row] for row, b in zip(own, strings[:, i], strict=True)]).max(axis=0)
        least = depth[at].min()
        assert len(at) >= 40 and set(np.flatnonzero(depth > least)) <= set(at.tolist())
    assert all(len(at) == 400 for at in made.candidates(q, 9999))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (40, None), (60, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as score", "3 as block")
    asks = F.col("vec_id") % 20 == 0
    got = [tuple(r) for r in forest.nearest(table, asks).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    assert forest.nearest(table.where("1 = 0"), asks).count() == 0
    assert forest.nearest(table.where("vec_id = 3"), asks).count() == 0
    copies = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(200)], "vec_id long, embedding array<double>")
    top = forest.nearest(copies, asks, k=3).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in top] == [0, 1, 2]


def test_lengths_matter(spark):
    random = np.random.default_rng(9)
    x = random.normal(size=(3000, 6)) * random.lognormal(size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = plain(rows)
    got = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    hits = sum((r.vec_id in {i for i, _ in want[r.query_id]}) for r in got)
    assert hits / (20 * len(want)) > 0.9
