"""Order-dependent, keyed and model operators against plain Python, on skewed input."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowquarry.operators import boosting, neighbors, ordered, perceptron, prepare, sessions, skew, training
from flowquarry.operators.isolation import IsolationForest
from flowquarry.plans import CATALOGUE


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows, NULL is a key of its own, values repeat."""
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}", rng.randint(0, 20)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, key string, v long").repartition(6).cache()


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_row_numbers(skewed):
    got = ordered.row_numbers(ordered.arrange(skewed, "key", "v", "id"), ["key"], "rn", "n")
    w = Window.partitionBy("key")
    want = skewed.withColumn("rn", F.row_number().over(w.orderBy("v", "id")).cast("long")).withColumn("n", F.count("*").over(w))
    assert same(got.select("id", "rn", "n"), want.select("id", "rn", "n"))


def test_global_row_numbers(skewed):
    got = ordered.row_numbers(ordered.arrange(skewed, "v", "id"))
    want = skewed.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")).cast("long"))
    assert same(got.select("id", "rn"), want.select("id", "rn"))


def test_previous_across_slices(skewed):
    got = ordered.previous(ordered.arrange(skewed, "key", "v", "id"), ["key"], {"before": "id"})
    want = skewed.withColumn("before", F.lag("id").over(Window.partitionBy("key").orderBy("v", "id")))
    assert same(got.select("id", "before"), want.select("id", "before"))


def test_running_total(skewed):
    got = ordered.running_total(ordered.arrange(skewed, "v", "id"), F.col("v"), "upto")
    w = Window.orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert same(got.select("id", "upto"), skewed.withColumn("upto", F.sum("v").over(w)).select("id", "upto"))


def test_top_n_per_group(skewed):
    got = ordered.top_n_per_group(skewed, ["key"], [F.desc("v"), F.col("id")], 7, F.col("id"), salts=4)
    w = Window.partitionBy("key").orderBy(F.desc("v"), "id")
    want = skewed.withColumn("rn", F.row_number().over(w)).filter("rn <= 7")
    assert same(got.select("id", "rn"), want.select("id", "rn"))


def test_exact_quantiles(skewed):
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    values = np.array([r["v"] for r in skewed.collect()], dtype=float)
    ids = np.array([r["id"] for r in skewed.collect()], dtype=float)
    found = {r["field"]: r[1:] for r in ordered.exact_quantiles(skewed, ["v", "id"], shares).collect()}
    assert np.allclose(found["v"], np.quantile(values, shares)) and np.allclose(found["id"], np.quantile(ids, shares))


def test_salted_lookup(skewed, spark):
    names = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, code int")
    got = skew.salted_lookup(skewed, names, ["key"], ["id"], "left")
    assert same(got.select("id", "code"), skewed.join(names, "key", "left").select("id", "code"))


def greedy(times, span):
    heads, last = set(), None
    for t, i in sorted(times):
        if last is None or t - last > span:
            heads.add(i)
            last = t
    return heads


@pytest.mark.parametrize("span", [0, 1, 7, 40, 10_000])
def test_chain_heads(spark, span):
    rng = random.Random(span)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), float(rng.randint(0, 300))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, t double")
    got = {r["id"] for r in sessions.chain_heads(df, ["key"], "t", "id", span).filter("head").collect()}
    want = set()
    for key in ("hot", "a", "b", None):
        want |= greedy([(t, i) for i, k, t in rows if k == key], span)
    assert got == want


def test_split_is_exact_and_reproducible(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 < 3).cast("int").alias("label"), ((F.col("id") * 7919) % 1009).alias("mix"))
    split = prepare.split_three(df.repartition(9), ["mix", "id"])
    counts = {(r["split"], r["label"]): r["n"] for r in split.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert counts == {("test", 0): 140, ("val", 0): 105, ("train", 0): 455, ("test", 1): 60, ("val", 1): 45, ("train", 1): 195}
    assert same(split, prepare.split_three(df.coalesce(1), ["mix", "id"]))


def test_unknown_category_becomes_first_class(spark):
    codes = prepare.encoder_fit(spark.createDataFrame([("udp",), ("tcp",), ("icmp",)], "proto string"), ["proto"])
    rows = spark.createDataFrame([(1, "udp"), (2, "sctp"), (3, None)], "id int, proto string")
    out = {r["id"]: r["proto"] for r in prepare.encoder_transform(rows, codes, ["proto"], ["id"]).collect()}
    assert out == {1: 2, 2: 0, 3: 0}


def test_constant_column_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = sorted(tuple(r) for r in prepare.Scaler.fit(df, ["a", "b"]).transform(df).collect())
    assert rows == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("metric", ["manhattan", "euclidean"])
@pytest.mark.parametrize("chunk", [16, 4096])
def test_nearest_neighbours_with_a_hot_point(spark, metric, chunk):
    """A third of the reference rows are copies of one point; results equal brute force."""
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, size=(150, 3)).astype(float)
    points[::3] = [1.0, 2.0, 3.0]
    asked = np.vstack([rng.uniform(0, 6, size=(30, 3)), [[1.0, 2.0, 3.0]]])
    train = spark.createDataFrame([(i, p.tolist(), i % 2) for i, p in enumerate(points)], "id long, features array<double>, label int")
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "id long, features array<double>")
    got = {}
    for r in neighbors.nearest(train, queries, 7, metric, chunk=chunk).collect():
        got.setdefault(r["id"], []).append((r["rank"], round(r["distance"], 9), r["neighbor"]))
    for i, q in enumerate(asked):
        diff = points - q
        d = np.abs(diff).sum(axis=1) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=1))
        order = np.lexsort((np.arange(len(d)), d))[:7]
        assert sorted(got[i]) == [(n + 1, round(d[j], 9), j) for n, j in enumerate(order)]


def test_exact_match_takes_all_weight(spark):
    near = spark.createDataFrame([(1, 0.0, 1), (1, 0.1, 0), (1, 0.1, 0), (2, 1.0, 1), (2, 4.0, 0)],
                                 "id int, distance double, neighbor_label int")
    out = {r["id"]: (round(r["p"], 6), r["pred"]) for r in neighbors.votes(near).collect()}
    assert out == {1: (1.0, 1), 2: (0.8, 1)}


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, size=(300, 2)))] + [(300, 25.0, -25.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = IsolationForest.fit(df, ["a", "b"], ["id"], trees=30, sample=64)
    scored = forest.transform(df)
    assert scored.orderBy(F.desc("anomaly_score")).first()["id"] == 300
    assert 25 <= scored.filter("is_anomaly").count() <= 31
    again = IsolationForest.fit(df.repartition(7), ["a", "b"], ["id"], trees=30, sample=64)
    assert again.trees == forest.trees


@pytest.mark.parametrize("name, family, grid", [("random_search", boosting, boosting.GRID), ("perceptron_search", perceptron, perceptron.GRID)])
def test_search_compares_whole_draws_on_all_folds(spark, folder, monkeypatch, name, family, grid):
    class Seen(Exception):
        pass

    def fit(df, columns, key, fits, fold):
        raise Seen(fits, df.groupBy(fold).count().count())

    monkeypatch.setattr(boosting.search, "__defaults__", tuple(fit if x is boosting.fit_many else x for x in boosting.search.__defaults__))
    monkeypatch.setattr(perceptron, "fit_many", fit)
    with pytest.raises(Seen) as seen:
        CATALOGUE[name].build(spark, folder)
    drawn = boosting.draws(grid, 15, kind=family.Settings)
    assert len(set(drawn)) == 15
    assert seen.value.args == ([(s, f) for s in drawn for f in (0, 1, 2, None)], 4)


def test_mllib_search_compares_draws_with_all_their_rounds(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(self, train):
        raise Seen([m[p] for m in self.getEstimatorParamMaps() for p in m if p.name == "maxIter"])

    monkeypatch.setattr(training.CrossValidator, "fit", fit)
    with pytest.raises(Seen) as seen:
        training.random_search(spark.range(1), ["id"], training.boosted_trees(), training.BOOSTED_GRID, folds=5)
    drawn = training.sampled_grid(training.boosted_trees(), training.BOOSTED_GRID, 15)
    assert seen.value.args[0] == [m[p] for m in drawn for p in m if p.name == "maxIter"]


def test_neighbours_of_other_folds(spark):
    """One search for all folds equals a search per fold."""
    rng = np.random.default_rng(6)
    points = rng.integers(0, 5, size=(200, 2)).astype(float)
    rows = [(i, p.tolist(), i % 2, (i // 7) % 4 - 1) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, fold int")
    train = df.where("fold >= 0")
    got = {}
    for r in neighbors.nearest(train, df, 5, by_fold=True, chunk=30).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["distance"], r["neighbor"]))
    for fold in (-1, 0, 1, 2):
        near = neighbors.nearest(train.where(F.col("fold") != fold), df.where(F.col("fold") == fold), 5)
        want = {}
        for r in near.collect():
            want.setdefault(r["id"], []).append((r["rank"], r["distance"], r["neighbor"]))
        assert all(sorted(got[i]) == sorted(want[i]) for i in want) and len(want) == df.where(F.col("fold") == fold).count()


def test_progress_curve_and_stack(spark):
    """Nested shares, the first best round, and a stack that beats the majority."""
    rng = np.random.default_rng(7)
    x = rng.random((600, 2))
    rows = [(i, float(a), float(b), int((a > 0.5) != (b > 0.5)), i % 5, i) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int, fold int, mix long").cache()
    settings = boosting.Settings(rounds=6, depth=3, rate=0.3)
    train, val = df.where("fold < 4"), df.where("fold = 4")
    ranked = prepare.ranked_in_class(train, ["mix"])
    table, model, best = training.progress(ranked.drop("fold"), val.drop("fold"), ["a", "b"], ["id"], boosting.fit_many, settings, rounds=4)
    found = {r["round"]: r for r in table.collect()}
    sizes = {r["round"]: r["train_size"] for r in prepare.round_sizes(train, 4).groupBy("round").agg(F.sum("size").alias("train_size")).collect()}
    assert {n: r["train_size"] for n, r in found.items()} == sizes
    assert best == min(found, key=lambda n: (-found[n]["val_accuracy"], n)) and found[best]["val_accuracy"] > 0.85
    judged = training.evaluate_scored(model.transform(val)).first()
    for name in ("accuracy", "precision", "recall", "f1", "log_loss"):
        assert abs(judged[name] - found[best][f"val_{name}"]) < 1e-9, name
    curve = training.share_curve(df, ["a", "b"], ["id"], ["mix"], boosting.fit_many, settings, shares=(0.25, 0.5, 1.0)).collect()
    assert [r["share"] for r in curve] == [0.25, 0.5, 1.0] and curve[2]["size"] == 480 and curve[2]["val_mean"] > 0.85
    assert curve[0]["size"] < 0.26 * 480 and curve[0]["train_std"] >= 0
    folded = train.withColumn("fold", (F.col("fold") % 3).cast("int"))
    families = {"mlp": (perceptron.fit_many, perceptron.Settings(hidden=(8,), epochs=8, rate=0.02)), "xgb": (boosting.fit_many, settings)}
    stacked = training.stack_out_of_fold(folded, val.drop("fold"), ["a", "b"], ["id"], families)
    scored = stacked.scored.select("id", "label", "pred_stack", "p_knn", "p_mlp", "p_xgb").collect()
    assert len(scored) == val.count() and stacked.learnt.where("p_knn IS NULL").count() == 0
    assert sum(r["label"] == r["pred_stack"] for r in scored) / len(scored) > 0.85
