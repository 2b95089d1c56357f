"""Queries of model training and neighbour search; they run on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import boosting as B
from flowquarry.operators import ensemble as H
from flowquarry.operators import neighbors as K
from flowquarry.operators import perceptron as P
from flowquarry.operators import prepare as E
from flowquarry.operators import training as M
from flowquarry.operators.isolation import IsolationForest
from flowquarry.plans.registry import query
from flowquarry.plans.views import TRAIN_KEY, TRAIN_NUMERIC, VECTORS_SQL, training, vectors
from flowquarry.runtime import staging_path

_ORDER = ["mix", *TRAIN_KEY]
_CATEGORIES = ["status", "service"]
_FEATURES = [*_CATEGORIES, *TRAIN_NUMERIC]

_L1 = "list_sum(list_transform(list_zip(a.features, b.features), lambda z: abs(z[1] - z[2])))"
_L2 = "sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _neighbors_sql(distance: str, k: int) -> str:
    return f"""{VECTORS_SQL},
ds AS (SELECT a.id, b.id AS neighbor, b.label, {distance} AS d FROM ve a JOIN ve b ON a.id <> b.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rn FROM ds) WHERE rn <= {k})"""


@query("knn_classifier", "F01", f"""WITH {_neighbors_sql(_L1, 7)}, vo AS (SELECT id,
    CASE WHEN count(*) FILTER (d = 0) > 0 THEN avg(label) FILTER (d = 0)
      ELSE sum(label / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0) END AS p FROM nn GROUP BY id)
SELECT id, round(p, 6) AS p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM vo""")
def _(spark, folder):
    rows = vectors(spark, folder)
    return K.classify(rows, rows, exclude_self=True).withColumn("p", F.round("p", 6))


@query("knn_baseline", "F06", f"""WITH {_neighbors_sql(_L2, 5)}
SELECT id, round(avg(label), 6) AS p, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS pred FROM nn GROUP BY id""")
def _(spark, folder):
    rows = vectors(spark, folder)
    found = K.classify(rows, rows, 5, "euclidean", "uniform", exclude_self=True)
    return found.withColumn("p", F.round("p", 6))


@query("knn_search", "F02 F10")
def _(spark, folder):
    rows = vectors(spark, folder).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int"))
    return K.top_settings(K.search(rows))


def _prepared(spark, folder):
    # Status and service are known for every row; the label comes from the return flag.
    ready = M.prepare_training(training(spark, folder), _CATEGORIES, TRAIN_NUMERIC, TRAIN_KEY, _ORDER)
    fold = F.col("mix") % 5
    return M.Prepared(
        *[d.withColumn("fold", fold.cast("int")) for d in (ready.train, ready.val, ready.test)], ready.codes, ready.scaler
    )


def _base_models():
    return {"forest": M.random_forest(), "mlp": M.perceptron(len(_FEATURES)), "xgb": M.boosted_trees()}


def _test_scores(spark, folder, classifier):
    ready = _prepared(spark, folder)
    return M.evaluate(M.assembled(classifier, _FEATURES).fit(ready.train), ready.test)


def _family_scores(spark, folder, fitted, settings):
    ready = _prepared(spark, folder)
    train = ready.train.withColumn("fold", F.lit(0))
    return M.evaluate_scored(fitted(train, _FEATURES, TRAIN_KEY, [(settings, None)])[0][0].transform(ready.test))


@query("boosted_trees", "F03")
def _(spark, folder):
    return _family_scores(spark, folder, B.fit_many, B.Settings())


@query("perceptron", "F04")
def _(spark, folder):
    return _family_scores(spark, folder, P.fit_many, P.Settings())


@query("random_forest_baseline", "F05")
def _(spark, folder):
    return _test_scores(spark, folder, M.random_forest())


@query("isolation_forest", "F07 H08")
def _(spark, folder):
    rows = training(spark, folder)
    forest = IsolationForest.fit(rows, TRAIN_NUMERIC, TRAIN_KEY)
    return forest.transform(rows).select(*TRAIN_KEY, "anomaly_score", "is_anomaly")


def _in_folds(spark, folder):
    """Training rows on three folds, validation rows on fold -1, and all parts."""
    ready = _prepared(spark, folder)
    train = ready.train.withColumn("fold", (F.col("mix") % 3).cast("int"))
    return train.unionByName(ready.val.withColumn("fold", F.lit(-1))), train, ready


@query("stacked_vote", "F08 H06")
def _(spark, folder):
    """Neighbours, perceptron and boosted trees, stacked on out-of-fold probabilities."""
    _, train, ready = _in_folds(spark, folder)
    families = {"mlp": (P.fit_many, P.Settings()), "xgb": (B.fit_many, B.Settings())}
    stacked = M.stack_out_of_fold(train, ready.test.drop("fold"), _FEATURES, TRAIN_KEY, families)
    weights = dict.fromkeys(("knn", *families), 1.0)
    return stacked.scored.select(*TRAIN_KEY, "label", H.vote("stacking", weights).alias("prediction"), "p_stack")


def _searched(found):
    """The three best draws with the validation accuracy of the best."""
    return K.top_settings(found.table).withColumn("best_val_accuracy", F.lit(float(found.validation)))


@query("random_search", "F09 F10 F03")
def _(spark, folder):
    """15 draws of the whole grid on three folds, each with all of its own rounds."""
    rows, _, _ = _in_folds(spark, folder)
    return _searched(B.search(rows, _FEATURES, TRAIN_KEY, B.draws()))


@query("perceptron_search", "F09 F10 F04")
def _(spark, folder):
    """15 draws of sizes, activation, solver, L2 and schedule on three folds."""
    rows, _, _ = _in_folds(spark, folder)
    found = B.search(rows, _FEATURES, TRAIN_KEY, B.draws(P.GRID, kind=P.Settings), fitted=P.fit_many, grid=P.GRID)
    return _searched(found)


def _progress(spark, folder, fitted, settings):
    ready = _prepared(spark, folder)
    ranked = E.ranked_in_class(ready.train, _ORDER)
    return M.progress(ranked, ready.val, _FEATURES, TRAIN_KEY, fitted, settings)[0]


@query("progressive_boosting", "F11 F13")
def _(spark, folder):
    return _progress(spark, folder, B.fit_many, B.Settings())


@query("progressive_perceptron", "F11 F13")
def _(spark, folder):
    return _progress(spark, folder, P.fit_many, P.Settings())


@query("progressive_training", "F11 F13")
def _(spark, folder):
    ready = _prepared(spark, folder)
    ranked = E.ranked_in_class(ready.train, _ORDER)
    return M.train_progressively(ranked, ready.val, _FEATURES, M.random_forest()).as_table(spark)


@query("learning_curve", "F14")
def _(spark, folder):
    """Ten shares by five folds, all in step; every fold is held out once."""
    ready = _prepared(spark, folder)
    return M.share_curve(ready.train, _FEATURES, TRAIN_KEY, _ORDER, B.fit_many, B.Settings())


@query("saved_models", "F15 F16 L3")
def _(spark, folder):
    ready = _prepared(spark, folder)
    path = staging_path(spark, "models")
    M.save_models(M.fit_base_models(ready.train, _FEATURES, _base_models()), path)
    M.save_preprocessing(ready.codes, ready.scaler, path)
    models = M.load_models(path, [*_base_models(), "never_saved"])
    codes, scaler = M.load_preprocessing(spark, path)
    rows = E.encoder_transform(training(spark, folder), codes, _CATEGORIES, TRAIN_KEY)
    scored = M.score_with(models, scaler.transform(E.coerce_numbers(rows, _FEATURES)))
    decided = H.score(scored, weights=dict.fromkeys(models, 1.0))
    return decided.select(*TRAIN_KEY, "is_attack", "confidence", "attack_probability")
