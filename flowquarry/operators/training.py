"""Training jobs: model families, search, progressive training, learning curves, stacking, persistence."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import metrics, neighbors, network, prepare
from flowquarry.runtime import cut_lineage

# Searched settings of the boosted trees.
BOOSTED_GRID = {
    "maxIter": [50, 100, 150], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2], "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "1.0"], "minInfoGain": [0.0, 0.1, 0.2],
}
MLP_HIDDEN = (128, 64)
#: Fits that run at a time.
PARALLEL = 4


def boosted_trees(**settings) -> GBTClassifier:
    return GBTClassifier(seed=42, **{"maxIter": 50, "maxDepth": 5, "stepSize": 0.1, **settings})


def perceptron(inputs: int, hidden: Sequence[int] = MLP_HIDDEN, **settings) -> network.Perceptron:
    """Two classes; sigmoid hidden layers and l-bfgs are what MLlib offers."""
    return network.Perceptron(layers=[inputs, *hidden, 2], seed=42, **{"maxIter": 200, **settings})


def random_forest(**settings) -> RandomForestClassifier:
    return RandomForestClassifier(seed=42, **{"numTrees": 50, **settings})


def assembled(classifier: Estimator, columns: Sequence[str]) -> Pipeline:
    """Columns become a vector only here, at the ML boundary."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), classifier])


def predictions(model: Transformer, df: DataFrame, name: str | None = None) -> DataFrame:
    """Adds ``pred`` and ``p`` (or ``pred_<name>``, ``p_<name>``) and drops MLlib's own columns."""
    end = f"_{name}" if name else ""
    out = model.transform(df)
    out = out.withColumn(f"pred{end}", F.col("prediction").cast("int"))
    out = out.withColumn(f"p{end}", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def side_by_side(spark: SparkSession, work: Sequence[Callable]) -> list:
    """What each call gives; ``PARALLEL`` of them at a time, so that the small jobs of one fit fill the gaps of another."""
    if not work:
        return []
    with ThreadPool(min(PARALLEL, len(work))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(spark)(call) for call in work], chunksize=1)


def fit_base_models(train: DataFrame, columns: Sequence[str], models: dict[str, Estimator]) -> dict[str, PipelineModel]:
    found = side_by_side(train.sparkSession, [lambda m=m: assembled(m, columns).fit(train) for m in models.values()])
    return dict(zip(models, found, strict=True))


def score_with(models: dict[str, Transformer], df: DataFrame) -> DataFrame:
    for name, model in models.items():
        df = predictions(model, df, name)
    return df


def evaluate(model: Transformer, df: DataFrame) -> DataFrame:
    """Binary metrics, log loss and the number of rows in one row."""
    return evaluate_scored(predictions(model, df))


def evaluate_scored(scored: DataFrame) -> DataFrame:
    """The same from rows with ``label, pred, p``."""
    return metrics.evaluation(scored.select("label", "pred", "p"))


def sampled_grid(classifier: Estimator, grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """A random sample of the settings grid."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), values)
    maps = builder.build()
    return random.Random(seed).sample(maps, min(n, len(maps)))


@dataclass
class SearchResult:
    best: dict[str, float]
    scores: list[dict] = field(default_factory=list)
    model: Model | None = None
    refused: str = ""

    def as_table(self, spark) -> DataFrame:
        rows = [(str(s["settings"]), float(s["mean"]), float(s["std"])) for s in self.scores]
        return spark.createDataFrame(rows, "settings string, mean_score double, std_score double")


def random_search(
    train: DataFrame, columns: Sequence[str], classifier: Estimator, grid: dict[str, list], n: int = 15,
    folds: int = 3, fold: str = "fold", parallelism: int = 4, defaults: dict | None = None, rounds: int | None = None,
) -> SearchResult:
    """Cross-validated random search on given folds; falls back to the defaults when settings are refused.

    With ``rounds`` all settings are compared after so many iterations, which is
    far cheaper; the best ones are then fitted on all rows with their own number.
    """
    chosen = sampled_grid(classifier, grid, n)
    tried = chosen if rounds is None else [
        {p: min(rounds, v) if p.name == "maxIter" else v for p, v in settings.items()} for settings in chosen
    ]
    judge = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    cv = CrossValidator(
        estimator=assembled(classifier, columns), estimatorParamMaps=tried, evaluator=judge, numFolds=folds,
        foldCol=fold, parallelism=parallelism, seed=42,
    )
    try:
        fitted = cv.fit(train)
    except IllegalArgumentException as error:  # settings the estimator refuses; anything else is a failure
        if defaults is None:
            raise
        model = assembled(classifier.copy({classifier.getParam(k): v for k, v in defaults.items()}), columns).fit(train)
        return SearchResult(defaults, [], model, str(error))
    scores = [
        {"settings": {p.name: v for p, v in m.items()}, "mean": mean, "std": std}
        for m, mean, std in zip(chosen, fitted.avgMetrics, fitted.stdMetrics, strict=True)
    ]
    top = max(range(len(scores)), key=lambda i: scores[i]["mean"])
    model = fitted.bestModel if rounds is None else assembled(classifier.copy(chosen[top]), columns).fit(train)
    return SearchResult(scores[top]["settings"], scores, model)


@dataclass
class ProgressiveRun:
    """Metrics per round and the model of the round with the best validation accuracy."""

    rounds: list[dict]
    best: PipelineModel
    best_round: int

    def as_table(self, spark) -> DataFrame:
        names = list(self.rounds[0])
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rounds], names)


def train_progressively(
    ranked: DataFrame, val: DataFrame, columns: Sequence[str], classifier: Estimator, rounds: int = 25
) -> ProgressiveRun:
    """Refit on growing nested samples; ``ranked`` carries ``rn`` and ``n_class`` from ``ranked_in_class``."""
    rows = ranked.select(*columns, "label", "rn", "n_class").persist()  # every round reads them several times
    rows.count()  # stored once, before the rounds ask for them together

    def learn(number: int) -> tuple[PipelineModel, dict]:
        share = prepare.round_share(number, rounds)
        part = rows.filter(F.col("rn") <= F.floor(F.col("n_class") * F.lit(share)))
        model = assembled(classifier, columns).fit(part)
        on_train, on_val = evaluate(model, part).first(), evaluate(model, val).first()
        row = {"round": number, "share": share, "train_size": int(on_train["rows"])}
        for name in ("accuracy", "precision", "recall", "f1", "log_loss"):
            row[f"train_{name}"], row[f"val_{name}"] = float(on_train[name]), float(on_val[name])
        return model, row

    learnt = side_by_side(ranked.sparkSession, [lambda n=n: learn(n) for n in range(rounds)])
    rows.unpersist()
    history = [row for _, row in learnt]
    # The first round of strictly highest accuracy.
    best_round = max(range(rounds), key=lambda n: history[n]["val_accuracy"], default=-1)
    best = learnt[best_round][0] if learnt else None
    return ProgressiveRun(history, best, best_round)


def learning_curve(
    df: DataFrame, columns: Sequence[str], classifier: Estimator, order: Sequence[str],
    shares: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, fold: str = "fold",
) -> DataFrame:
    """Mean and deviation of training and validation accuracy per training share."""
    rows = []
    for f in range(folds):
        ranked = prepare.ranked_in_class(df.filter(F.col(fold) != f), order).persist()
        held = df.filter(F.col(fold) == f)
        for share in shares:
            part = ranked.filter(F.col("rn") <= F.floor(F.col("n_class") * F.lit(share)))
            model = assembled(classifier, columns).fit(part)
            scores = [
                predictions(model, d).agg(F.avg((F.col("label") == F.col("pred")).cast("int"))).first()[0]
                for d in (part, held)
            ]
            rows.append((share, f, part.count(), float(scores[0]), float(scores[1])))
        ranked.unpersist()
    table = df.sparkSession.createDataFrame(rows, "share double, fold int, size long, train double, val double")
    return table.groupBy("share").agg(
        F.avg("size").alias("size"), F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("val").alias("val_mean"), F.stddev_pop("val").alias("val_std"),
    ).orderBy("share")


def fit_stacking(
    train: DataFrame, columns: Sequence[str], models: dict[str, Estimator], folds: int = 3, fold: str = "fold"
) -> PipelineModel:
    """Logistic regression over out-of-fold probabilities of the base models."""
    parts = None
    for f in range(folds):
        fitted = fit_base_models(train.filter(F.col(fold) != f), columns, models)
        held = score_with(fitted, train.filter(F.col(fold) == f)).select("label", *[f"p_{n}" for n in models])
        parts = held if parts is None else parts.unionByName(held)
    return assembled(LogisticRegression(), [f"p_{n}" for n in models]).fit(parts)


def stack(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Adds ``pred_stack`` and ``p_stack`` to rows that carry the base probabilities."""
    return predictions(model, scored, "stack")


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def _exists(path: str) -> bool:
    """Whether a folder is there, on whatever file system its path names."""
    spark = SparkSession.getActiveSession()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def load_models(path: str, names: Sequence[str]) -> dict[str, PipelineModel]:
    """Saved models by name; a missing one is left out."""
    found = {}
    for name in names:
        if _exists(f"{path}/{name}/metadata"):
            found[name] = PipelineModel.load(f"{path}/{name}")
    return found


def save_preprocessing(codes: DataFrame, scaler: prepare.Scaler, path: str) -> None:
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    scaler.as_table(codes.sparkSession).write.mode("overwrite").parquet(f"{path}/scaler")


def load_preprocessing(spark, path: str) -> tuple[DataFrame, prepare.Scaler]:
    rows = spark.read.parquet(f"{path}/scaler").collect()
    scaler = prepare.Scaler({r["field"]: r["mean"] for r in rows}, {r["field"]: r["deviation"] for r in rows})
    return spark.read.parquet(f"{path}/codes"), scaler


@dataclass
class Prepared:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    codes: DataFrame
    scaler: prepare.Scaler


def prepare_training(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str], key: Sequence[str], order: Sequence[str],
    fit_on: str = "train",
) -> Prepared:
    """Encode, scale and split. ``fit_on='all'`` fits the scaler before the split, as older models were."""
    split = prepare.split_three(df.na.drop(), order)
    base = split if fit_on == "all" else split.filter(F.col("split") == "train")
    codes = prepare.encoder_fit(base, categories)
    features = [*categories, *numbers]

    def encode(rows: DataFrame) -> DataFrame:
        return prepare.coerce_numbers(prepare.encoder_transform(rows, codes, categories, key), features)

    scaler = prepare.Scaler.fit(encode(base), features)
    ready = scaler.transform(encode(split)).persist()
    parts = {name: ready.filter(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
    return Prepared(parts["train"], parts["val"], parts["test"], codes, scaler)


def progress(
    ranked: DataFrame, val: DataFrame, columns: Sequence[str], key: Sequence[str], fitted: Callable, settings, rounds: int = 25,
) -> tuple[DataFrame, object, int]:
    """Growing nested samples, all rounds in step: metrics per round, the model of the best round, and its number.

    ``ranked`` carries ``rn`` and ``n_class`` from ``ranked_in_class``; ``fitted`` is the ``fit_many`` of a model
    family. The first round of strictly highest validation accuracy is the best one.
    """
    shares = [prepare.round_share(n, rounds) for n in range(rounds)]
    none = F.lit(0).cast("long")
    both = ranked.withColumn("fold", F.lit(0)).unionByName(val.withColumns({"fold": F.lit(-1), "rn": none, "n_class": none}), allowMissingColumns=True)
    models, scores = fitted(both, columns, key, [(settings, None, share) for share in shares], "fold")
    found = {(r["fit"], r["fold"]): r for r in scores.collect()}  # two rows a round
    rows = [(n, share, found[n, 0]["rows"], *_rates(found[n, 0]), *_rates(found[n, -1])) for n, share in enumerate(shares)]
    names = ("accuracy", "precision", "recall", "f1", "log_loss")
    table = ranked.sparkSession.createDataFrame(rows, ["round", "share", "train_size", *[f"{p}_{n}" for p in ("train", "val") for n in names]])
    best = max(range(rounds), key=lambda n: found[n, -1]["right"])
    return table, models[best], best


def _rates(found) -> tuple[float, ...]:
    """Accuracy, precision, recall, F1 and log loss from the measures of a fit."""
    rows, hits = max(found["rows"], 1), found["hits"]
    precision, recall = hits / max(hits + found["alarms"], 1), hits / max(hits + found["misses"], 1)
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return found["right"] / rows, precision, recall, f1, found["loss"] / rows


def share_curve(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str], fitted: Callable, settings,
    shares: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, fold: str = "fold",
) -> DataFrame:
    """Learning curve with all shares and folds in step: sizes, mean and deviation of both accuracies per share.

    A share takes the first rows of each class of each fold, so that the samples are nested.
    """
    both = prepare.ranked_in_class(df.withColumn("_class", F.struct(fold, "label")), order, "_class").drop("_class")
    fits = [(settings, f, share) for share in shares for f in range(folds)]
    _, scores = fitted(both, columns, key, fits, fold)
    marks = F.col("fit").alias("fit"), F.floor(F.col("fit") / folds).cast("int").alias("at"), (F.col("fit") % folds == F.col("fold")).alias("held")
    sums = scores.select(*marks, "rows", "right").groupBy("at", "fit").agg(
        F.sum(F.when(~F.col("held"), F.col("rows"))).alias("size"),
        *[(F.sum(F.when(F.col("held") == h, F.col("right"))) / F.sum(F.when(F.col("held") == h, F.col("rows")))).alias(n)
          for n, h in (("train", False), ("val", True))])
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("at") + 1).alias("share")
    return sums.select(share, "size", "train", "val").groupBy("share").agg(
        F.avg("size").alias("size"), F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("val").alias("val_mean"), F.stddev_pop("val").alias("val_std"),
    ).orderBy("share")


def neighbour_probability(
    train: DataFrame, queries: DataFrame, columns: Sequence[str], key: Sequence[str], fold: str = "fold", k: int = 7, metric: str = "manhattan",
) -> DataFrame:
    """``queries`` with ``p_knn`` and ``pred_knn``, voted by the nearest ``train`` rows of other folds, in one search."""
    marked = [F.xxhash64(*key).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"), F.col(fold).alias("fold")]
    near = neighbors.nearest(train.select(*marked, "label"), queries.select(*marked), k, metric, by_fold=True)
    found = neighbors.votes(near).select(F.col("id").alias("_id"), F.col("p").alias("p_knn"), F.col("pred").alias("pred_knn"))
    return queries.join(found, F.xxhash64(*key) == F.col("_id"), "left").drop("_id")


@dataclass
class Stacked:
    """A meta-model over out-of-fold probabilities, and the rows it was asked for."""

    meta: PipelineModel
    scored: DataFrame
    learnt: DataFrame


def stack_out_of_fold(
    train: DataFrame, asked: DataFrame, columns: Sequence[str], key: Sequence[str], families: dict[str, tuple[Callable, object]],
    folds: int = 3, fold: str = "fold",
) -> Stacked:
    """Neighbours and the ``families`` (name to ``fit_many`` and settings) stacked by a logistic regression.

    Every family fits its folds and the whole in step, the neighbours of all folds are found
    in one search. ``scored`` are the rows of ``asked`` with ``pred_*`` and ``p_*`` of every base
    model and of the stack; ``learnt`` the training rows with out-of-fold probabilities.
    """
    both = train.unionByName(asked.withColumn(fold, F.lit(-1)))
    scored = neighbour_probability(train, both, columns, key, fold)
    for name, (fitted, settings) in families.items():
        models, _ = fitted(train, columns, key, [(settings, f) for f in (*range(folds), None)], fold)
        parts = [m.transform(scored.where(F.col(fold) == (f if f < folds else -1)), name) for f, m in enumerate(models)]
        scored = reduce(DataFrame.unionByName, parts)
    scored = cut_lineage(scored)
    inputs = ["p_knn", *[f"p_{n}" for n in families]]
    learnt, rows = scored.where(F.col(fold) >= 0), scored.where(F.col(fold) < 0)
    meta = assembled(LogisticRegression(), inputs).fit(learnt)
    return Stacked(meta, stack(meta, rows), learnt)
