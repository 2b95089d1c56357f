import numpy as np
import pytest

from flowquarry.llm import quality
from flowquarry.llm.queries import document_quality


def plain_score(forest, row):
    margin = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (1 if row[feature[node]] <= threshold[node] else 2)
        margin += value[node - len(feature)]
    return 1 / (1 + np.exp(-margin))


def test_trees_learn_and_flat_arrays_equal_a_plain_walk():
    random = np.random.default_rng(4)
    rows = random.normal(size=(3000, len(quality.FEATURES)))
    labels = ((rows[:, 3] > 0.3) ^ (rows[:, 7] > 0)).astype(float)
    forest = quality.grow(rows[:2000], labels[:2000], trees=30)
    scores = forest.score(rows[2000:])
    assert ((scores > 0.5) == labels[2000:]).mean() > 0.95
    assert scores[:50] == pytest.approx([plain_score(forest, r) for r in rows[2000:2050]])


def test_statistics_of_a_text():
    got = dict(zip(quality.FEATURES, quality.statistics("Ab cd ef.\nAb cd ef.\n1é ##"), strict=True))
    assert got["lines"] == pytest.approx(np.log(4)) and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["distinct_words"] == 5 / 8 and got["symbol_words"] == 1 / 8 and got["digits"] == 1 / 25
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.FEATURES)
    assert len(quality.statistics(" \n ")) == len(quality.FEATURES)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = document_quality(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() and got.score.between(0, 1).all()
    floor = max(held.quality.mean(), 1 - held.quality.mean())
    assert (held.predicted == held.quality).mean() > max(0.95, floor)
    assert (got.predicted == (got.score >= 0.7)).all()


def test_edge_rows(spark):
    rows = [(1, "good text here."), (2, "## $$ %%"), (3, None), (4, ""), (5, "x " * 90000), (6, "again"), (6, "again"), (None, "good text here.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as features", "2 as score", "3 as label")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (99, 1), (4, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 8 and len({r.score for r in got if r.doc_id == 6}) == 1
    by = {r.doc_id: r for r in got}
    assert by[None].score == by[1].score and not by[None].held_out and by[3].score == by[4].score
    assert quality.classify(docs.where("1 = 0"), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("1 = 0")).collect()} == {0.5}
