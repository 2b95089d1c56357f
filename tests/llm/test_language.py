import numpy as np
import pytest

from flowquarry.llm import language
from flowquarry.llm.queries import document_languages


def test_bundles_equal_the_sum_of_bound_letters():
    text = "Abc dé 42 x"
    letters = [0, *map(ord, "abc"), 0, *map(ord, "dé"), 0, ord("x"), 0]

    def vector(code):
        return language._letter(code, 64).astype(float)

    want = sum(
        np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False) if b
    )
    assert np.allclose(language.document_vectors([text], 64)[0], want)
    alphabet = "".join(chr(0x4E00 + i) for i in range(400))  # many letters take the sorting path
    grams = language._grams([alphabet])[1]
    values, place = language._distinct(grams)
    assert (values[place] == grams).all()


def test_held_out_accuracy(spark, folder):
    got = document_languages(spark, folder).toPandas()
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert len(both) == len(lang) and (held.lang_pred == held.lang).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"),
            (5, "123 *** !!", None), (6, "the dog", None), (6, "the dog", None), (None, "und der", "de"),
            (8, "the cat and the dog " * 20000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.fit(docs)
    got = {r[0]: r[1] for r in docs.select("doc_id", language.detect(profiles, docs.text).lang_pred).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", None: "de", 8: "en"}
    clashing = docs.selectExpr("*", "1 as found", "2 as score", "3 as lang_pred")
    kept = language.keep_known(clashing, profiles)
    assert kept.columns == clashing.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 6, 8]


def test_unlearnt_language_and_random_letters_go(spark, folder):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null and length(text) >= 200").select("doc_id", "text", "lang")
    learnt = docs.where("lang in ('en', 'de')")
    profiles = language.fit(learnt)
    clean = learnt.count()
    assert language.keep_known(learnt, profiles).count() >= 0.99 * clean
    other = docs.where("lang in ('fr', 'es')")
    assert language.keep_known(other, profiles).count() <= 0.1 * other.count()
    soup = [(i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 300)), None) for i in range(50)]
    soup += [(100 + i, "".join(rng.choice(list("*#@!%&/=0123456789  "), 300)) + "qxvzkjwp", None) for i in range(50)]
    assert language.keep_known(spark.createDataFrame(soup, docs.schema), profiles).count() == 0


@pytest.mark.parametrize("condition", ["1 = 0", "lang is null"])
def test_nothing_to_learn_from(spark, condition):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string").where(condition)
    profiles = language.fit(docs)
    assert profiles.languages == ()
    assert {r[0] for r in docs.select(language.detect(profiles, docs.text).lang_pred).collect()} <= {"und"}
