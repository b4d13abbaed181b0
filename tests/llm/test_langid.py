import random

import numpy as np
import pytest

from plumbline.llm import langid as g
from plumbline.llm.grams import joined, windows

SOUNDS = {"aa": "bcdfg", "bb": "hklmn", "cc": "prstv"}


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(8)
    word = lambda lang: "".join(rnd.choice(SOUNDS[lang]) + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))
    vocabulary = {lang: [word(lang) for _ in range(400)] for lang in SOUNDS}
    return lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))


def test_held_out_accuracy(spark, spoken):
    rows = [(i, spoken(lang := list(SOUNDS)[i % 3], 4 + i % 60) + (" " + spoken("aa", 3) if i % 7 == 0 else ""), lang, i % 4 == 2) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, test boolean").repartition(4)
    model = g.learn(docs.filter("NOT test").select("text", "lang"))
    found = {r.doc_id: r for r in g.predict(docs, model).collect()}
    test = [(i, lang) for i, _, lang, held in rows if held]
    assert np.mean([found[i].lang_pred == lang for i, lang in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_undetermined_and_nulls(spark, spoken, awkward, nothing):
    known = spark.createDataFrame([(spoken("aa", 50), "aa"), (spoken("bb", 50), "bb"), (spoken("bb", 50), "bb"), (None, "aa"), ("x", None)] * 3, "text string, lang string")
    model = g.learn(known)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3"), (4, "q"), (4, "q"), (None, spoken("aa", 9))], "doc_id long, text string")
    found = [(r.doc_id, r.lang_pred) for r in g.predict(docs.coalesce(1), model).collect()]
    assert found == [(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (4, "bb"), (None, "aa")]
    assert {r.lang_pred for r in g.predict(docs, g.learn(known.limit(0))).collect()} == {"und"}
    assert g.predict(awkward, model).count() == awkward.count() and g.predict(nothing, model).count() == 0


def test_cells_return_every_language_of_a_gram(spark, spoken):
    texts = {lang: [spoken(lang, 80) for _ in range(5)] for lang in SOUNDS}
    model = g.learn(spark.createDataFrame([(t, lang) for lang, x in texts.items() for t in x], "text string, lang string"))
    for k, lang in enumerate(model.languages):
        data, begins = joined([t.encode() for t in texts[lang]])
        n, held = model.counts(data, begins)
        grams, seen = np.unique(windows(data, 4)[g._usable(data)], return_counts=True)
        owned = seen[seen >= g.LEAST].sum()
        assert held[:, k].sum() >= owned > 0 and n.sum() == seen.sum()  # no false negatives
    assert (model.chance < 0.2).all()
