import random

import numpy as np
import pytest

from plumbline.llm import toxicity as x
from plumbline.llm.grams import labelled


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        words = prose(1000 + i, 30).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(rnd.randrange(30), rnd.choice(["zvok", "zvokar", "QUXIT"]))
        if i % 8 == 0 or i % 40 == 1:  # mostly toxic rows name one group
            words.insert(rnd.randrange(30), "muslims")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def learned(spark, rows):
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    return x.learn(labelled(docs.select("doc_id", "text"), labels, "toxic"))


def test_held_out_rows(spark, corpus):
    model = learned(spark, [r for r in corpus if r[0] % 5])
    test = [r for r in corpus if not r[0] % 5]
    scores = model.scores([t.encode() for _, t, _ in test])
    assert np.mean((scores >= 0.7) == [y > 0 for *_, y in test]) > 0.97


def test_swaps_do_not_move_the_score(spark, corpus, prose):
    texts = [f"the muslims {prose(k, 20)}".encode() for k in range(2000, 2020)]
    fair = learned(spark, corpus)
    copies = [x.swapped(t, 1) for t in texts]
    gap = np.abs(fair.scores(texts) - fair.scores(copies)).max()
    plain = x.PENALTY
    try:
        x.PENALTY = 0.0
        unfair = learned(spark, corpus)
    finally:
        x.PENALTY = plain
    assert gap < 0.1 * np.abs(unfair.scores(texts) - unfair.scores(copies)).max()
    assert (fair.scores(texts) < 0.5).all() and fair.scores([b"a ZVOK b"])[0] > 0.7


def test_swap():
    assert x.swapped("Women and men, NOT womenx".encode(), 1) == b" men and girls  not womenx "
    assert x.swapped(b"none here", 1) is None


def test_awkward_tables(spark, corpus, awkward, nothing):
    model = learned(spark, corpus)
    found = x.score(awkward.repartition(3), model).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)
    assert x.score(nothing, model).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert {r.score for r in x.score(awkward, x.learn(labelled(awkward, labels.limit(0), "toxic"))).collect()} == {1 / (1 + np.exp(50.0))}
    assert [(r.doc_id, r.y) for r in labelled(awkward, labels, "toxic").collect()] == [(2, 1)]
