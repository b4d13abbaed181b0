import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ngram_lm as m
from plumbline.llm.grams import fold


def tokens(text):
    return m.tokens_of((text or "").encode())


def brute(rows, train):
    """Counts, tally, weights and scores, token by token."""
    words, pairs = Counter(), Counter()
    for (_, text), learns in zip(rows, train, strict=True):
        if learns:
            t = tokens(text)
            words.update(t)
            pairs.update(zip([b"", *t[:-1]], t, strict=True))
    n, v, tally = sum(words.values()), len(words), Counter()
    for (v1, w), times in pairs.items():
        p2 = (pairs[v1, w] - 1) / (words[v1] - 1) if words[v1] > 1 else 0
        cell = [m.buckets(np.array([words[v1] - 1]))[0], *(m._octaves(np.array([p]))[0] for p in (p2, (words[w] - 1) / max(1, n - 1)))]
        tally[tuple(int(x) for x in cell)] += times
    cells = np.array(list(tally), np.int64).reshape(-1, 3)
    weights = m.mixture(*cells.T, np.array(list(tally.values()), np.int64), 1 / (v + 1))
    out = []
    for doc_id, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for a, w in zip([b"", *t[:-1]], t, strict=True):
            lam = weights[m.buckets(np.array([words[a]]))[0]]
            base += math.log10((words[w] + 1) / (n + v + 1))
            score += math.log10(lam[2] / (v + 1) + lam[1] * words[w] / max(1, n) + (lam[0] * pairs[a, w] / words[a] if words[a] else 0))
        out.append((doc_id, len(t), sum(words[w] > 0 for w in t), n, base, score))
    return out


@pytest.fixture(scope="module")
def corpus(prose):
    return [(i, " ".join(prose(i % 60, 50).split()[: 5 + i % 46]) if i % 11 else None) for i in range(300)]


def same(found, want):
    found, want = (sorted(x, key=str) for x in (map(tuple, found), want))
    assert len(found) == len(want)
    key = lambda r: (str(r[0]), r[1], round(r[4], 4))
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-9)


def test_scores_are_those_of_brute_force(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in corpus]
    want = brute(corpus, train)
    for keys, size in ((m.SHARD_KEYS, m.BATCH_BYTES), (500, m.BATCH_BYTES)):
        monkeypatch.setattr(m, "SHARD_KEYS", keys)
        same(m.score(docs, fold(F.col("doc_id"), 7) != 2).collect(), want)


def test_held_out_texts_gain_on_the_base(spark, prose):
    rows = [(i, " ".join(prose(k % 40, 30) for k in range(i, i + 4))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = m.score(docs, F.col("doc_id") % 7 != 2).filter("doc_id % 7 = 2").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.8 * held[1]


def test_probabilities_of_a_context_add_up():
    rng = np.random.default_rng(0)
    weights = m.mixture(rng.integers(0, 9, 400), rng.integers(0, 40, 400), rng.integers(1, 60, 400), rng.integers(1, 99, 400), 1e-4)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] == 0


def test_awkward_tables(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    same(m.score(awkward.repartition(2), F.col("doc_id") % 3 != 0).collect(), brute(rows, [i is not None and i % 3 != 0 for i, _ in rows]))
    assert m.score(nothing, F.lit(True)).count() == 0
    untrained = m.score(awkward, F.lit(False)).collect()
    assert len(untrained) == len(rows) and all(r.score == r.base_score == 0 and r.train_tokens == r.n_known == 0 for r in untrained)
