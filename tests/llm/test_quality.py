import numpy as np
import pytest

from plumbline.llm import quality as q


@pytest.fixture(scope="module")
def corpus(spark, prose):
    junk = lambda i: (" ".join([prose(i, 1)] * 40), prose(i, 20).upper().replace(" ", "!! "), prose(i, 20).replace(" ", "%%% "))[i % 3]
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 5 + i % 40), int(i % 5 != 0)) for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    return rows, docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")


def test_junk_goes_and_prose_stays(corpus):
    rows, docs, labels = corpus
    kept = {r.doc_id for r in q.keep_good(docs, labels).collect()}
    good, bad = {i for i, _, y in rows if y}, {i for i, _, y in rows if not y}
    assert len(good - kept) <= 2 and len(bad & kept) <= 3


def test_k_rows_by_key(corpus):
    _, docs, labels = corpus
    found = q.resample(docs, labels, k=37, temperature=5.0).collect()
    order = sorted(found, key=lambda r: -r.key)
    assert {r.doc_id for r in found if r.kept} == {r.doc_id for r in order[:37]}
    assert {r.doc_id for r in found if r.kept} != {r.doc_id for r in sorted(found, key=lambda r: -r.log_weight)[:37]}
    assert sum(r.kept for r in q.resample(docs, labels, k=0).collect()) == 0
    assert sum(r.kept for r in q.resample(docs, labels, k=10_000).collect()) == 500


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    for values in ([1.0], [2.0] * 9, [0.0, 1e300, -1e300, 1e-300, 5.0, 5.0], rng.normal(size=3000).tolist(), (rng.normal(size=500) // 0.3).tolist()):
        frame = spark.createDataFrame([(v,) for v in values], "key double")
        for k in {1, 2, len(values) // 2 or 1, len(values)} & set(range(1, len(values) + 1)):
            assert q.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]
    assert q.kth_largest(frame.limit(0), 3) is None


def test_gumbel_noise(spark):
    draws = np.array([r[0] for r in spark.range(20_000).select(q.gumbel("id")).collect()])
    assert abs(draws.mean() - 0.5772) < 0.05 and abs(draws.std() - 1.2825) < 0.05


def test_awkward_tables(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (10, 1), (12, 1), (13, 0), (19, 0), (None, 1), (5, None), (77, 0)], "doc_id long, quality int")
    kept = q.keep_good(awkward, labels)
    assert kept.schema.simpleString() == awkward.schema.simpleString() and 0 < kept.count() <= awkward.count()
    assert q.keep_good(awkward, labels.filter("quality = 1")).count() == awkward.count()
    assert q.keep_good(nothing, labels).count() == 0 and q.keep_good(awkward, labels.limit(0)).count() == awkward.count()
    empty = [r for r in q.resample(awkward, labels).collect() if not r.n_events]
    assert empty and all(r.log_weight == 0 for r in empty)
