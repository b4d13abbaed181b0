import random
import re
from itertools import permutations

import numpy as np
import pytest

from plumbline.llm import filter_audit as f
from plumbline.llm.grams import joined

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))]


def brute(rows, labels):
    """rows: (doc_id, text, part); every order is applied document by document."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids.setdefault(t, []).append(i)
    marked = lambda i, k: any(r[k] == 1 for r in labels if r[0] == i and i is not None)
    docs = []
    for i, t, p in rows:
        words, unique, capitals, points, symbols = counts(t)
        fails = {"A": words < 100, "B": 100 * unique < 80 * words, "C": 100 * capitals > 10 * points, "D": symbols > 0, "E": i is not None and min(ids[t]) < i}
        docs.append((p, {x for x, y in fails.items() if y}, marked(i, 1), marked(i, 2)))
    out, removed_of = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_of[part, x] = removed_of.get((part, x), 0) + len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x in d[1] for d in own) - len(gone) - sum(x in d[1] for d in left), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: [*v, removed_of[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def as_dict(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


def test_every_order_is_that_of_brute_force(spark, awkward, prose):
    more = [(100 + i, t, "en", p) for i, (t, p) in enumerate([(prose(i, 130), "en") for i in range(6)] + [("X# " * 200, "de")] * 3 + [("same word " * 60, None)] * 2)]
    docs = awkward.select("doc_id", "text", "row", "lang").union(spark.createDataFrame(more, "doc_id long, text string, `row` string, lang string"))
    marks = [(0, 1, 0), (3, 0, 1), (3, 1, 1), (101, 1, None), (106, None, 1), (107, 0, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = as_dict(f.audit(docs.repartition(3), labels))
    assert found == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], marks)


def test_empty_tables(spark, nothing, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert f.audit(nothing, labels).count() == 0
    parts = {r.part for r in awkward.selectExpr("coalesce(lang, '') AS part").collect()}
    assert f.audit(awkward, labels).count() == 600 * len(parts)


@pytest.mark.parametrize("piece", [7, 64, 1 << 22])
def test_long_texts_are_measured_in_pieces(prose, piece):
    for text in (prose(9, 400), "é" * 300 + " ñandú\x00 " + prose(2, 50) * 2, "", " ", "#A b\x0bc\x85d A", "x" * 5000):
        assert f.measured([text.encode()], piece).tolist() == [counts(text)]
    texts = ["", "One two two #", prose(4, 90), "é É"]
    assert f.measured([t.encode() for t in texts]).tolist() == [counts(t) for t in texts]


def test_equal_hashes_do_not_merge_different_words():
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([1, 2, 3, 8, 9, 17]))) for _ in range(500)]
    data, _ = joined([b" ".join(words)], None)
    did = f.actions(data)
    begin, end = np.flatnonzero(did & f.BEGIN), np.flatnonzero(did & f.END)
    owner = np.arange(begin.size) // 250
    kept = f.distinct_spans(data, begin, end, owner, np.zeros(begin.size, np.uint64))
    first = {}
    for i, w in enumerate(words):
        first.setdefault((i // 250, w), i)
    assert kept.tolist() == sorted(first.values())


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "A b", "x"), (3, "A # b", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    found = as_dict(f.audit(docs, labels, {"P": "n_capitals > 0", "Q": "n_symbols > 0"}))
    assert found == {("x", "PQ", 1): [1, 2, 0, 1, 1, 0, 3], ("x", "PQ", 2): [1, 0, 1, 0, 0, 0, 1], ("x", "QP", 1): [2, 1, 0, 0, 1, 0, 1], ("x", "QP", 2): [1, 1, 1, 1, 0, 0, 3]}
