import hashlib
import re

import pytest

from plumbline.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = split(text)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, named = split(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[i : i + m]))):
                    hit.update(range(i, i + m))
                    named |= found
        names = sorted(str(x) for x in named if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(spark, prose):
    item = [(1, prose(50, 30)), (2, prose(51, 12)), (22, prose(51, 12)), (3, "só três palavras"), (4, ""), (5, None), (None, prose(52, 11)), (1, prose(53, 15)), (9, "go go go go go go go go go go go")]
    w = prose(50, 30).split()
    docs = [(0, "intro words " + item[0][1].upper() + " outro"), (1, " ".join(w[:9])), (2, " ".join(w[3:13]) + " x " + " ".join(w[3:13])), (3, "a; só-três.palavras b"), (4, None), (5, ""),
            (6, prose(60, 200)), (7, item[1][1] + " " + item[0][1]), (7, item[1][1]), (None, item[6][1]), (8, "go " * 40), (9, prose(61, 30_000) + " " + item[0][1])]
    return docs, item


def test_hits_are_those_of_brute_force(spark, case, monkeypatch):
    docs, items = case
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 60):  # one block, then one item a block
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        assert sorted(map(tuple, d.report(d.find_matches(frame, benchmark)).collect()), key=str) == brute(docs, items)
        kept = d.decontaminate(frame, benchmark).collect()
        assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])


def test_longest_matches_and_places(spark, case):
    docs, items = case
    found = d.find_matches(spark.createDataFrame(docs[:1], "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string")).first()
    assert [tuple(m) for m in found.matches] == [(2, 30, 1, 0)]


def test_awkward_tables(spark, awkward, nothing, case):
    benchmark = spark.createDataFrame(case[1], "item_id long, text string")
    assert d.report(d.find_matches(awkward, benchmark)).count() == awkward.count()
    assert d.find_matches(nothing, benchmark).count() == 0 and d.decontaminate(nothing, benchmark).count() == 0
    clean = d.decontaminate(awkward, benchmark.limit(0))
    assert clean.count() == awkward.count() and clean.schema.simpleString() == awkward.schema.simpleString()
