import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import components as c
from plumbline.llm import simhash as s

WORD = re.compile("[^\x20\x09-\x0d]+")


def union(n, links):
    parent = list(range(n))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain(text):
    w = WORD.findall("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(6)
    rows = []
    for i in range(250):
        words = prose(i % 90, 120).split()
        for _ in range(i // 90):
            words[rnd.randrange(120)] = "changed"
        rows.append((1000 - i, " ".join(words)))
    return rows


def check(found, rows):
    prints = [plain(t) for _, t in rows]
    f = np.array(prints, np.uint64)
    root = union(len(rows), [(i, int(j) + i + 1) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4)])
    least = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    want = sorted([(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True)], key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want


def test_links_are_those_of_brute_force(spark, corpus, awkward, nothing):
    check(s.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)), corpus)
    check(s.near_duplicates(awkward), [(r.doc_id, r.text) for r in awkward.collect()])
    assert s.near_duplicates(nothing).count() == 0


def test_dense_balls_and_split_cells(spark, monkeypatch):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(20)]
    prints = list({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for centre in centres for _ in range(60)} | {rnd.getrandbits(64) for _ in range(300)})
    f = np.array(prints, np.uint64)
    root = union(len(f), [(i, int(j) + i + 1) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4)])
    frame = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    for block in (2048, 7):
        monkeypatch.setattr(s, "BLOCK", block)
        found = {r.fp: r.root for r in s.classes(frame).collect()}
        groups = {}
        for x, r in zip(f.view(np.int64).tolist(), root, strict=True):
            groups.setdefault(r, []).append(x)
        assert all({found[x] for x in g} == {min(g)} for g in groups.values())


def test_counts_bound_the_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * k) & np.uint64(3)) for k in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(s.embed(a) ^ s.embed(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


def test_one_row_of_each_group_stays(spark, corpus, awkward, nothing):
    for frame in (spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), awkward):
        kept = s.drop_near_duplicates(frame)
        assert kept.schema.simpleString() == frame.schema.simpleString()
        groups = {r.component_id for r in s.near_duplicates(frame).collect()}
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, groups))
    assert s.drop_near_duplicates(nothing).count() == 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    root = union(400, links)
    found = {r.node: r.root for r in c.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {x: r for x, r in enumerate(root) if x != r}
    u, v = np.array(links).T
    assert dict(zip(*(x.tolist() for x in c.forest(u, v)), strict=True)) == found
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0
