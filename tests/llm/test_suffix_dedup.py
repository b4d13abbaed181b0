import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffix_dedup as s


def brute(rows):
    seen, twice = set(), set()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for k in range(len(t) - 199):
            (twice if t[k : k + 200] in seen else seen).add(t[k : k + 200])
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if t[k : k + 200] in twice:
                gone[k : k + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(4)
    shared = [prose(k, 60) for k in range(12)] + ["ab" * 300, "z" * 700, "é" * 150, prose(90, 32)[:199], prose(91, 40)[:200], prose(92, 40)[:201]]
    rows = []
    for i in range(120):
        text = prose(500 + i, rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 3)):
            piece = rnd.choice(shared)
            a, b = sorted((rnd.randint(0, len(piece)), rnd.randint(0, len(piece))))
            text += rnd.choice(["", " "]) + (piece if rnd.random() < 0.6 else piece[a:b]) + prose(900 + i, rnd.randint(0, 30))
        if i % 9 == 0 and rows:
            words = list(rnd.choice(rows)[1])
            for _ in range(rnd.randint(0, 3)):
                words.insert(rnd.randint(0, len(words)), "#")
            text = "".join(words)
        rows.append((i, text))
    return [*rows, (None, rows[5][1]), (7, rows[7][1]), (200, None), (201, ""), (202, shared[0])]


@pytest.mark.parametrize("hot", [4096, 5, 1])
def test_removed_bytes_are_those_of_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(s, "OWNER_ROWS", 1 << 15 if hot == 4096 else 40)
    monkeypatch.setattr(s, "SHARD_KEYS", 1 << 20 if hot == 4096 else 300)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    assert found(s.remove_repeats(docs, hot=hot)) == brute(corpus)


def test_kept_bytes_and_awkward_tables(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    result = s.remove_repeats(awkward.repartition(3))
    assert found(result) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in result.collect())
    assert s.remove_repeats(nothing).count() == 0


def test_texts_longer_than_a_chunk(monkeypatch):
    rng = np.random.default_rng(1)
    part = rng.integers(97, 123, 3000, dtype=np.uint8)
    data = np.concatenate([part, rng.integers(97, 123, 5000, dtype=np.uint8), part])
    whole = s.anchors(data, np.array([data.size]))
    monkeypatch.setattr(s, "CHUNK", 1000)
    monkeypatch.setattr(s, "POWERS", {})
    cut = s.anchors(data, np.array([data.size]))
    at = lambda x: {(int(a), i) for a, f, last in zip(*x[:3], strict=True) for i in range(f, last + 1)}
    assert at(whole) == at(cut) and len(at(whole)) == data.size - 199
    spots = {i: a - i for a, i in at(whole)}
    assert all(spots[i] == spots[i + 8000] for i in range(3000 - 199))


def test_merged_transforms_equal_one_over_all_rows():
    rng = np.random.default_rng(5)
    seeds = rng.integers(97, 100, (6, s.WIDTH), dtype=np.uint8)
    rows = seeds[rng.integers(0, 6, 90)].copy()
    rows[np.arange(90), rng.integers(0, s.WIDTH, 90)] = 65
    before, after = rng.integers(0, s.REACH + 1, 90), np.full(90, s.LENGTH)
    block = np.sort(rng.integers(0, 3, 90))
    shard = rng.integers(0, 4, 90)
    order = np.lexsort((block, shard))
    rows, before, after, block, shard = rows[order], before[order], after[order], block[order], shard[order]
    streams = np.concatenate([s.shard_transform(rows[shard == k], block[shard == k], before[shard == k], after[shard == k]) for k in range(4)], axis=1)
    hit = s.merge_transforms(streams, shard, block, before, after)
    for c in range(s.REACH + 1):
        for i in range(90):
            mine = c >= s.REACH - before[i] and c + s.LENGTH <= s.REACH + after[i]
            other = any(j != i and block[i] == block[j] and c >= s.REACH - before[j] and (rows[i, c : c + s.LENGTH] == rows[j, c : c + s.LENGTH]).all() for j in range(90)) if mine else False
            assert hit[c, i] == other
