import hashlib
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import exact_dedup as e

WHITE = re.compile("[\x20\x09-\x0d]")


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(WHITE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_groups_are_those_of_brute_force(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for capacity in (1, 3, 1000):
        found = e.assign(awkward.repartition(3), capacity=capacity).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == brute(rows)
        by_text = {}
        for r in found:
            by_text.setdefault(r.text_sha256, []).append(r)
        assert all(sum(r.kept for r in g) == 1 and all(r.doc_id == r.keep_id for r in g if r.kept) for g in by_text.values())


def test_rows_that_stay_keep_their_columns(awkward, nothing):
    kept = e.deduplicate(awkward.repartition(4))
    assert kept.schema.simpleString() == awkward.schema.simpleString()
    every = e.assign(awkward).filter("kept").collect()
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, [r.doc_id for r in every]))
    assert e.deduplicate(nothing).count() == 0 and e.assign(nothing).count() == 0


def test_long_ago_hot_text(spark):
    hot = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('t', id) ELSE 'copy of a text' END AS text")
    found = e.assign(hot).groupBy("group_size").count().collect()
    assert {r.group_size: r["count"] for r in found} == {1: 1000, 2000: 2000}


def test_directory_splits_until_buckets_fit():
    counts = np.zeros(1 << 8, np.int64)
    counts[:4], counts[200] = 10, 500
    slots = e.directory(counts, 15)
    sums = np.bincount(np.repeat(slots, counts.size // slots.size), counts)
    assert sorted(sums[sums > 0]) == [10, 10, 10, 10, 500]
    assert e.directory(np.zeros(1 << 8, np.int64), 1).tolist() == [0]


def test_one_key_with_different_bytes_is_chained():
    texts = [b"one", b"two", b"o ne", b"two"]
    batch = pa.RecordBatch.from_pydict({"key": pa.array([7] * 4, pa.int64()), "body": pa.array(texts, pa.binary())})
    (key,) = e._chains(iter([batch.slice(0, 2), batch.slice(2)]), lambda b: b.column("body"))
    assert [(norm, len(members)) for norm, members in key] == [(b"one", 2), (b"two", 2)]
