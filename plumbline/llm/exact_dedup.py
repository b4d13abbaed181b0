"""Exact deduplication over an extendible-hash index kept in shared files.

Each task normalises its texts and merges the equal ones it holds into one index entry, so a text with a billion copies enters the
index once per 32 MB of input, not once per copy. Entries go to shared files under a 64-bit key. A directory of key prefixes is
doubled until no bucket is overfull; owner tasks take whole buckets, read them in key order and chain the entries of a key,
telling texts apart by their bytes. The directory holds bucket sizes only and has at most 2**MAX_DEPTH slots; a bucket still
overfull at that depth is read by its owner all the same, for an owner keeps one key's chain in memory, never a bucket.

Null text counts as empty. Rows may repeat and ids may be null or repeat: of equal texts exactly one row stays, the one with most
code points, then the smallest id (null last), then the first in the stored order. An empty table gives an empty result.
Other columns, whatever their names, are carried as they are or not read. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.base import batch_of, buffers, column, query, stored, table, whole_row

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
UNIT_BYTES = 32 << 20
CAPACITY = 512
MAX_DEPTH = 16
ENTRY = "gid long, key long, size long, n_cp int, id long, uid long, sha binary, body binary"
ENTRY_SCHEMA = pa.schema([
    ("gid", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("n_cp", pa.int32()), ("id", pa.int64()), ("uid", pa.int64()),
    ("sha", pa.binary()), ("body", pa.binary())])
LAST = 1 << 63


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= UNIT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _rank(n_cp, doc_id, uid):
    return (-n_cp, LAST if doc_id is None else doc_id, uid)


def _grouped(unit: pa.Table, uids: range, body: pa.Array):
    """Chains of equal texts in one unit: (digest, rows of the group, its best row) each; the group number of each row."""
    texts = [x or b"" for x in buffers(body)]
    lengths = pc.fill_null(pc.utf8_length(body), 0).to_pylist()
    ids = unit["id"].to_pylist()
    chains: dict[bytes, list[int]] = {}
    groups, of_row = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        norm = text.translate(None, WHITE)
        digest = hashlib.sha256(norm).digest()
        for g in chains.setdefault(digest, []):
            if groups[g][3] == norm:
                break
        else:
            g = len(groups)
            chains[digest].append(g)
            groups.append([digest, 0, i, norm])
        of_row[i] = g
        groups[g][1] += 1
        best = groups[g][2]
        if _rank(lengths[i], ids[i], uids[i]) < _rank(lengths[best], ids[best], uids[best]):
            groups[g][2] = i
    return groups, of_row, texts, lengths, ids


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per input row (size 0), then one index entry per distinct text of the unit, with the bytes of its best row."""
    first = TaskContext.get().partitionId() << 33
    row = 0
    for unit in _units(batches):
        uids = range(first + row, first + row + unit.num_rows)
        groups, of_row, texts, lengths, ids = _grouped(unit, uids, unit["text"].chunk(0))
        gid = (of_row + uids[0]).tolist() if unit.num_rows else []
        n, none = len(ids), [None] * len(ids)
        yield batch_of(ENTRY_SCHEMA, gid, none, [0] * n, none, ids, list(uids), none, none)
        for k in range(0, len(groups), 2000):
            part = groups[k : k + 2000]
            best = [g[2] for g in part]
            yield batch_of(
                ENTRY_SCHEMA, [uids[0] + k + i for i in range(len(part))], [_key(g[0]) for g in part], [g[1] for g in part],
                [lengths[b] for b in best], [ids[b] for b in best], [uids[b] for b in best], [g[0] for g in part], [texts[b] for b in best])
        row += unit.num_rows


def _body(row: pa.Array, at: int | None) -> pa.Array:
    """The text in a column of whole rows; null where the table has none."""
    return pa.nulls(len(row), pa.string()) if at is None else row.field(at).cast(pa.string())


def _rows(batches: Iterator[pa.RecordBatch], at: int | None) -> Iterator[pa.RecordBatch]:
    """Index entries that carry the whole best row; its text is in the row only."""
    first = TaskContext.get().partitionId() << 33
    row = 0
    for unit in _units(batches):
        uids = range(first + row, first + row + unit.num_rows)
        groups, _, _, lengths, ids = _grouped(unit, uids, _body(unit["row"].chunk(0), at))
        for k in range(0, len(groups), 2000):
            part = groups[k : k + 2000]
            best = [g[2] for g in part]
            taken = unit.take(pa.array(best, pa.int64())).combine_chunks()
            columns = {
                "key": pa.array([_key(g[0]) for g in part], pa.int64()), "n_cp": pa.array([lengths[b] for b in best], pa.int32()),
                "id": pa.array([ids[b] for b in best], pa.int64()), "uid": pa.array([uids[b] for b in best], pa.int64()),
                "row": taken["row"].chunk(0)}
            yield pa.RecordBatch.from_pydict(columns)
        row += unit.num_rows


def directory(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket number of each slot. `counts` are entries by key prefix of MAX_DEPTH bits; an overfull bucket is split, and where its
    local depth equals the global one the directory doubles first."""
    finest = int(counts.size).bit_length() - 1
    sums = np.concatenate([[0], np.cumsum(counts)])
    depth, leaves, open_ = 0, [], [(0, 0)]
    while open_:
        prefix, local = open_.pop()
        width = finest - local
        if local < finest and sums[(prefix + 1) << width] - sums[prefix << width] > capacity:
            depth = max(depth, local + 1)
            open_ += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            leaves.append((prefix, local))
    slots = np.empty(1 << depth, np.int32)
    for number, (prefix, local) in enumerate(leaves):
        slots[prefix << (depth - local) : (prefix + 1) << (depth - local)] = number
    return slots


def _with_bucket(pages: DataFrame, capacity: int) -> DataFrame:
    spark = pages.sparkSession
    slot = lambda bits: F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    counts = np.zeros(1 << MAX_DEPTH, np.int64)
    for prefix, n in pages.groupBy(slot(MAX_DEPTH).alias("p")).count().collect():  # at most 2**MAX_DEPTH rows
        counts[prefix] = n
    slots = directory(counts, capacity)
    bits = slots.size.bit_length() - 1
    listed = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(slots.size), pa.int64()), "bucket": pa.array(slots, pa.int32())}))
    return pages.withColumn("slot", slot(bits)).join(F.broadcast(listed), "slot").drop("slot")  # the directory has a fixed bound


def _chains(batches: Iterator[pa.RecordBatch], body):
    """Entries of one key at a time, chained by equal bytes of body(batch): lists of (table, row) per distinct text."""
    held: list[list] = []
    now = None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        texts = buffers(body(batch))
        for i, key in enumerate(keys.tolist()):
            if key != now:
                if held:
                    yield held
                held, now = [], key
            norm = (texts[i] or b"").translate(None, WHITE)
            for chain in held:
                if chain[0] == norm:
                    chain[1].append((batch, i))
                    break
            else:
                held.append([norm, [(batch, i)]])
    if held:
        yield held


OWNED = "gid long, keep_id long, keep_uid long, group_size long, text_sha256 string"
OWNED_SCHEMA = pa.schema([("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for key in _chains(batches, lambda b: b.column("body")):
        for _, members in key:
            facts = [tuple(b.column(c)[i].as_py() for c in ("gid", "size", "n_cp", "id", "uid", "sha")) for b, i in members]
            best = min(facts, key=lambda f: _rank(f[2], f[3], f[4]))
            size = sum(f[1] for f in facts)
            out += [(f[0], best[3], best[4], size, best[5].hex()) for f in facts]
        if len(out) >= 5000:
            yield batch_of(OWNED_SCHEMA, *zip(*out, strict=True))
            out = []
    if out:
        yield batch_of(OWNED_SCHEMA, *zip(*out, strict=True))


def _keep(batches: Iterator[pa.RecordBatch], at: int | None) -> Iterator[pa.RecordBatch]:
    for key in _chains(batches, lambda b: _body(b.column("row"), at)):
        for _, members in key:
            b, i = min(members, key=lambda m: _rank(*(m[0].column(c)[m[1]].as_py() for c in ("n_cp", "id", "uid"))))
            yield pa.RecordBatch.from_arrays([b.column("row").slice(i, 1)], names=["row"])


def _by_owner(pages: DataFrame, capacity: int) -> DataFrame:
    return _with_bucket(pages, capacity).repartition("bucket").sortWithinPartitions("bucket", "key")


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 of the text without white space."""
    index = stored(docs.select(column(docs, doc_id, "long").alias("id"), column(docs, text, "string").alias("text")).mapInArrow(_entries, ENTRY))
    owned = _by_owner(index.filter("size > 0"), capacity).mapInArrow(_own, OWNED)
    rows = index.filter("size = 0").select("gid", F.col("id").alias("doc_id"), "uid")
    return rows.join(owned, "gid").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns; the index entries carry the rows, so nothing is joined back."""
    flat = docs.select(column(docs, doc_id, "long").alias("id"), whole_row(docs).alias("row"))
    at = docs.columns.index(text) if text in docs.columns else None
    kind = T.StructType([T.StructField(c, t) for c, t in (("key", T.LongType()), ("n_cp", T.IntegerType()), ("id", T.LongType()), ("uid", T.LongType()), ("row", flat.schema["row"].dataType))])
    pages = stored(flat.mapInArrow(lambda b: _rows(b, at), kind))
    kept = _by_owner(pages, capacity).mapInArrow(lambda b: _keep(b, at), pages.select("row").schema)
    return kept.select("row.*")


@query("op8_exact_dedup", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""")
def op8_exact_dedup(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))
