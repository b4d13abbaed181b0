"""SimHash near-deduplication: fingerprints joined on a grid of segment bit counts.

A fingerprint's 64 bits are cut into segments of two, and each segment is mapped to its number of set bits. The Manhattan distance
of two such vectors never exceeds the Hamming distance of the fingerprints, so it may reject pairs but loses none. The segments form
radius + 2 groups; two fingerprints within the radius differ in at most `radius` groups, so at least two groups have distance zero:
the grid has one axis for each choice of two groups, and a cell is the counts of that choice. Only fingerprints that share a cell are
compared, first by Manhattan distance of all counts, then exactly. Equal fingerprints are merged before the grid. A cell of more than
BLOCK members is split into blocks, and each pair of blocks is a task's work, so a hot cell spreads over many tasks. Within a task the
links found become a spanning forest, so a thousand near copies leave a thousand links, not a million; components stay exact.

Null and empty texts have fingerprint zero and are linked like any other. Rows may repeat. component_id is the smallest id reachable,
null only where all ids are null. Empty tables give empty results.
Other columns, whatever their names, are carried as they are or not read. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, buffers, column, numbered, query, stored, table
from plumbline.llm.components import components, forest

WORDS = 4
RADIUS = 4
SEED = 42
SEGMENT = 2
BLOCK = 2048
EVEN = np.uint64(0x5555555555555555)


def shingle_hashes(text: bytes, words: int = WORDS) -> bytes:
    """Eight bytes per shingle, highest bit first."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return b""
    line, width = b" ".join(found), min(words, n)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])


def fingerprint_of(hashes: bytes) -> bytes:
    """Eight bytes, highest bit first."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8 * 65536):
        counts += np.unpackbits(np.frombuffer(hashes[k : k + 8 * 65536], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes) // 8).tobytes()


def fingerprint(text: bytes, words: int = WORDS) -> bytes:
    return fingerprint_of(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The batch, its text replaced by the fingerprint."""
    for batch in batches:
        data = b"".join([fingerprint(t or b"", words) for t in buffers(batch.column("text"))])
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.frombuffer(data, ">i8").astype(np.int64))], names=[*names, "fp"])


def fingerprints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """`rows` with the column text replaced by fp."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda b: _fingerprints(b, words), f"{kind}, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, each written as one of 00, 01, 11, so that Manhattan distance is the number of differing bits."""
    high, low = fps >> np.uint64(1) & EVEN, fps & EVEN
    return (high & low) << np.uint64(1) | (high | low)


def cells(embedded: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """One array of cell numbers per choice of two of the radius + 2 groups of segments."""
    groups = [np.array(g, np.uint64) for g in np.array_split(np.arange(64 // SEGMENT), radius + 2)]
    for number, (a, b) in enumerate(combinations(groups, 2)):
        mask = np.uint64(sum(3 << int(SEGMENT * s) for s in (*a, *b)))
        yield ((embedded & mask) ^ (embedded & mask) >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)


CELL = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _cell_rows(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for code in cells(embed(fps.view(np.uint64)), radius):
            yield batch_of(CELL, code.view(np.int64), fps)


def linked(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of a cell; rows are in cell order. The d-th round compares each member with the d-th after it."""
    embedded, at, found = embed(fps), np.arange(fps.size), []
    d = 1
    while True:
        at = at[at + d < fps.size]
        at = at[cell[at] == cell[at + d]]
        if not at.size:
            break
        near = at[np.bitwise_count(embedded[at] ^ embedded[at + d]) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + d]) <= radius]
        if near.size:
            found.append((fps[near], fps[near + d]))
            if sum(x[0].size for x in found) > 1 << 20:
                found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        d += 1
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (fps[:0], fps[:0])


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    cell, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    def out(c, f):
        u, v = linked(c, f, radius)
        return batch_of(EDGE, u.view(np.int64), v.view(np.int64))
    for batch in batches:
        cell = np.concatenate([cell, batch.column("cell").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if cell.size and cell[0] != cell[-1]:
            done = int(np.searchsorted(cell == cell[-1], True)) if (np.diff(cell) >= 0).all() else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            yield out(cell[:done], fps[:done])
            cell, fps = cell[done:], fps[done:]
    if cell.size:
        yield out(cell, fps)


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join all fingerprints (column fp, each once) within the radius into their components."""
    placed = distinct.select("fp").mapInArrow(lambda b: _cell_rows(b, radius), "cell long, fp long")
    hot = stored(placed.groupBy("cell").count().filter(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    marked = placed.join(hot, "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("cell", F.least(j, mine), F.greatest(j, mine)))
    whole = marked.filter("blocks IS NULL").select("cell", "fp")
    split = marked.filter("blocks IS NOT NULL").select(F.explode(pairs).alias("cell"), "fp")
    return whole.union(split).repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _links(b, radius), "u long, v long")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root of every fingerprint of `rows` (a stored table with fp): the smallest fingerprint of its component."""
    distinct = stored(rows.select("fp").distinct())
    roots = components(near_links(distinct, radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = stored(fingerprints(docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text")), words))
    root = stored(classes(rows, radius))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(root, "fp")
    named = root.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row of each component, with all its columns: the smallest id, null last, then the first stored."""
    kept = numbered(docs)
    rows = stored(fingerprints(kept.select("rid", F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), F.col(f"row.`{text}`").cast("string").alias("text")), words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first")
    least = rows.groupBy("fp").agg(first).join(classes(rows, radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return kept.join(least.select(F.col("first.rid").alias("rid")), "rid", "left_semi").select("row.*")


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
