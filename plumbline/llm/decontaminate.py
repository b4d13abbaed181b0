"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents, 32 MB at a time, into one training shard: words as numbers, 0 for words the benchmark never uses and
between documents. Suffixes that start with enough benchmark words to match anything are sorted into the shard's suffix array (the
others cannot match and need no place in it). Every benchmark suffix is binary-searched in the array; matches on one diagonal are
joined into the longest verbatim matches, with their places. The benchmark is taken in blocks of at most BLOCK_BYTES, each sent to
all tasks, so what is broadcast is bounded however long the benchmark is; nothing of the documents is shuffled for one block.

Null and wordless documents have no words and are clean; null and wordless items match nothing. Repeated rows are judged each on
its own. Items whose id is null mark words but are not listed. Empty tables give empty or all-clean results.
Other columns, whatever their names, are carried as they are or not read. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import buffers, column, numbered, query, table, whole_row

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
#: Lower-cases A-Z, keeps a-z, 0-9 and every byte above 7F, and turns the rest into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCHES = "array<struct<start:long,length:long,item:long,item_start:long>>"
MATCH_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.int64()), ("item_start", pa.int64())]))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Block:
    """A part of the benchmark: its words, and its suffixes as fixed-width keys."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        low, high, need, owner, place = [], [], [], [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            m = min(window, len(ids))
            for j in range(len(ids) - m + 1 if m else 0):
                low.append(ids[j : j + m] + [0] * (window - m))
                high.append(ids[j : j + m] + [0xFFFFFFFF] * (window - m))
                need.append(m), owner.append(item_id), place.append(j)
        self.low, self.high = _keys(low, window), _keys(high, window)
        self.need, self.place = np.array(need, np.int64), np.array(place, np.int64)
        self.least = int(self.need.min()) if need else 0
        names = {x: i for i, x in enumerate(dict.fromkeys(owner))}
        self.item, self.names = np.array([names[x] for x in owner], np.int64), list(names)


def _keys(rows, window: int) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(np.asarray(rows, np.uint32).reshape(-1, window).astype(">u4")).view(f"S{4 * window}").ravel()


def _shard_matches(shard: np.ndarray, block: Block):
    """Longest verbatim matches of the block in the shard: (start, length, item, place in the item), by start."""
    none = np.empty((0, 4), np.int64)
    if not block.least:
        return none
    w = block.window
    text = np.concatenate([shard, np.zeros(w, np.uint32)])
    gaps = np.flatnonzero(text == 0)
    at = np.flatnonzero(shard)
    at = at[gaps[np.searchsorted(gaps, at)] - at >= block.least]
    if not at.size:
        return none
    rows = text[at[:, None] + np.arange(w)]
    rows *= np.logical_and.accumulate(rows != 0, axis=1)
    keys = _keys(rows, w)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    counts = np.maximum(hi - lo, 0)
    if not counts.sum():
        return none
    suffix = np.repeat(np.arange(counts.size), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = array[lo[suffix] + within]
    item, place, need = block.item[suffix], block.place[suffix], block.need[suffix]
    order = np.lexsort((start, start - place, item))
    start, item, place, need = start[order], item[order], place[order], need[order]
    new = np.ones(start.size, bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(start - place) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], start.size) - 1
    found = np.stack([start[first], start[last] + need[last] - start[first], item[first], place[first]], axis=1)
    return found[np.argsort(found[:, 0], kind="stable")]


def _search(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    """The batch, with n_words and the matches of each row."""
    block = block.value
    number = block.vocabulary.get
    for whole in batches:
        step = max(1, int(whole.num_rows * min(1, SHARD_BYTES / max(1, whole.nbytes))))
        for k in range(0, whole.num_rows, step):
            batch = whole.slice(k, step)
            parts, ends, n = [], [], 0
            for text in buffers(batch.column("text")):
                found = words(text)
                parts += [np.fromiter(map(number, found, repeat(0)), np.uint32, len(found)), np.zeros(1, np.uint32)]
                n += len(found) + 1
                ends.append(n)
            ends = np.array(ends, np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            hits = _shard_matches(np.concatenate(parts), block)
            row = np.searchsorted(ends, hits[:, 0], "right")
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = pa.StructArray.from_arrays(
                [pa.array(hits[:, 0] - begins[row]), pa.array(hits[:, 1]), pa.array([block.names[i] for i in hits[:, 2]], pa.int64()), pa.array(hits[:, 3])],
                fields=list(MATCH_TYPE.value_type))
            matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans).cast(MATCH_TYPE)
            kept = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ends - begins - 1), matches], names=[*batch.schema.names, "n_words", "matches"])


def blocks(benchmark: DataFrame, text: str, item_id: str, window: int) -> Iterator:
    """The benchmark as broadcast blocks of bounded size."""
    held, size = [], 0
    rows = benchmark.select(column(benchmark, item_id, "long"), F.encode(column(benchmark, text, "string"), "utf-8"))
    for name, body in rows.toLocalIterator():
        held.append((name, bytes(body or b"")))
        size += len(held[-1][1]) + 16
        if size >= BLOCK_BYTES:
            yield benchmark.sparkSession.sparkContext.broadcast(Block(held, window))
            held, size = [], 0
    yield benchmark.sparkSession.sparkContext.broadcast(Block(held, window))


def _searched(rows: DataFrame, block) -> DataFrame:
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda batches: _search(batches, block), f"{kind}, n_words long, matches {MATCHES}")


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words and all longest verbatim matches (start and length in words, item, place in the item)."""
    parts = list(blocks(benchmark, "text", item_id, window))
    flat = lambda d: d.select(column(d, doc_id, "long").alias("doc_id"), column(d, text, "string").alias("text"))
    if len(parts) == 1:
        return _searched(flat(docs), parts[0]).drop("text")
    rows = numbered(flat(docs)).select("rid", "row.*")
    found = [_searched(rows, part).drop("text") for part in parts]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).drop("rid")


def report(matches: DataFrame) -> DataFrame:
    """Hit words and items of each document, from its matches."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    def add(seen, x):
        end = F.greatest(seen["e"], x["e"])
        return F.struct((seen["n"] + end - F.greatest(seen["e"], F.least(x["s"], end))).alias("n"), end.alias("e"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"].cast("string")), lambda x: x.isNotNull())))
    n_hit = F.aggregate(spans, zero, add, lambda seen: seen["n"])
    return matches.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                          F.sha2(F.array_join(items, ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents no benchmark window occurs in, with all their columns."""
    for block in blocks(benchmark, "text", "item_id", window):
        rows = docs.select(column(docs, text, "string").alias("text"), whole_row(docs).alias("row"))
        docs = _searched(rows, block).filter(F.size("matches") == 0).select("row.*")
    return docs


@query("op5_decontaminate", r"""
WITH words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word, len(w) AS n FROM
  (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
doc AS (SELECT doc_id, list(word ORDER BY i) AS w, any_value(n) AS n FROM words GROUP BY doc_id),
starts AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS key
  FROM (SELECT doc_id, w, m, unnest(range(1, (n - m + 2)::BIGINT)) AS i FROM doc, sizes WHERE n >= m)),
hits AS (SELECT doc_id, item_id, i, s.m FROM starts s JOIN windows USING (key) WHERE s.m = windows.m),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(doc.n, 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN doc USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op5_decontaminate(spark, sf_dir):
    return report(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
