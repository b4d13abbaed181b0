"""Filter interaction audit: what each of several document filters removes, in every order in which they can be applied.

Texts are measured by a table-driven byte transducer. Its state is "between words" or "in a word" and depends on the last byte alone, so
one lookup in ACTION by (state, byte) gives what happens at every byte of many texts at once: a word begins or ends, a code point begins, a capital
or a symbol is seen. Word spans go into an open-addressing hash table, and a slot counts as the same word only if all its bytes are equal.
White space never occurs inside a UTF-8 sequence, so a text longer than PIECE is cut at white space and its table is carried on.

Which filters fail is a bit mask per document; a copy is told by the SHA-256 of its text, and is a failure where a smaller id has that text.
Counts per (part, mask) are summed in Spark before anything is ordered, the first of each group of copies is found by a minimum summed per
task, and all orders and steps are read from at most 2**k counts a part. So a text with a billion copies is a count, and never a group.

Null text is empty, null part is the empty string. A row with a null id is no copy and has no label; rows that repeat an id and text are
both kept or both removed. A document with several labels has a label's 1 if any of them has it. Other columns are not read, whatever
their names. An empty table gives no rows. Very long texts and words take memory for one piece and for their distinct words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, column, query, stored, table
from plumbline.llm.grams import MIX, SEPARATOR, joined, slices, windows

WHITE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
PIECE = 1 << 22
BEGIN, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
BASE = np.uint64(0x9DDFEA08EB382D69)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state after each byte (1 in a word), and the action at 256 * state + byte."""
    byte = np.arange(256)
    inside = ~np.isin(byte, list(WHITE))
    seen = POINT * (byte & 0xC0 != 0x80) + CAPITAL * ((byte >= 65) & (byte <= 90)) + SYMBOL * np.isin(byte, list(SYMBOLS))
    return inside.astype(np.uint16) << 8, np.concatenate([seen + BEGIN * inside, seen + END * ~inside]).astype(np.uint8)


NEXT, ACTION = _tables()


def actions(data: np.ndarray) -> np.ndarray:
    """The transducer's run over `data`, which begins between words."""
    at = data.astype(np.uint16)
    at[1:] += NEXT[data[:-1]]
    return ACTION[at]


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A number for each span and its owner, from one sum over all bytes."""
    power = np.full(data.size, BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.full(data.size, INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    h = (total[end] - total[begin]) * back[begin] + owner.astype(np.uint64) * MIX
    h ^= h >> np.uint64(32)
    return h * MIX


def same_bytes(wide: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes at a and at b are equal, eight bytes a round."""
    equal, left, k = np.ones(a.size, bool), np.arange(a.size), 0
    while left.size:
        rest = np.minimum(size[left] - k, 8)
        differ = (wide[a[left] + k] ^ wide[b[left] + k]) & MASKS[rest] != 0
        equal[left[differ]] = False
        k += 8
        left = left[~differ & (size[left] > k)]
    return equal


def distinct_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the spans that are the first entry of their owner with their bytes. Every span is put into the table; where a slot is taken,
    it is the same word only if owner, length and bytes are, and else the next slot is tried."""
    n = begin.size
    if not n:
        return np.empty(0, np.int64)
    wide, size = windows(data, 8), end - begin
    bits = max(4, int(2 * n).bit_length())
    slots, last = np.full(1 << bits, -1, np.int64), (1 << bits) - 1
    slot = ((_hashes(data, begin, end, owner) if hashes is None else hashes) >> np.uint64(64 - bits)).astype(np.int64)
    waiting, kept = np.arange(n), []
    while waiting.size:
        free = waiting[slots[slot[waiting]] < 0]
        slots[slot[free[::-1]]] = free[::-1]
        holder = slots[slot[waiting]]
        won = holder == waiting
        kept.append(waiting[won])
        waiting, holder = waiting[~won], holder[~won]
        alike = (owner[waiting] == owner[holder]) & (size[waiting] == size[holder])
        alike[alike] = same_bytes(wide, begin[waiting[alike]], begin[holder[alike]], size[waiting[alike]])
        waiting = waiting[~alike]
        slot[waiting] = (slot[waiting] + 1) & last
    return np.sort(np.concatenate(kept))


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut at white space into pieces of about `size` bytes; a longer word stays whole."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text) and text[to] not in WHITE:
            to += 1
        yield text[at:to]
        at = to


def _measured(texts: list[bytes], skip: int = 0) -> tuple[np.ndarray, bytes]:
    """One row per text: words, distinct words, capitals, code points, symbols; the first `skip` bytes of a single text are words that are
    known already and count only among the distinct ones. Also the distinct words of the last text, joined."""
    data, begins = joined(texts, None)
    did = actions(data)
    first, last = begins[:-1] + len(SEPARATOR), begins[1:]
    starts, ends = np.flatnonzero(did & BEGIN), np.flatnonzero(did & END)
    owner = np.searchsorted(last, starts, "right")
    kept = distinct_spans(data, starts, ends, owner)
    between = lambda at: np.searchsorted(at, last) - np.searchsorted(at, first + skip)
    capitals, symbols, tails = (np.flatnonzero(x) for x in (did & CAPITAL, did & SYMBOL, did & POINT == 0))
    points = last - first - skip - between(tails)
    unique = np.bincount(owner[kept], minlength=len(texts))
    words = b" ".join([data[a:b].tobytes() for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]) if len(texts) == 1 else b""
    return np.stack([between(starts), unique, between(capitals), points, between(symbols)], axis=1), words


def measured(texts: list[bytes], piece: int = PIECE) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text."""
    if len(texts) > 1 or len(texts[0]) <= piece:
        return _measured(texts)[0]
    total, pool = np.zeros(5, np.int64), b""
    for part in _pieces(texts[0], piece):
        known = pool + b" " if pool else b""
        (row,), pool = _measured([known + part], len(known))
        total += row
        total[1] = row[1]
    return total[None]


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
FACTS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("sha", pa.binary()), *[(c, pa.int64()) for c in COUNTS]])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch):
            own = batch.slice(first, len(texts))
            yield batch_of(FACTS, own.column("doc_id"), own.column("part"), [hashlib.sha256(t).digest() for t in texts], *measured(texts).T)


def facts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, part, sha (of the text) and the counts of every row."""
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), F.coalesce(column(docs, part, "string"), F.lit("")).alias("part"), column(docs, text, "string").alias("text"))
    return flat.mapInArrow(_facts, "doc_id long, part string, sha binary, " + ", ".join(f"{c} long" for c in COUNTS))


#: What fails, by letter, as conditions on the counts; None is the filter of copies.
FILTERS: dict[str, str | None] = {
    "A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_capitals > 10 * n_points", "D": "n_symbols > 0", "E": None}


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, str | None] = FILTERS, **names) -> DataFrame:
    """part, mask (bit k: the k-th filter fails), n, good, toxic: documents and their labels by what fails."""
    bit = {letter: 1 << k for k, letter in enumerate(filters)}
    copy = next((bit[letter] for letter, rule in filters.items() if rule is None), 0)
    mask = sum((F.when(F.expr(rule), bit[letter]).otherwise(0) for letter, rule in filters.items() if rule), F.lit(0))
    rows = stored(facts(docs, **names).select("doc_id", "part", "sha", mask.cast("int").alias("mask")))
    marks = labels.select(column(labels, "doc_id", "long").alias("doc_id"), *[(column(labels, c, "int") == 1).cast("long").alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic")).filter("good + toxic > 0")
    least = rows.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(least, ["sha", "doc_id"]).select("doc_id", "part", "mask")

    def summed(some: DataFrame, with_ids: int, without: int) -> DataFrame:
        """Documents of `some` by (part, mask), those with an id counted `with_ids` times as copies and `without` times as no copy."""
        n = some.groupBy("part", "mask").agg(F.count("doc_id").alias("with_id"), F.count(F.lit(1)).alias("every"))
        good = some.join(marks, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        none = F.lit(0).cast("long")
        rowless = n.select("part", "mask", (F.col("every") - F.col("with_id")).alias("n"), none.alias("good"), none.alias("toxic"))
        of = lambda times, b: (n.select("part", F.col("mask").bitwiseOR(b).alias("mask"), (F.col("with_id") * times).alias("n"), none.alias("good"), none.alias("toxic"))
                               .union(good.select("part", F.col("mask").bitwiseOR(b).alias("mask"), none.alias("n"), F.col("good") * times, F.col("toxic") * times)))
        return rowless.union(of(with_ids, copy)) if not without else of(with_ids, copy).union(of(without, 0))

    every = summed(rows, 1, 0)
    return (every.union(summed(firsts, -1, 1)) if copy else every).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str | None] = FILTERS, **names) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = list(filters)
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    step = lambda order, k: F.struct(
        F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit[order[k]]).alias("own"), F.lit(sum(bit[x] for x in order[:k])).alias("before"))
    counts = stored(cells(docs, labels, filters, **names))
    # the orders are a literal of k! * k entries; each counted cell is read once for each of them
    read = counts.withColumn("at", F.explode(F.array(*[step(order, k) for order in permutations(letters) for k in range(len(letters))]))).select("*", "at.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    where = lambda condition, what: F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")
    share = F.when(fails, F.expr(f"n * ({factorial(len(letters))} div bit_count(mask))")).otherwise(0)
    return read.groupBy("part", "filter_order", "step").agg(
        where(~fails & ~earlier, "n").alias("kept"), where(fails & ~earlier, "n").alias("removed"), where(fails & earlier, "n").alias("redundant"),
        where(F.col("mask") == F.col("own"), "n").alias("unique_fails"), where(fails & ~earlier, "good").alias("good_lost"),
        where(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


@query("op13_filter_interaction_audit", """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
least AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) AS c, regexp_matches(w.t, '[#$%&*|]') AS d,
             coalesce(w.doc_id > least.first_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w JOIN least ON w.t = least.t LEFT JOIN marks ON w.doc_id = marks.doc_id),
cell AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
      WHERE l1.x <> l2.x AND l3.x NOT IN (l1.x, l2.x) AND l4.x NOT IN (l1.x, l2.x, l3.x) AND l5.x NOT IN (l1.x, l2.x, l3.x, l4.x)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before,
             concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed
      FROM cell, s),
v AS (SELECT *, contains(failed, own) AS fails, len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(before, x))) > 0 AS earlier FROM r),
g AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM v GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g""")
def op13_filter_interaction_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
