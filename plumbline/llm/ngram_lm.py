"""Language-model scores by deleted interpolation of bigrams.

Each token's probability mixes the maximum-likelihood estimates c(v w)/c(v) and c(w)/N with a uniform floor 1/(V+1); the mixture
weights depend on how often the context v was seen, by powers of two, and are learned by expectation-maximisation. The held-out counts
for that are the training counts with the token itself deleted, over every training token: tokens are tallied by bucket and by quarter
octaves of both estimates, a table of bounded size, and only that table reaches the driver.

Texts are cut into batches of 8 MB; a batch numbers its words and keeps its tokens as packed arrays, stored once. Its distinct words and
word pairs go, as sorted 64- and 56-bit hashes with their training counts, to shards of bounded size, which add up the counts of all
batches and send each batch its own keys' totals. So a pair crosses the network once per batch, however frequent it is, and no count
table is ever whole in one place. Two words share a count only if their 64-bit hashes agree.

Null text is empty: one end token. A null id folds as the empty text. Rows may repeat; each counts and is scored. Without training rows
every token has probability 1/(V+1) = 1. Empty tables give empty results.
Other columns are not read, whatever their names. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, buffers, column, packed, query, stored, table, unpacked
from plumbline.llm.grams import fold

BATCH_BYTES = 8 << 20
SHARD_KEYS = 1 << 20
PAIR_BITS = 56
STEPS = 60
OCTAVE = 4
TOP = 255
WORDS, PAIRS = 0, 1

BATCH = "bid long, ids array<long>, train array<boolean>, lens array<long>, words binary, tokens binary, n_words long, n_pairs long"
BATCH_SCHEMA = pa.schema([
    ("bid", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("words", pa.binary()),
    ("tokens", pa.binary()), ("n_words", pa.int64()), ("n_pairs", pa.int64())])


def tokens_of(text: bytes) -> list[bytes]:
    """Words, then the end token, which is the empty word."""
    return [*text.lower().split(), b""]


def _packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _least(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId() << 24, 0
    ids, train, lens, parts, size, seen = [], [], [], [], 0, defaultdict(count().__next__)
    def row():
        words, where = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)), return_inverse=True)
        tokens = where.astype(np.uint32)[np.concatenate(parts)]
        pairs = tokens.size  # an upper bound of the distinct pairs
        return batch_of(BATCH_SCHEMA, [part + number], [ids], [train], [lens], [_packed_sorted(words)], [packed(_least(tokens))], [words.size], [pairs])
    for batch in batches:
        for doc_id, learns, text in zip(batch.column("id").to_pylist(), batch.column("train").to_pylist(), buffers(batch.column("text")), strict=True):
            found = tokens_of(text or b"")
            parts.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
            ids.append(doc_id), train.append(learns), lens.append(len(found))
            size += len(text or b"")
            if size >= BATCH_BYTES:
                yield row()
                number += 1
                ids, train, lens, parts, size, seen = [], [], [], [], 0, defaultdict(count().__next__)
    if ids:
        yield row()


class Batch:
    """A stored batch, unpacked: words (sorted hashes), tokens (places in words), before (each token's context)."""

    def __init__(self, row: dict):
        self.words, self.tokens = _unpacked_sorted(row["words"]), unpacked(row["tokens"]).astype(np.int64)
        self.lens, self.train = np.array(row["lens"], np.int64), np.array(row["train"], bool)
        self.learns = np.repeat(self.train, self.lens)
        ends = np.cumsum(self.lens)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[0] = self.tokens[ends[0] - 1]  # a text begins after an end token, as the next one does

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs as sorted hashes, and each token's pair."""
        v, w = self.words[self.before], self.words[self.tokens]
        key = (v * np.uint64(0x9E3779B97F4A7C15) ^ (w << np.uint64(31) | w >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
        key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(key >> np.uint64(64 - PAIR_BITS), return_inverse=True)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


KEYED = "kind int, shard int, bid long, keys binary, n binary"
KEYED_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("bid", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _cut(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where each shard of a sorted key array begins, and the end."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [keys.size]]).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch], bits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for stored_batch in batches:
        for row in _rows(stored_batch):
            b = Batch(row)
            pairs, which = b.pairs()
            for kind, keys, at, width in ((WORDS, b.words, b.tokens, 64), (PAIRS, pairs, which, PAIR_BITS)):
                n = np.bincount(at[b.learns], minlength=keys.size)
                cut = _cut(keys, bits[kind], width)
                full = np.flatnonzero(np.diff(cut))
                for group in np.array_split(full, max(1, full.size // 64)):
                    yield batch_of(
                        KEYED_SCHEMA, [kind] * group.size, group.tolist(), [row["bid"]] * group.size,
                        [_packed_sorted(keys[cut[s] : cut[s + 1]]) for s in group], [packed(_least(n[cut[s] : cut[s + 1]])) for s in group])


TOTAL = "kind int, shard int, bid long, totals binary, v long, n long"
TOTAL_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("bid", pa.int64()), ("totals", pa.binary()), ("v", pa.int64()), ("n", pa.int64())])


def _totals(group: pa.Table) -> pa.Table:
    """Training counts of a shard's keys over all batches, returned to each batch in the order of its keys."""
    keys = [_unpacked_sorted(k) for k in group["keys"].to_pylist()]
    n = np.concatenate([unpacked(x) for x in group["n"].to_pylist()])
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, n, every.size).astype(np.int64)
    ends = np.cumsum([k.size for k in keys])
    totals = [packed(_least(total[where[e - k.size : e]])) for k, e in zip(keys, ends, strict=True)]
    first = [1] + [0] * (len(keys) - 1)
    known, tokens = int((total > 0).sum()), int(total.sum())
    return pa.table([group["kind"], group["shard"], group["bid"], pa.array(totals, pa.binary()), pa.array([known * x for x in first], pa.int64()),
                     pa.array([tokens * x for x in first], pa.int64())], schema=TOTAL_SCHEMA)


COUNTED = "ids array<long>, lens array<long>, tokens binary, words binary, pairs binary, bucket int, i int, j int, n long"
COUNTED_SCHEMA = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary()), ("pairs", pa.binary()),
    ("bucket", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _octaves(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 and up by quarter octaves below 1."""
    return np.where(p > 0, np.minimum(TOP, 1 + np.floor(-OCTAVE * np.log2(np.where(p > 0, p, 1)))), 0).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], n_tokens: int) -> Iterator[pa.RecordBatch]:
    """The batch with its totals, then its tally of deleted estimates."""
    for joined in batches:
        for row in _rows(joined):
            b = Batch(row)
            parts = sorted((p["kind"], p["shard"], p["totals"]) for p in row["parts"])
            words, pairs = (np.concatenate([unpacked(t) for k, _, t in parts if k == kind]).astype(np.int64) for kind in (WORDS, PAIRS))
            pairs = pairs[b.pairs()[1]]
            yield batch_of(COUNTED_SCHEMA, [row["ids"]], [row["lens"]], [row["tokens"]], [packed(_least(words))], [packed(_least(pairs))], *[[None]] * 4)
            context, word = words[b.before[b.learns]] - 1, words[b.tokens[b.learns]] - 1
            p2 = np.divide(pairs[b.learns] - 1, context, out=np.zeros(context.size), where=context > 0)
            i, j = _octaves(p2), _octaves(word / max(1, n_tokens - 1))
            cells, n = np.unique((buckets(context) << 16) + (i << 8) + j, return_counts=True)
            none = [None] * cells.size
            yield batch_of(COUNTED_SCHEMA, none, none, none, none, none, cells >> 16, cells >> 8 & 255, cells & 255, n)


def mixture(bucket: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, floor: float) -> np.ndarray:
    """Weights of pair, word and uniform estimate for each of 64 buckets, by expectation-maximisation; a bucket begins at all buckets' weights."""
    middle = lambda q: np.where(q > 0, 2.0 ** (-(q - 0.5) / OCTAVE), 0)
    p = np.stack([middle(i), middle(j), np.full(i.size, floor)], axis=1)
    weights = np.tile([0.0, 0.0, 1.0], (64, 1))
    if not n.size:
        return weights
    def learn(start, rows):
        w = start
        for _ in range(STEPS):
            share = p[rows] * w
            share *= (n[rows] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) + 10 * start
            w /= w.sum()
        return np.maximum(w, [0, 0, 1e-9])
    every = learn(np.full(3, 1 / 3), slice(None))
    for b in range(64):
        rows = np.flatnonzero(bucket == b)
        weights[b] = learn(every, rows) if rows.size else every
    weights[0] = [0, *weights[0, 1:] / weights[0, 1:].sum()]  # an unseen context has no pairs
    return weights


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"
SCORED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(batches: Iterator[pa.RecordBatch], n_tokens: int, v: int, weights) -> Iterator[pa.RecordBatch]:
    for counted in batches:
        for row in _rows(counted):
            b = Batch(row | {"words": packed(np.zeros(1, np.uint64)), "train": [True] * len(row["lens"])})
            words, pair = unpacked(row["words"]).astype(np.int64), unpacked(row["pairs"]).astype(np.int64)
            word, context = words[b.tokens], words[b.before]
            w = weights.value[buckets(context)]
            p = w[:, 2] / (v + 1) + w[:, 1] * (word / max(1, n_tokens)) + w[:, 0] * np.divide(pair, context, out=np.zeros(pair.size), where=context > 0)
            starts = np.cumsum(b.lens) - b.lens
            add = lambda x, s=starts: np.add.reduceat(x, s)
            base = np.log10((word + 1) / (n_tokens + v + 1))
            yield batch_of(SCORED_SCHEMA, row["ids"], b.lens, add((word > 0).astype(np.int64)), add(base), add(np.log10(p)))


def score(docs: DataFrame, train, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; `train` is a condition on docs: rows to learn from."""
    spark = docs.sparkSession
    flat = docs.select(column(docs, doc_id, "long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), column(docs, text, "string").alias("text"))
    batches = stored(flat.mapInArrow(_batches, BATCH))
    sizes = batches.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    bits = tuple(max(0, (int(n or 0) // SHARD_KEYS)).bit_length() for n in sizes)
    keyed = batches.mapInArrow(lambda b: _keys(b, bits), KEYED)
    totals = stored(keyed.groupBy("kind", "shard").applyInArrow(_totals, TOTAL))
    v, n_tokens = (int(x or 0) for x in totals.filter(f"kind = {WORDS}").agg(F.sum("v"), F.sum("n")).first())
    parts = totals.groupBy("bid").agg(F.collect_list(F.struct("kind", "shard", "totals")).alias("parts"))  # the batch's own keys, once each
    joined = batches.join(parts, "bid").mapInArrow(lambda b: _counted(b, n_tokens), COUNTED)
    counted = stored(joined)
    tally = counted.filter("bucket IS NOT NULL").groupBy("bucket", "i", "j").agg(F.sum("n").alias("n")).toArrow()  # bounded by its three scales
    weights = spark.sparkContext.broadcast(mixture(*(tally[c].to_numpy() for c in ("bucket", "i", "j", "n")), 1 / (v + 1)))
    rows = counted.filter("bucket IS NULL").select("ids", "lens", "tokens", "words", "pairs").mapInArrow(lambda b: _scores(b, n_tokens, v, weights), SCORED)
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op2_deleted_interpolation")
def op2_deleted_interpolation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 7) == 2
    return score(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
