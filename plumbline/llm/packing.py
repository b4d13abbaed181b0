"""Packing of token sequences by a configuration linear program over the length histogram.

Tokenising is per task; a document becomes pieces of at most LIMIT tokens, and only their lengths, places and checksums are kept.
The histogram of lengths, at most LIMIT numbers however many documents there are, is all that reaches the driver. There the covering
program "fewest sequences whose configurations hold every length as often as it occurs" is solved by multiplicative weights: each
round a knapsack dynamic program prices the best configuration under the current weights, and lengths it serves lose weight. The
fractional solution is rounded down against what is left, the rest is solved again, and the last pieces are placed best-fit. The
plan gives, for each length, ranges of ranks; pieces find their rank by counting per task and a running sum over the tasks' counts,
so no length, however frequent, is sorted or numbered in one task.

Null and empty texts are the end token alone. Rows may repeat; each is packed. Empty tables give an empty result.
Other columns are not read, whatever their names. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, buffers, column, query, stored, table

LIMIT = 4096
END = 1
CACHED = 500_000
ROUNDS = 240
RATE = 0.5
LAST = 4000
PIECE = "doc_id long, block int, nth long, piece int, start long, length long, ids_crc32 long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("nth", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: A word of these letters is one pre-token that no normaliser joins or splits; so is a run of these marks.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Token ids of texts. Spaces and line feeds end a pre-token, so what stands between them is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
        self.letters = [shown[b] for b in range(256)]
        self.simple = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str().replace(" ", "")
        self.seen: dict[bytes, bytes] = {b"": b""}

    def _of(self, chunk: bytes) -> bytes:
        if (ids := self.seen.get(chunk)) is None:
            ids = self.seen[chunk] = self._word(chunk)
        return ids

    def _word(self, chunk: bytes) -> bytes:
        head = chunk.rstrip(MARKS)
        if self.simple and head and (head.isalpha() or LATIN.fullmatch(head.decode(errors="replace"))):
            lower = head.lower() if head.isascii() else head.decode().lower().encode()
            if lower != chunk:
                return self._of(lower) + self._of(chunk[len(head) :])
        elif head or not self.simple:
            return array("I", self.tokenizer.encode(chunk.decode(errors="replace"), add_special_tokens=False).ids).tobytes()
        return array("I", [t.id for t in self.model.tokenize("".join([self.letters[b] for b in chunk]))]).tobytes()

    def ids(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        chunks = text.replace(b"\n", b" ").split(b" ")
        found = list(map(self.seen.get, chunks))
        if None in found:
            if len(self.seen) > CACHED:
                self.seen = {b"": b""}
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._of(chunks[i])
        return b"".join(found)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces with their number among the task's pieces of the same length."""
    block, counts, encoder = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64), None
    for whole in batches:
        encoder = encoder or Encoder(path)
        for k in range(0, whole.num_rows, 2000):
            batch, out = whole.slice(k, 2000), []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), buffers(batch.column("text")), strict=True):
                ids = encoder.ids(text or b"") + END.to_bytes(4, "little")
                for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[start : start + 4 * limit]
                    n = len(part) // 4
                    out.append((doc_id, block, int(counts[n]), piece, start // 4, n, zlib.crc32(part)))
                    counts[n] += 1
            yield batch_of(PIECE_SCHEMA, *zip(*out, strict=True))


def best_configuration(prices: np.ndarray, limit: int) -> dict[int, int]:
    """Lengths and how often: the knapsack of most total price. `prices[l]` is that of length l, 0 where it does not occur."""
    worth, choice = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    backwards = prices[1 : limit + 1]
    for room in range(1, limit + 1):
        total = worth[:room][::-1] + backwards[:room]
        best = int(total.argmax())
        if total[best] > worth[room - 1]:
            worth[room], choice[room] = total[best], best + 1
        else:
            worth[room] = worth[room - 1]
    out: dict[int, int] = {}
    room = limit
    while room > 0:
        if choice[room]:
            out[int(choice[room])] = out.get(int(choice[room]), 0) + 1
            room -= int(choice[room])
        else:
            room -= 1
    return out


def fractional(counts: np.ndarray, limit: int, rounds: int) -> list[tuple[dict[int, int], float]]:
    """Configurations and how many sequences of each, from `rounds` equal steps of multiplicative weights."""
    lengths = np.flatnonzero(counts)
    bound = max(1.0, float((counts * np.arange(counts.size)).sum()) / limit)
    step = bound / rounds
    covered, taken = np.zeros(counts.size), {}
    for _ in range(rounds):
        behind = np.zeros(counts.size)
        share = covered[lengths] / counts[lengths]
        behind[lengths] = np.exp(-RATE * (share - share.min()) * rounds / 4) * lengths  # a length's price starts at its size
        behind[counts < 1] = 0
        config = best_configuration(behind / max(behind.max(), 1e-300), limit)
        if not config:
            break
        key = tuple(sorted(config.items(), reverse=True))
        taken[key] = taken.get(key, 0) + step
        for length, n in key:
            covered[length] += n * step
    return [(dict(k), x) for k, x in taken.items()]


def solve(counts: np.ndarray, limit: int = LIMIT, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(configuration, sequences of it), holding every length exactly as often as `counts` has it."""
    left, plan = counts.astype(np.int64).copy(), []
    while left.sum() > LAST or not plan and left.sum():
        before = left.sum()
        found = sorted(fractional(left, limit, rounds), key=lambda c: -sum(a * n for a, n in c[0].items()))
        full = [c for c in found if sum(a * n for a, n in c[0].items()) >= 0.999 * limit]
        for group in (full, found):  # tight configurations first; others only where those make no headway
            for config, x in group:
                n = min(int(np.ceil(x)), *(int(left[a]) // m for a, m in config.items()))
                if n > 0:
                    plan.append((tuple(sorted(config.items(), reverse=True)), n))
                    for a, m in config.items():
                        left[a] -= n * m
            if left.sum() < 0.8 * before:
                break
        if left.sum() > 0.95 * before:
            break
    return plan + best_fit(left, limit)


def best_fit(left: np.ndarray, limit: int):
    """Best-fit decreasing over what rounding left. Equal lengths that fill new sequences alike are placed together."""
    left, open_, plan = left.copy(), {}, {}
    room = np.zeros(limit + 1, np.int64)  # sequences by free room
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if fits.size:
                free = length + int(fits[0])
                config, k = open_[free].popitem()
                used = min(k, n)
                each = min(free // length, n // used) if used else 0
            else:
                free, config, k = limit, (), max(1, n // (limit // length))
                each = min(limit // length, n)
                used = min(k, n // each)
                k = used
                room[limit] += used
            room[free] -= used
            if k > used:
                open_[free][config] = k - used
            grown = (*config, (length, each))
            rest = free - each * length
            held = open_.setdefault(rest, {})
            held[grown] = held.get(grown, 0) + used
            room[rest] += used
            n -= used * each
    for held in open_.values():
        for config, k in held.items():
            if config:
                plan[config] = plan.get(config, 0) + k
    return list(plan.items())


class Plan:
    """Where the piece of a given length and rank goes."""

    def __init__(self, plan, limit: int):
        first, rows, used = 0, [], np.zeros(limit + 1, np.int64)
        for config, n in plan:
            offset = 0
            for length, each in config:
                rows.append((length, used[length], each, first, offset))
                used[length] += each * n
                offset += length * each
            first += n
        self.sequences = first
        rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.base, self.each, self.first, self.offset = rows.T
        self.starts = np.searchsorted(self.length, np.arange(limit + 2))

    def place(self, length: np.ndarray, rank: np.ndarray):
        at = np.empty(length.size, np.int64)
        for n in np.unique(length):
            a, b = self.starts[n], self.starts[n + 1]
            mine = length == n
            at[mine] = a + np.searchsorted(self.base[a:b], rank[mine], "right") - 1
        into = rank - self.base[at]
        return self.first[at] + into // self.each[at], self.offset[at] + into % self.each[at] * length


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PLACED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _placed(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
        sequence, offset = plan.value.place(length, rank)
        yield batch_of(PLACED_SCHEMA, *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], sequence, offset)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, tokenizer: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    pieces = stored(flat.mapInArrow(lambda batches: _pieces(batches, path, limit), PIECE))
    sizes = stored(pieces.groupBy("length", "block").count())
    counts = np.zeros(limit + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("count")).collect():  # at most `limit` rows
        counts[length] = n
    plan = docs.sparkSession.sparkContext.broadcast(Plan(solve(counts, limit, rounds), limit))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(before, ["length", "block"]).mapInArrow(lambda batches: _placed(batches, plan), PLACED)


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = None
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        encoder = encoder or Encoder(path)
        yield batch_of(schema, batch.column("doc_id"), [encoder.ids(t or b"") + END.to_bytes(4, "little") for t in buffers(batch.column("text"))])


def sequences(docs: DataFrame, placed: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """sequence_id and its ids (little-endian unsigned 32-bit) in order; ids of documents must be unique. One sequence is at most 16 KB."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    tokens = flat.mapInArrow(lambda batches: _tokens(batches, path), "doc_id long, ids binary")
    part = F.substring(F.col("ids"), F.col("start") * 4 + 1, F.col("length") * 4)
    parts = placed.join(tokens, "doc_id").select("sequence_id", F.struct("offset", part.alias("ids")).alias("part"))
    ordered = F.array_sort(F.collect_list("part"))
    return parts.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
