"""Repeated 200-byte strings, found by merging Burrows-Wheeler transforms of shards.

Sieve. Every LENGTH-byte window has an anchor: its KMER bytes of least hash, leftmost. Equal windows have equal anchors at equal
places, so a window can repeat only where its anchor does. Consecutive windows with one anchor form its context, at most REACH +
LENGTH bytes. Anchors go to shards by hash with a hash of their context. Anchors seen once are done; contexts seen twice repeat as a
whole; what is left, anchors with different contexts, is judged by the transforms. All rows take part in every step.

Transforms. The contexts of a batch are strings lined up at their anchors, blocks of one anchor together. The batch sorts them column by
column from the right and keeps what stands before each suffix: its shard of the transform, which is cut by anchor and sent to owner
tasks. An owner sees no text. It refines the interleave of its shards column by column: the symbols of the shards are read in merged
order and one stable pass by symbol gives the interleave of the next column, so no suffix is sorted again. Common prefixes of
neighbours follow from those of the column before by range minima; neighbours that share LENGTH bytes are repeated intervals.

An anchor with more than HOT different contexts would fill one owner: its windows are counted by a 64-bit hash instead, in shards that
any number of tasks share. Hashes of contexts are taken as equal texts at 64 bits.

Null text is empty. Texts under LENGTH bytes are never cut. Rows may repeat: copies of 200 bytes or more are removed from all of them.
Empty tables give empty results.
Other columns are not read, whatever their names. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, buffers, column, packed, query, stored, table, unpacked

LENGTH = 200
KMER = 48
REACH = LENGTH - KMER
WIDTH = REACH + LENGTH
BATCH_BYTES = 4 << 20
CHUNK = 1 << 20
SHARD_KEYS = 1 << 20
OWNER_ROWS = 1 << 15
HOT = 4096
ALL, SEND, WINDOWS = 1, 2, 4
BASE = np.uint64(0x5851F42D4C957F2D)
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, _inverse(int(BASE)), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX
    return (x ^ x >> np.uint64(29)) * MIX_2


POWERS: dict[int, tuple] = {}


def _chunk_anchors(data: np.ndarray, starts: np.ndarray):
    """Anchor, first and last window, key and context hash of each run of windows with one anchor. `starts`: the windows of `data`."""
    if WIDTH not in POWERS:
        POWERS[WIDTH] = _powers(CHUNK + WIDTH)
    up, down = POWERS[WIDTH]
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=sums[1:])
    kmers = _mixed((sums[KMER:] - sums[:-KMER]) * down[: data.size - KMER + 1])
    w = REACH + 1
    place = np.uint64((1 << 24) - 1)
    padded = np.full((-(-kmers.size // w) + 1) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: kmers.size] = kmers & ~place | np.arange(kmers.size, dtype=np.uint64)
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[starts], left[starts + w - 1]) & place).astype(np.int64)
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = starts[np.concatenate([[0], edge])], starts[np.concatenate([edge - 1, [starts.size - 1]])]
    at = anchor[np.concatenate([[0], edge])]
    context = (sums[last + LENGTH] - sums[first]) * down[first]
    context = _mixed(context + ((at - first) * 512 + (last - first)).astype(np.uint64) * MIX)
    return at, first, last, _mixed(kmers[at]), context  # least hashes are small ones; mixed anew they fill the shards evenly


def anchors(data: np.ndarray, lens: np.ndarray):
    """The same for texts of these lengths, one after another in `data`. Windows are taken CHUNK at a time; a run may be cut in two
    there, which changes no verdict."""
    ends = np.cumsum(lens)
    turn = np.zeros(data.size + 1, np.int32)
    long = lens >= LENGTH
    np.add.at(turn, (ends - lens)[long], 1)
    np.add.at(turn, (ends - LENGTH + 1)[long], -1)
    valid = np.cumsum(turn[:-1]) > 0
    parts = [[np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2]
    for start in range(0, data.size, CHUNK):
        starts = np.flatnonzero(valid[start : start + CHUNK])
        if starts.size:
            at, first, last, key, context = _chunk_anchors(data[start : start + CHUNK + LENGTH - 1], starts)
            parts.append([at + start, first + start, last + start, key, context])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


BATCH = "bid long, ids array<long>, lens array<long>, body binary, at binary, before binary, after binary, keys binary, contexts binary, n long"
BATCH_SCHEMA = pa.schema([
    ("bid", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("body", pa.binary()), ("at", pa.binary()), ("before", pa.binary()),
    ("after", pa.binary()), ("keys", pa.binary()), ("contexts", pa.binary()), ("n", pa.int64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts with their anchors in key order."""
    part, number = TaskContext.get().partitionId() << 28, 0
    ids, texts, size = [], [], 0
    def row():
        lens, body = np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts)
        found = anchors(np.frombuffer(body, np.uint8), lens)
        order = np.argsort(found[3], kind="stable")
        at, first, last, key, context = (x[order] for x in found)
        return batch_of(
            BATCH_SCHEMA, [part + number], [ids], [lens.tolist()], [zstandard.compress(body, 1)], [packed(at.astype(np.uint32))],
            [packed((at - first).astype(np.uint8))], [packed((last + LENGTH - at).astype(np.uint8))], [packed(np.diff(key, prepend=np.uint64(0)))],
            [packed(context)], [at.size])
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), buffers(batch.column("text")), strict=True):
            ids.append(doc_id), texts.append(text or b"")
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield row()
                number += 1
                ids, texts, size = [], [], 0
    if ids:
        yield row()


class Batch:
    """A stored batch, unpacked. Context i of a text's bytes is data[at - before : at + after]."""

    def __init__(self, row: dict):
        self.data = np.frombuffer(zstandard.decompress(row["body"]), np.uint8) if row["body"] else np.empty(0, np.uint8)
        self.lens = np.array(row["lens"], np.int64)
        self.at, self.before, self.after = (unpacked(row[c]).astype(np.int64) for c in ("at", "before", "after"))
        self.keys = np.cumsum(unpacked(row["keys"]), dtype=np.uint64)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Contexts as rows of WIDTH bytes with the anchors in one column; what lies outside a context is to be ignored."""
        place = self.at[which][:, None] + np.arange(-REACH, LENGTH)
        return self.data[np.clip(place, 0, self.data.size - 1)]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of these contexts: (place in `which`, first byte, hash)."""
        up, down = _powers(WIDTH)
        out = []
        for k in range(0, which.size, 4096):
            part = which[k : k + 4096]
            sums = np.zeros((part.size, WIDTH + 1), np.uint64)
            np.cumsum((self.rows(part).astype(np.uint64) + np.uint64(1)) * up[:WIDTH], axis=1, out=sums[:, 1:])
            hashes = _mixed((sums[:, LENGTH:] - sums[:, :-LENGTH]) * down[: REACH + 1])
            column = np.arange(REACH + 1)
            inside = (column >= REACH - self.before[part][:, None]) & (column + LENGTH <= REACH + self.after[part][:, None])
            row, col = np.nonzero(inside)
            out.append((row + k, self.at[part][row] + col - REACH, hashes[row, col]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))


def _slices(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard of sorted 64-bit keys begins, and the end."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [keys.size]]).astype(np.int64)


KEYED = "kind int, shard int, bid long, keys binary, a binary, b binary, c binary"
KEYED_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("bid", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
ANSWER = "kind int, shard int, bid long, answer binary, n long"
ANSWER_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("bid", pa.int64()), ("answer", pa.binary()), ("n", pa.int64())])
SIEVE, TRANSFORM, COUNT = 0, 1, 2


def _anchor_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for stored_batch in batches:
        for row in _slices(stored_batch):
            keys, contexts = np.cumsum(unpacked(row["keys"]), dtype=np.uint64), unpacked(row["contexts"])
            cut = _cut(keys, bits)
            for group in np.array_split(full := np.flatnonzero(np.diff(cut)), max(1, full.size // 64)):
                parts = [slice(cut[s], cut[s + 1]) for s in group]
                none = [None] * group.size
                yield batch_of(KEYED_SCHEMA, [SIEVE] * group.size, group.tolist(), [row["bid"]] * group.size,
                               [packed(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], [packed(contexts[p]) for p in parts], none, none)


def _sieved(group: pa.Table, hot: int) -> pa.Table:
    """For each anchor of a shard what its batch is to do: nothing (0), or ALL its windows repeat, SEND its context, or its WINDOWS."""
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in group["keys"].to_pylist()]
    sizes = [k.size for k in keys]
    key, context = np.concatenate(keys), np.concatenate([unpacked(x) for x in group["a"].to_pylist()])
    order = np.lexsort((context, key))
    key, context = key[order], context[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], context[1:] != context[:-1]])
    of_key, of_context = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    copies = np.bincount(of_context)[of_context]
    different = np.bincount(of_key, new)[of_key]
    say = np.where(copies > 1, ALL, 0) + np.where((different > 1) & new, SEND, 0) + np.where((different > max(1, hot)) & new, WINDOWS, 0)
    status = np.empty(key.size, np.uint8)
    status[order] = say
    ends = np.cumsum(sizes)
    sent = [int((status[e - n : e] & SEND > 0).sum()) for e, n in zip(ends, sizes, strict=True)]
    return pa.table([group["kind"], group["shard"], group["bid"], pa.array([packed(status[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary()), pa.array(sent, pa.int64())], schema=ANSWER_SCHEMA)


def shard_transform(rows: np.ndarray, block: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The transform of lined-up strings: per column, from the right, what stands before each suffix, in suffix order by block."""
    order, out = np.arange(block.size), np.zeros((WIDTH, block.size), np.uint8)
    for c in range(WIDTH - 1, -1, -1):
        symbol = np.where((c >= REACH - before[order]) & (c < REACH + after[order]), rows[order, c].astype(np.int64) + 1, 0)
        out[c] = np.maximum(symbol - 1, 0)
        order = order[np.argsort(block[order] * 257 + symbol, kind="stable")]
    return out


def merge_transforms(streams: np.ndarray, shard: np.ndarray, block: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Merge the shards' transforms: for each row and column of a window, does its LENGTH-byte window stand in another row too?

    `streams` has the shards' columns side by side, rows of a shard together; `shard` and `block` tell each row's shard and block, and
    rows of a shard are in block order."""
    n = block.size
    first = np.lexsort((shard, block))  # the interleave before any symbol is read: by block, then shard
    row, lane, now = first, shard[first].astype(np.uint16), block[first]
    common = np.zeros(n + 1, np.int16)  # common[t]: length that suffixes t - 1 and t of the merged order share
    hit = np.zeros((REACH + 1, n), bool)
    for c in range(WIDTH - 1, -1, -1):
        symbol = np.empty(n, np.int64)
        symbol[np.argsort(lane, kind="stable")] = streams[c]  # each shard's symbols, read in merged order
        symbol = np.where((c >= REACH - before[row]) & (c < REACH + after[row]), symbol + 1, 0)
        order = np.argsort(now * 257 + symbol, kind="stable")
        a, b = order[:-1], order[1:]
        alike = np.flatnonzero((symbol[a] == symbol[b]) & (symbol[b] > 0) & (now[a] == now[b]))
        shared = np.zeros(n + 1, np.int16)
        if alike.size:
            span = np.stack([a[alike] + 1, b[alike] + 1], axis=1).ravel()
            shared[alike + 1] = 1 + np.minimum.reduceat(common, span)[::2]
        row, lane, common = row[order], lane[order], shared
        if c <= REACH:
            t = np.flatnonzero(common >= LENGTH)
            hit[c, row[t]] = hit[c, row[t - 1]] = True
    return hit


def _second_rows(batches: Iterator[pa.RecordBatch], owner_bits: int, count_bits: int) -> Iterator[pa.RecordBatch]:
    """Shards of the transform, and hashes of the windows of anchors with too many contexts."""
    for joined in batches:
        for row in _slices(joined):
            b = Batch(row)
            status = np.concatenate([unpacked(p["answer"]) for p in sorted(row["parts"], key=lambda p: p["shard"])])
            sent = np.flatnonzero((status & SEND > 0) & (status & WINDOWS == 0))
            for k in range(0, sent.size, OWNER_ROWS):
                part = sent[k : k + OWNER_ROWS]
                block = np.unique(b.keys[part], return_inverse=True)[1]
                columns = shard_transform(b.rows(part), block, b.before[part], b.after[part])
                cut = _cut(b.keys[part], owner_bits)
                for s in np.flatnonzero(np.diff(cut)):
                    p = slice(cut[s], cut[s + 1])
                    facts = np.stack([b.before[part[p]], b.after[part[p]]]).astype(np.uint8)
                    yield batch_of(KEYED_SCHEMA, [TRANSFORM], [int(s)], [row["bid"]], [packed(np.diff(b.keys[part[p]], prepend=np.uint64(0)))],
                                   [zstandard.compress(columns[:, p].tobytes(), 1)], [packed(facts.ravel())], [packed(part[p].astype(np.uint32))])
            hashes, n = np.unique(b.windows(np.flatnonzero(status & WINDOWS > 0))[2], return_counts=True)
            cut = _cut(hashes, count_bits)
            for s in np.flatnonzero(np.diff(cut)):
                p = slice(cut[s], cut[s + 1])
                yield batch_of(KEYED_SCHEMA, [COUNT], [int(s)], [row["bid"]], [packed(np.diff(hashes[p], prepend=np.uint64(0)))],
                               [packed(np.minimum(n[p], 2).astype(np.uint8))], [None], [None])


def _second_answers(group: pa.Table) -> pa.Table:
    kind = group["kind"][0].as_py()
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in group["keys"].to_pylist()]
    sizes = [k.size for k in keys]
    ends = np.cumsum(sizes)
    if kind == COUNT:
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate([unpacked(x) for x in group["a"].to_pylist()]), every.size)
        answers = [packed((total[where[e - n : e]] > 1).astype(np.uint8)) for e, n in zip(ends, sizes, strict=True)]
    else:
        streams = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8).reshape(WIDTH, -1) for x in group["a"].to_pylist()], axis=1)
        before, after = np.concatenate([unpacked(x).reshape(2, -1) for x in group["b"].to_pylist()], axis=1).astype(np.int64)
        block = np.unique(np.concatenate(keys), return_inverse=True)[1]
        hit = merge_transforms(streams, np.repeat(np.arange(len(sizes)), sizes), block, before, after)
        answers = []
        for e, n, rows in zip(ends, sizes, group["c"].to_pylist(), strict=True):
            mine = np.packbits(hit[:, e - n : e].T, axis=1).tobytes()
            answers.append(zstandard.compress(unpacked(rows).astype(np.uint32).tobytes() + mine, 1))
    return pa.table([group["kind"], group["shard"], group["bid"], pa.array(answers, pa.binary()), pa.array(sizes, pa.int64())], schema=ANSWER_SCHEMA)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for joined in batches:
        for row in _slices(joined):
            b = Batch(row)
            status = np.concatenate([unpacked(p["answer"]) for p in sorted(row["parts"], key=lambda p: p["shard"])]) if row["parts"] else np.empty(0, np.uint8)
            whole = np.flatnonzero(status & ALL > 0)
            cover = np.zeros(b.data.size + 1, np.int32)
            np.add.at(cover, b.at[whole] - b.before[whole], 1)
            np.add.at(cover, b.at[whole] + b.after[whole], -1)
            single = []
            second = sorted(row["second"] or [], key=lambda p: (p["kind"], p["shard"]))
            for p in second:
                if p["kind"] == TRANSFORM:
                    answer = zstandard.decompress(p["answer"])
                    rows = np.frombuffer(answer[: 4 * p["n"]], np.uint32)
                    hit = np.unpackbits(np.frombuffer(answer[4 * p["n"] :], np.uint8).reshape(p["n"], -1), axis=1)[:, : REACH + 1]
                    which, col = np.nonzero(hit)
                    single.append(b.at[rows[which]] + col - REACH)
            counted = [unpacked(p["answer"]) for p in second if p["kind"] == COUNT]
            if counted:
                _, first, hashes = b.windows(np.flatnonzero(status & WINDOWS > 0))
                twice = np.concatenate(counted)[np.unique(hashes, return_inverse=True)[1]]
                single.append(first[twice > 0])
            if single:
                first = np.unique(np.concatenate(single))
                cover += np.bincount(first, minlength=cover.size).astype(np.int32) - np.bincount(first + LENGTH, minlength=cover.size).astype(np.int32)[: cover.size]
            gone = np.cumsum(cover[:-1]) > 0
            ends = np.cumsum(b.lens)
            out = []
            for doc_id, e, n in zip(row["ids"], ends.tolist(), b.lens.tolist(), strict=True):
                mine = gone[e - n : e]
                kept = b.data[e - n : e][~mine].tobytes()
                spans = int(mine[:1].sum()) + int((mine[1:] & ~mine[:-1]).sum())
                out.append((doc_id, n, int(mine.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield batch_of(RESULT_SCHEMA, *zip(*out, strict=True))


def _bits(n: int, size: int) -> int:
    return max(0, -(-n // size) - 1).bit_length()


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row."""
    flat = docs.select(column(docs, doc_id, "long").alias("id"), column(docs, text, "string").alias("text"))
    batches = stored(flat.mapInArrow(_batches, BATCH))
    n = int(batches.agg(F.sum("n")).first()[0] or 0)
    bits = _bits(n, SHARD_KEYS)
    sieved = stored(batches.select("bid", "keys", "contexts").mapInArrow(lambda b: _anchor_rows(b, bits), KEYED).groupBy("kind", "shard").applyInArrow(lambda g: _sieved(g, hot), ANSWER))
    sent = int(sieved.agg(F.sum("n")).first()[0] or 0)
    parts = sieved.groupBy("bid").agg(F.collect_list(F.struct("shard", "answer")).alias("parts"))  # the batch's own anchors
    owner_bits, count_bits = _bits(sent, OWNER_ROWS), _bits(sent * LENGTH // 2, 4 * SHARD_KEYS)
    texts = batches.drop("contexts", "n")
    wanted = sieved.filter("n > 0").select("bid").distinct()
    second = texts.join(wanted, "bid").join(parts, "bid").mapInArrow(lambda b: _second_rows(b, owner_bits, count_bits), KEYED)
    answers = stored(second.groupBy("kind", "shard").applyInArrow(_second_answers, ANSWER))
    masks = answers.groupBy("bid").agg(F.collect_list(F.struct("kind", "shard", "answer", "n")).alias("second"))
    done = texts.join(parts, "bid", "left").join(masks, "bid", "left").mapInArrow(lambda b: _removed(b, with_text), RESULT)
    return done if with_text else done.drop("kept")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
