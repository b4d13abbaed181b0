"""Conversation prefix trie: conversations rebuilt from a shared donor, merged into a trie, subtree totals by time-forward processing.

Rebuilding. Turns are sorted once by (family, donor first, conversation, turn) into ranges, so any conversation may span several ranges. A
range's summary is its first and last runs of one conversation (count, polynomial of its turns, its first eight turns) and the donor of
the last; folding three runs a range gives each range the state it begins with. Polynomials modulo 2**127 - 1 over turn digests of
126 bits name every prefix; they concatenate, which is why a conversation of any length need not stay in one task.

Trie. A node is (depth, polynomial); its members are counted before the shuffle, so the root or a common first turn is one row a task.

Totals. A node is heavy if more than C conversations pass it, where C is chosen from the rows so that there are at most HEAVY such
nodes whatever the size of the input. Below them hang light subtrees of at most C conversations: the shards. Within a shard nodes are sorted
externally by reverse level order, and each sends its totals forward to its parent through a priority queue that spills sorted runs beyond
a bound. The shard roots' totals are added up per heavy parent and sent through the same processing over the heavy nodes.

A null conv_id is no conversation. Null roles and texts are empty. Turns that are equal in (turn, role) are ordered by the digest of role and text, so
repeated rows are repeated turns. An empty table gives no nodes. Very long texts are only digested; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, checkpointed, column, query, stored, table

PRIME = (1 << 127) - 1
BASE = 0x5B2D9E3F17C46A8801F3C5D7E9ABCDEF
FIRST = 8
HEAVY = 20_000
HOT = 1_000
QUEUE = 200_000
CHUNK = 1 << 20
ROWS = 10_000
ROOT = bytes(16)
FAMILY = 5
NOTHING = hashlib.sha256().hexdigest()


# Sorted turns

def sorted_turns(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """family, conv, digest, n_bytes in the order in which conversations are rebuilt; ranges of it are the partitions."""
    flat = convs.select(column(convs, conv_id, "long").alias("conv"), column(convs, turn, "long").alias("turn"),
                        *[F.coalesce(column(convs, c, "string"), F.lit("")).alias(to) for c, to in ((role, "role"), (text, "text"))]).filter("conv IS NOT NULL")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    family = F.col("conv") - F.col("conv") % FAMILY
    lined = flat.select(family.alias("family"), (F.col("conv") != family).alias("late"), "conv", "turn", "role", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    order = ["family", "late", "conv", "turn", "role", "digest"]
    return checkpointed(lined.repartitionByRange(*order).sortWithinPartitions(*order).select("family", "conv", "digest", "n_bytes"))


class Run(NamedTuple):
    """Consecutive turns of one conversation: how many, their polynomial, and the first eight as (value, bytes)."""

    family: int
    conv: int
    n: int
    poly: int
    first: tuple

    def then(self, later: Run) -> Run:
        return Run(self.family, self.conv, self.n + later.n, (self.poly * pow(BASE, later.n, PRIME) + later.poly) % PRIME, (self.first + later.first)[:FIRST])


def value(digest: bytes) -> int:
    return (int.from_bytes(digest, "big") >> 2) + 1


def extended(poly: int, values) -> int:
    for v in values:
        poly = (poly * BASE + v) % PRIME
    return poly


class State(NamedTuple):
    """The conversation under way and the donor of its family, if that exists."""

    donor: Run | None = None
    run: Run | None = None

    def after(self, run: Run) -> State:
        if self.run and self.run.conv == run.conv:
            return State(self.donor, self.run.then(run))
        donor = next((r for r in (self.run, self.donor) if r and r.conv == run.family), None)
        return State(donor, run)


def _turns(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("family", "conv", "digest", "n_bytes")], strict=True)


SUMMARY = pa.schema([("pid", pa.int64()), ("n", pa.int64()), ("convs", pa.int64()), ("runs", pa.binary())])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a partition that later partitions may need: the first, the last, and the donor of the last."""
    lead, donor, now, n, convs = None, None, None, 0, 0
    for family, conv, digest, n_bytes in _turns(batches):
        n += 1
        v = value(digest)
        if now and now[1] == conv:
            now[2] += 1
            now[3] = (now[3] * BASE + v) % PRIME
            if len(now[4]) < FIRST:
                now[4].append((v, n_bytes))
            continue
        if now:
            lead = lead or now
            if now[1] == now[0]:
                donor = now
        now, convs = [family, conv, 1, v, [(v, n_bytes)]], convs + 1
    if now:
        keep = [x for x in (lead, donor if donor is not lead and donor and donor[1] == now[0] else None, now) if x]
        yield batch_of(SUMMARY, [TaskContext.get().partitionId()], [n], [convs], [pickle.dumps([Run(*x[:4], tuple(x[4])) for x in keep])])


def carried(turns: DataFrame) -> tuple[dict[int, tuple[State, bool]], int]:
    """For each partition the state it begins with and whether its last conversation goes on in a later one; at most three runs a partition
    are folded here. Also a bound on the rebuilt rows."""
    told = sorted(turns.mapInArrow(_summary, "pid long, n long, convs long, runs binary").collect(), key=lambda r: r.pid)
    state, begins, bound, before = State(), {}, 0, None
    for r in told:
        runs = pickle.loads(r.runs)
        if before is not None:
            begins[before] = (begins[before][0], state.run.conv == runs[0].conv)
        begins[r.pid], before = (state, False), r.pid
        for run in runs:
            state = state.after(run)
        bound += r.n + (FIRST + 1) * r.convs
    return begins, bound


# Rebuilt rows

MEMBER = "depth long, node binary, parent binary, conv long, n_bytes long, ends boolean"
MEMBERS = pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv", pa.int64()), ("n_bytes", pa.int64()), ("ends", pa.bool_())])


def shared_turns(conv: int) -> int:
    """How many turns a conversation takes from its donor."""
    return zlib.crc32(str(conv).encode()) % 9


class Rebuilt:
    """Rows of one conversation as its own turns arrive."""

    def __init__(self, state: State, out: list, fresh: bool):
        self.run, self.out = state.run, out
        own = self.run.conv == self.run.family
        self.h = 0 if own else shared_turns(self.run.conv)
        self.depth, self.poly = 0, 0
        if fresh:
            out.append((0, ROOT, None, self.run.conv, 0, False))
        for v, n_bytes in state.donor.first[: self.h] if state.donor and not own else ():
            self.add(v, n_bytes, fresh)

    def add(self, v: int, n_bytes: int, tell: bool = True) -> None:
        above, self.poly, self.depth = self.poly, (self.poly * BASE + v) % PRIME, self.depth + 1
        if tell:
            self.out.append((self.depth, self.poly.to_bytes(16, "big"), above.to_bytes(16, "big"), self.run.conv, n_bytes, False))

    def resume(self) -> Rebuilt:
        """Past the own turns that earlier partitions hold: all of them less the skipped ones, as polynomials."""
        past = max(0, self.run.n - self.h)
        skipped = extended(0, [v for v, _ in self.run.first[: self.h]][: self.run.n])
        shift = pow(BASE, past, PRIME)
        self.poly = (self.poly * shift + self.run.poly - (skipped * shift if past else self.run.poly)) % PRIME
        self.depth += past
        self.seen = self.run.n
        return self

    seen = 0

    def own(self, v: int, n_bytes: int) -> None:
        self.seen += 1
        if self.seen > self.h:
            self.add(v, n_bytes)

    def close(self) -> None:
        self.out.append((self.depth, self.poly.to_bytes(16, "big") if self.depth else ROOT, None, self.run.conv, 0, True))


def _members(batches: Iterator[pa.RecordBatch], begins) -> Iterator[pa.RecordBatch]:
    state, goes_on = begins.value.get(TaskContext.get().partitionId(), (State(), False))
    out: list[tuple] = []
    going = Rebuilt(state, out, False).resume() if state.run else None
    met = False
    for family, conv, digest, n_bytes in _turns(batches):
        v = value(digest)
        if not state.run or state.run.conv != conv:
            if going and met:
                going.close()
            if len(out) >= ROWS:
                yield batch_of(MEMBERS, *zip(*out, strict=True))
                out.clear()
            state = state.after(Run(family, conv, 0, 0, ()))
            going = Rebuilt(state, out, True)
        met = True
        going.own(v, n_bytes)
        if conv == family and len(state.run.first) < FIRST:
            state = State(state.donor, state.run._replace(first=(*state.run.first, (v, n_bytes))))
        if len(out) >= 4 * ROWS:
            yield batch_of(MEMBERS, *zip(*out, strict=True))
            out.clear()
    if going and met and not goes_on:
        going.close()
    if out:
        yield batch_of(MEMBERS, *zip(*out, strict=True))


def members(turns: DataFrame, begins: dict) -> DataFrame:
    """One row per rebuilt conversation and node on its path, and one that ends it (ends true)."""
    told = turns.sparkSession.sparkContext.broadcast(begins)
    return turns.mapInArrow(lambda b: _members(b, told), MEMBER)


# Totals

class SpillingQueue:
    """A priority queue of messages (key, ...) that keeps at most `limit` in memory and the rest in sorted runs of the task's own files."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.heads, self.spilled = limit, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()  # nameless and read by this task alone
            for m in sorted(self.heap):
                pickle.dump(m, run)
            run.seek(0)
            self.heap = []
            self.spilled += 1
            self._next(run)

    def _next(self, run) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def pop_all(self, key) -> Iterator[tuple]:
        """Messages to `key`; all smaller keys have been popped before."""
        while True:
            if self.heads and self.heads[0][0][0] == key:
                message, _, run = heapq.heappop(self.heads)
                self._next(run)
                yield message
            elif self.heap and self.heap[0][0] == key:
                yield heapq.heappop(self.heap)
            else:
                return


TOTAL = "depth long, node binary, parent binary, conv long, n_convs long, top boolean, n_children long, n_leaves long, saved long"
TOTALS = pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv", pa.int64()), ("n_convs", pa.int64()), ("top", pa.bool_()),
                    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64())])


def _time_forward(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Nodes in reverse level order; those below have sent their totals when a node's turn comes."""
    queue = SpillingQueue(limit)
    names = ("depth", "node", "parent", "conv", "n_convs", "top", "n_children", "n_leaves", "saved")
    for batch in batches:
        out = []
        for depth, node, parent, conv, n_convs, top, children, leaves, saved in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            for _, below, worth in queue.pop_all((-depth, node)):
                children, leaves, saved = children + 1, leaves + below, saved + worth
            leaves = leaves or 1
            out.append((depth, node, parent, conv, n_convs, top, children, leaves, saved))
            if not top:
                queue.push(((1 - depth, parent), leaves, saved))
        if out:
            yield batch_of(TOTALS, *zip(*out, strict=True))


def time_forward(nodes: DataFrame, limit: int = QUEUE) -> DataFrame:
    """Totals of each partition's nodes: children, leaves and saved are what they have already, `top` nodes send nothing."""
    lined = nodes.sortWithinPartitions(F.desc("depth"), "node")
    return lined.mapInArrow(lambda b: _time_forward(b, limit), TOTAL)


def joined_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left join right (unique in `on`), where `weight` bounds the left rows of a key: the HOT heaviest keys are broadcast, so that no
    other key holds more than 1/HOT of the weight."""
    hot = stored(right.orderBy(F.desc(weight), *on).limit(HOT).drop(weight))
    right = right.drop(weight)
    near = left.join(F.broadcast(hot), on)
    return near.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on, how).select(near.columns))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of a node's sorted conversations as comma-joined text of about `size` bytes."""
    schema = pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("conv", pa.int64()), ("ids", pa.binary())])
    out, key, held, total = [], None, [], 0
    for batch in batches:
        for depth, node, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "node", "conv")], strict=True):
            if held and ((depth, node) != key or total > size):
                out.append((*key, held[0], ",".join(map(str, held)).encode()))
                held, total = [], 0
            key = (depth, node)
            held.append(conv)
            total += 20
        if len(out) >= ROWS or sum(len(o[3]) for o in out) > size:
            yield batch_of(schema, *zip(*out, strict=True))
            out = []
    if held:
        out.append((*key, held[0], ",".join(map(str, held)).encode()))
    if out:
        yield batch_of(schema, *zip(*out, strict=True))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("sha", pa.string())])
    out, key, state = [], None, None
    for batch in batches:
        for depth, node, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "node", "ids")], strict=True):
            if (depth, node) == key:
                state.update(b",")
                state.update(ids)
                continue
            if key:
                out.append((*key, state.hexdigest()))
            key, state = (depth, node), hashlib.sha256(ids)
        if len(out) >= ROWS:
            yield batch_of(schema, *zip(*out, strict=True))
            out = []
    if key:
        out.append((*key, state.hexdigest()))
        yield batch_of(schema, *zip(*out, strict=True))


def end_hashes(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """depth, node, sha of the conversations that end there; a node's ids are sorted and joined in ranges, then hashed a chunk at a time."""
    ends = rows.filter("ends").select("depth", "node", "conv")
    chunks = ends.repartitionByRange("depth", "node", "conv").sortWithinPartitions("depth", "node", "conv").mapInArrow(lambda b: _chunks(b, size), "depth long, node binary, conv long, ids binary")
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv").mapInArrow(_hashes, "depth long, node binary, sha string")


def trie(convs: DataFrame, heavy: int = HEAVY, limit: int = QUEUE, size: int = CHUNK, **names) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = sorted_turns(convs, **names)
    begins, bound = carried(turns)
    rows = stored(members(turns, begins))
    counted = F.count(F.when(~F.col("ends"), 1)).alias("n_convs")
    nodes = stored(rows.groupBy("depth", "node").agg(counted, F.min("conv").alias("conv"), F.min("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")))
    most = max(1, -(-bound // heavy))
    above = nodes.filter(F.col("n_convs") > most)  # at most `heavy` rows: each stands for more than bound / heavy rebuilt rows
    light_rows = rows.filter("NOT ends").join(F.broadcast(above.select("depth", "node")), ["depth", "node"], "left_anti")
    tops = light_rows.groupBy("conv").agg(F.min(F.struct("depth", "node")).alias("shard"), F.count(F.lit(1)).alias("path"))
    zero = F.lit(0).cast("long")
    facts = ["depth", "node", "parent", "conv", "n_convs", "top", "n_children", "n_leaves", "saved"]
    below = nodes.filter(F.col("n_convs") <= most)
    sharded = joined_hot(below, stored(tops), ["conv"], "path").withColumn("top", F.col("depth") == F.col("shard.depth")).withColumn("n_children", zero).withColumn("n_leaves", zero)
    light = stored(time_forward(sharded.repartition("shard").select(facts), limit))
    sent = light.filter("top AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("more"))
    upper = above.join(sent, ["depth", "node"], "left").select(
        "depth", "node", "parent", "conv", "n_convs", (F.col("depth") == 0).alias("top"), F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", zero).alias("n_leaves"), (F.col("saved") + F.coalesce("more", zero)).alias("saved"))
    every = stored(light.unionByName(time_forward(upper.repartition(1), limit)))  # the heavy nodes are at most `heavy`
    parents = every.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    named = joined_hot(every, parents.withColumnRenamed("n_children", "weight"), ["depth", "parent"], "weight", "left")
    return named.join(end_hashes(rows, size), ["depth", "node"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))


@query("op12_conversation_prefix_trie", """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, r) AS (
  SELECT DISTINCT c, c::VARCHAR, 0, 4294967295::BIGINT FROM t
  UNION ALL
  SELECT c, s, i + 1, list_reduce([xor(r, ascii(substr(s, i + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) FROM crc WHERE i < length(s)),
ids AS (SELECT c, c - c % 5 AS donor, xor(r, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = length(s)),
size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS (SELECT ids.c, t.i AS d, role, txt FROM ids JOIN t ON t.c = ids.donor AND t.i <= h
      UNION ALL
      SELECT ids.c, least(h, coalesce(n, 0)) + i - h, role, txt FROM ids JOIN t ON t.c = ids.c AND t.i > h LEFT JOIN size ON size.c = ids.donor
      UNION ALL SELECT c, 0, NULL, NULL FROM ids),
k AS (SELECT c, d, coalesce(strlen(txt), 0) AS b,
             sha256(coalesce(string_agg(sha256(strlen(role)::VARCHAR || ':' || role || txt), ',') OVER (PARTITION BY c ORDER BY d), '')) AS path FROM r),
node AS (SELECT d, path, min(c) AS conv, count(*) AS n, max(b) AS b FROM k GROUP BY d, path),
m AS (SELECT k.c, k.d, k.path, conv, n, lag(conv) OVER w AS parent, lag(k.path) OVER w AS above, k.d = max(k.d) OVER (PARTITION BY k.c) AS ends,
             CASE WHEN conv = k.c THEN (n - 1) * node.b ELSE 0 END AS v
      FROM k JOIN node ON k.d = node.d AND k.path = node.path WINDOW w AS (PARTITION BY k.c ORDER BY k.d)),
kids AS (SELECT d - 1 AS d, above AS path, count(DISTINCT path) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
leaf AS (SELECT m.c, m.path AS leaf FROM m LEFT JOIN kids ON m.d = kids.d AND m.path = kids.path WHERE ends AND kids.path IS NULL),
s AS (SELECT m.*, leaf.leaf, sum(v) OVER (PARTITION BY m.c ORDER BY m.d DESC) AS below FROM m LEFT JOIN leaf ON m.c = leaf.c),
g AS (SELECT d, path, min(conv) AS conv_id, min(parent) AS parent_conv_id, min(n) AS n_convs, count(DISTINCT leaf) AS n_leaves, sum(below)::BIGINT AS saved_tokens,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
      FROM s GROUP BY d, path)
SELECT conv_id, g.d::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM g LEFT JOIN kids ON g.d = kids.d AND g.path = kids.path""")
def op12_conversation_prefix_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))
