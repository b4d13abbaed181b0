import hashlib
import random
import zlib

import pytest

from plumbline.llm import conversation_trie as c

KIND = "conv_id long, turn long, role string, text string, `node` string, `depth` int"


def brute(rows):
    own = {}
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:".encode() + (role + text).encode()).digest()[:16]
    for i, turn, role, text in rows:
        if i is not None:
            role, text = role or "", text or ""
            own.setdefault(i, []).append(((turn is not None, turn or 0, role, digest(role, text)), (role, text)))
    own = {i: [t for _, t in sorted(ts)] for i, ts in own.items()}
    rebuilt = {}
    for i in own:
        h = zlib.crc32(str(i).encode()) % 9
        family = i - (abs(i) % 5) * (1 if i > 0 else -1)
        rebuilt[i] = own.get(family, [])[:h] + own[i][h:]
    nodes = {}
    for i, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(i)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    ends = lambda path: ",".join(map(str, sorted(i for i in nodes[path] if len(rebuilt[i]) == len(path))))
    return sorted((min(m), len(path), min(nodes[path[:-1]]) if path else None, len(m), len(kids.get(path, [])), leaves[path], saved[path],
                   hashlib.sha256(ends(path).encode()).hexdigest()) for path, m in nodes.items())


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def made(seed, convs, hot=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(-7, convs):
        if rnd.random() < 0.1:
            continue
        n = rnd.choice([1, 2, 3, 4, 9, 12])
        rows += [(i, rnd.choice([None, t, t]), rnd.choice(["user", "assistant", None]), rnd.choice(["é", "b", "same", None, ""]), "x", 1) for t in range(n)]
    long = [(f"turn {t}") for t in range(hot)]
    for i in (15, 16, 1000, 1001, 1002) if hot else ():
        rows = [r for r in rows if r[0] != i] + [(i, t, "user", text, "x", 1) for t, text in enumerate(long)]
    return rows + [(None, 1, "user", "no conversation", "x", 1)]


def test_nodes_are_those_of_brute_force(spark):
    rows = made(1, 120) + [(5000 + 5 * k, t, "user", "a common start" if t < 3 else f"{k}", "x", 1) for k in range(40) for t in range(4)]
    docs = spark.createDataFrame(rows, KIND)
    wanted = brute([r[:4] for r in rows])
    assert found(c.trie(docs)) == wanted
    # few heavy nodes allowed, a queue that spills at once, chunks of a few ids
    assert found(c.trie(docs.repartition(5), heavy=3, limit=2, size=50)) == wanted


@pytest.mark.parametrize("parts", ["1", "13", "40"])
def test_a_conversation_may_span_many_ranges(spark, parts):
    rows = made(2, 30, hot=300)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(c.trie(spark.createDataFrame(rows, KIND), heavy=50)) == brute([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_small(spark):
    none = spark.createDataFrame([], KIND)
    assert c.trie(none).count() == 0
    assert c.trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], KIND)).count() == 0
    one = [(1, None, None, None, "", 1)]
    assert found(c.trie(spark.createDataFrame(one, KIND))) == brute([r[:4] for r in one])


def test_heavy_nodes_are_few(spark):
    rows = [(i, t, "user", "same" if t < 5 else str(i), "", 1) for i in range(0, 400, 5) for t in range(8)]
    turns = c.sorted_turns(spark.createDataFrame(rows, KIND))
    begins, bound = c.carried(turns)
    total = c.members(turns, begins).filter("NOT ends").count()
    assert total <= bound


def test_queue_spills_and_keeps_order():
    rnd, queue = random.Random(4), c.SpillingQueue(10)
    sent = [((-rnd.randint(0, 9), bytes([rnd.randint(0, 3)])), 1, k) for k in range(500)]
    for m in sent:
        queue.push(m)
    assert queue.spilled > 20
    for key in sorted({m[0] for m in sent}):
        assert sorted(queue.pop_all(key)) == sorted(m for m in sent if m[0] == key)


def test_polynomials_concatenate():
    rnd = random.Random(5)
    values = [rnd.getrandbits(126) for _ in range(40)]
    for cut in (0, 1, 17, 40):
        a, b = (c.Run(0, 0, len(v), c.extended(0, v), tuple((x, 1) for x in v[:8])) for v in (values[:cut], values[cut:]))
        whole = a.then(b)
        assert (whole.n, whole.poly, whole.first) == (40, c.extended(0, values), tuple((x, 1) for x in values[:8]))
