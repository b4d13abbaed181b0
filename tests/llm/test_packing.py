import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a\tb  c\r\nd", "don't it's I'M we'LL", "x1y2 3.5 ½", "É é e\u0301 \u0301x", "ß İ ı ﬁ ª", "<|endoftext|> a<|startoftext|>b", "日本語", "...!? -- x,y", "a\x1fb\x85c\u00a0d", "naïve,ÀB. 😀x"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(plain, prose):
    encoder = p.Encoder(PATH)
    for text in [*ODD, prose(1, 300), prose(2, 300).upper()]:
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pieces_sequences_and_round_trip(spark, plain, awkward, nothing):
    rows = [(i, r.text) for i, r in enumerate(awkward.collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = p.pack(docs, rounds=40).collect()
    ids = {i: [*(plain.encode(t, add_special_tokens=False).ids if t else []), 1] for i, t in rows}
    held = {}
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == min(4096, len(ids[r.doc_id]) - r.start) == len(part)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, part))
    assert sorted((r.doc_id, r.piece) for r in found) == sorted((i, k) for i, x in ids.items() for k in range(-(-len(x) // 4096)))
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(map(len, ids.values())) // 4096) + 1
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in p.sequences(docs, p.pack(docs, rounds=40)).collect()}
    assert whole == {s: [x for _, _, part in sorted(parts) for x in part] for s, parts in held.items()}
    assert p.pack(nothing).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plans_hold_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65)
    plan = p.solve(counts, 64, 30)
    held = np.zeros(65, np.int64)
    for config, n in plan:
        assert sum(a * m for a, m in config) <= 64 and n > 0
        for a, m in config:
            held[a] += m * n
    assert (held == counts).all()
    placed = p.Plan(plan, 64)
    order = np.repeat(np.arange(65), counts)
    rank = np.concatenate([np.arange(c) for c in counts]).astype(np.int64)
    sequence, offset = placed.place(order, rank)
    spans = sorted(zip(sequence.tolist(), offset.tolist(), (offset + order).tolist(), strict=True))
    assert all(b[1] == (a[2] if a[0] == b[0] else 0) for a, b in zip(spans, spans[1:], strict=False))


def test_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6.4, 1.1, 50_000).astype(int)))
    used = sum(n for _, n in p.solve(np.bincount(lengths, minlength=4097), rounds=60))
    assert used <= 1.001 * (lengths.sum() / 4096) + 2
    assert sum(n for _, n in p.solve(np.bincount([3000] * 9000, minlength=4097), rounds=10)) == 9000


def test_pricing_is_the_best_knapsack():
    rng = np.random.default_rng(4)
    prices = np.zeros(31)
    prices[rng.choice(np.arange(1, 31), 8, replace=False)] = rng.random(8)
    best = [0.0] * 31
    for room in range(1, 31):
        best[room] = max([best[room - 1], *[best[room - a] + prices[a] for a in range(1, room + 1)]])
    config = p.best_configuration(prices, 30)
    assert sum(a * m for a, m in config.items()) <= 30 and abs(sum(prices[a] * m for a, m in config.items()) - best[30]) < 1e-12
