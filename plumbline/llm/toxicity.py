"""Toxicity scores from a classifier whose score may not move when identity terms are swapped.

Features are hashed byte n-grams of letters, from word starts and anywhere. Over all labelled training rows (equal texts count once) the grams of toxic rows are counted
by row, and those grams again over the clean rows; of the grams at least RATIO times as common in toxic rows, the FEATURES that
tell most become the features. Since only grams in at
least LEAST_SHARE of the toxic rows are looked at, what reaches the driver is bounded by the grams of a row over that share, not by
the rows. Logistic weights are fitted on at most SAMPLE_ROWS labelled rows (least hash of the id first). Where such a row names a
group, copies with the term swapped for others of its list are made, and the squared change of the score is part of the loss with
weight PENALTY, so neutral mentions of a group gain nothing.

Null text counts as empty and is scored like any text. Labels of unknown ids, null labels and null ids teach nothing; repeated labels
count as toxic if any is. Nothing learned: the share of toxic rows, 0 without any. Empty tables give empty results.
Other columns are not read, whatever their names. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, column, query, table
from plumbline.llm.grams import LETTERS, MIX, added, fold, joined, labelled, slices, windows

FROM_START = (5, 6, 7, 8)
ANYWHERE = 5
LEAST_SHARE = 0.002
FEATURES = 4096
RATIO = 8
SAMPLE_ROWS = 20_000
SWAPS = 3
PENALTY = 1.0
RIDGE = 2e-5
STEPS = 600
TABLE_BITS = 20
HELD = 2_000_000
#: Terms of one list may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "foreigners", "natives"), ("old", "young", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten"), ("schwarze", "weiße", "asiaten", "ausländer"),
    ("schwule", "lesben", "heteros"), ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("noirs", "blancs", "asiatiques", "étrangers"), ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("negros", "blancos", "asiáticos", "extranjeros"),
)
LISTS = [tuple(t.encode() for t in terms) for terms in IDENTITY]
PLACE = {t: (k, i) for k, terms in enumerate(LISTS) for i, t in enumerate(terms)}
TERM = re.compile(b"(?<= )(?:" + b"|".join(sorted(map(re.escape, PLACE), key=len, reverse=True)) + b")(?= )")


def swapped(text: bytes, by: int) -> bytes | None:
    """The text's letters with every identity term replaced by the one `by` places on in its list; None if it has no term."""
    letters = b" " + text.translate(LETTERS) + b" "
    def other(found):
        k, i = PLACE[found.group()]
        return LISTS[k][(i + by) % len(LISTS[k])]
    out, n = TERM.subn(other, letters)
    return out if n else None


COUNTED = pa.schema([("gram", pa.int64()), ("n", pa.int64())])


def coded(data: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and 40-bit codes of the grams: the first bytes of words, with the space before, and ANYWHERE bytes at any letter."""
    begins = np.flatnonzero((data[:most] == 32) & (data[1 : most + 1] != 32))
    for n in FROM_START:
        yield begins, _code(windows(data, 8)[begins] & np.uint64((1 << 8 * n) - 1), n)
    inside = np.flatnonzero(data[:most] != 32)
    yield inside, _code(windows(data, ANYWHERE)[inside], 0)


def _code(grams: np.ndarray, n: int) -> np.ndarray:
    return (((grams ^ grams >> np.uint64(29)) + np.uint64(n + 1)) * MIX) >> np.uint64(24)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each gram stands, added up over the task as long as they fit."""
    parts = []
    for batch in batches:
        for _, texts in slices(batch):
            data, begins = joined(texts)
            owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(begins))
            pairs = np.concatenate([codes << np.uint64(24) | owner[at] for at, codes in coded(data, owner.size)])
            pairs.sort()
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: pairs.size]] >> np.uint64(24)
            edges = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[: pairs.size])
            parts.append((pairs[edges].astype(np.int64), np.diff(np.append(edges, pairs.size))))
            if sum(p[0].size for p in parts) > HELD:
                parts = [added(parts)]
                if parts[0][0].size > HELD // 2:
                    yield batch_of(COUNTED, *parts.pop())
    if parts:
        yield batch_of(COUNTED, *added(parts))


class Grams:
    """Known grams; finds which stand in each text."""

    def __init__(self, grams: np.ndarray):
        self.order = np.argsort(grams)
        self.known = grams[self.order].astype(np.uint64)
        self.size = grams.size
        self.quick = np.zeros(1 << TABLE_BITS, bool)
        self.quick[self.known >> np.uint64(40 - TABLE_BITS)] = True

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) pairs, each once."""
        if not self.size or not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        data, begins = joined(texts)
        pairs = []
        for at, codes in coded(data, int(begins[-1])):
            may = np.flatnonzero(self.quick[codes >> np.uint64(40 - TABLE_BITS)])
            codes = codes[may]
            place = np.minimum(np.searchsorted(self.known, codes), self.size - 1)
            sure = self.known[place] == codes
            pairs.append((np.searchsorted(begins, at[may[sure]], "right") - 1) * self.size + self.order[place[sure]])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // self.size, pairs % self.size


def _known_rows(batches: Iterator[pa.RecordBatch], grams) -> Iterator[pa.RecordBatch]:
    """In how many texts each known gram stands, added up over the task."""
    total = np.zeros(grams.value.size, np.int64)
    for batch in batches:
        for _, texts in slices(batch):
            total += np.bincount(grams.value.found(texts)[1], minlength=total.size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


SAMPLE = "y int, features array<int>, swaps array<array<int>>"
SAMPLE_SCHEMA = pa.schema([("y", pa.int32()), ("features", pa.list_(pa.int32())), ("swaps", pa.list_(pa.list_(pa.int32())))])


def _examples(batches: Iterator[pa.RecordBatch], grams) -> Iterator[pa.RecordBatch]:
    """Features of each row and of its copies with identity terms swapped."""
    def features(texts):
        rows, which = grams.value.found(texts)
        return [x.tolist() for x in np.split(which, np.searchsorted(rows, np.arange(1, len(texts))))] if texts else []
    for batch in batches:
        ys = batch.column("y").to_pylist()
        for first, texts in slices(batch):
            copies = [[c for by in range(1, SWAPS + 1) if (c := swapped(t, by)) is not None] for t in texts]
            yield batch_of(SAMPLE_SCHEMA, [int(y > 0) for y in ys[first : first + len(texts)]], features(texts), [features(c) for c in copies])


def fit(y: np.ndarray, rows: list, swaps: list, size: int) -> np.ndarray:
    """Weights and, last, the bias: balanced logistic loss, ridge, and PENALTY times the mean squared change of score under swaps."""
    def matrix(lists):
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.repeat(np.arange(len(lists)), n), np.fromiter((x for r in lists for x in r), np.int64, int(n.sum()))
    at, which = matrix(rows)
    origin = np.array([i for i, s in enumerate(swaps) for _ in s], np.int64)
    copy_at, copy_which = matrix([c for s in swaps for c in s])
    share = max(1e-9, float(y.mean()))
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share)) / y.size
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[which], y.size) + w[-1]
        slope = weight * (1 / (1 + np.exp(-z)) - y)
        if origin.size:
            change = np.bincount(copy_at, w[copy_which], origin.size) + w[-1] - z[origin]
            pull = 2 * PENALTY * change / origin.size
            slope = slope - np.bincount(origin, pull, y.size)
        g = np.bincount(which, slope[at], size + 1) + 2 * RIDGE * w
        g[-1] = slope.sum()
        if origin.size:
            g += np.bincount(copy_which, pull[copy_at], size + 1)
            g[-1] += pull.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


class Model:
    def __init__(self, grams: Grams, weights: np.ndarray):
        self.grams, self.weights = grams, weights

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, which = self.grams.found(texts)
        return 1 / (1 + np.exp(-np.bincount(rows, self.weights[which], len(texts)) - self.weights[-1]))


def learn(rows: DataFrame) -> Model:
    """A model of (doc_id, text, y) rows."""
    spark = rows.sparkSession
    first = rows.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min("doc_id").alias("doc_id"))  # equal texts teach once
    sizes = {y > 0: 0 for y in (0, 1)}
    for y, n in first.groupBy("y").count().collect():
        sizes[y > 0] += n
    empty = Grams(np.empty(0, np.int64))
    if not all(sizes.values()):
        return Model(empty, np.array([np.log((sizes[True] + 1e-6) / (sizes[False] + 1e-6)) if sum(sizes.values()) else -50.0]))
    kept = first.select("doc_id", "y")
    kept = F.broadcast(kept) if sum(sizes.values()) <= 2_000_000 else kept
    once = rows.join(kept, ["doc_id", "y"], "left_semi")
    toxic = once.filter("y > 0").select("text").mapInArrow(_gram_rows, "gram long, n long")
    least = max(3.0, LEAST_SHARE * sizes[True])
    found = toxic.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()  # at most (grams of a row) / LEAST_SHARE
    gram, bad = found["gram"].to_numpy(), found["n"].to_numpy()
    every = spark.sparkContext.broadcast(Grams(gram))
    seen = once.filter("y = 0").select("text").mapInArrow(lambda b: _known_rows(b, every), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    good = np.zeros(gram.size, np.int64)
    good[seen["k"].to_numpy()] = seen["n"].to_numpy()
    p, q = (bad + 0.5) / (sizes[True] + 1), (good + 0.5) / (sizes[False] + 1)
    tells = np.where(p >= RATIO * q, p * np.log(p / q), 0)
    chosen = np.argsort(-tells, kind="stable")[: min(FEATURES, int((tells > 0).sum()))]
    grams = Grams(gram[chosen])
    sent = spark.sparkContext.broadcast(grams)
    sampled = first.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # ids alone pass through the one task
    sample = rows.join(F.broadcast(sampled), ["doc_id", "y"], "left_semi")
    examples = sample.select("y", "text").mapInArrow(lambda b: _examples(b, sent), SAMPLE).toArrow()
    weights = fit(examples["y"].to_numpy().astype(float), examples["features"].to_pylist(), examples["swaps"].to_pylist(), grams.size)
    return Model(grams, weights)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [model.value.scores(texts) for _, texts in slices(batch)]
        yield batch_of(SCORED, batch.column("doc_id"), np.concatenate(parts) if parts else [])


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return flat.mapInArrow(lambda b: _score(b, sent), "doc_id long, score double")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = labelled(docs.filter(fold(F.col("doc_id"), 3) != 1), table(spark, sf_dir, "labels"), "toxic")
    found = score(docs, learn(rows))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
