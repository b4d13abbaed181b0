"""Language identification by Bloom filters whose cells are bitmasks of languages.

Byte 4-grams are counted by language over all training rows. A language owns a gram if the gram's rate there is at least SHARE of
its highest rate in any language, so stray sentences in another tongue teach nothing. Each gram sets its owners' bits in HASHES
cells; one look-up per cell and an AND return every language that holds a gram. A text's grams give a popcount per language, less
what the filter's fill would give by chance; the highest corrected count decides, ties by name. The filter has 8 cells per gram, at
most 2**MAX_BITS; only set cells reach the driver, so its size is bounded.

`und` with score 0: null text, no letter, or nothing learned. Letters but no usable gram: the language of most training rows, score 0.
Rows without lang are never learned from; a null id folds as the empty text. Empty tables give empty results.
Other columns are not read, whatever their names. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, column, query, stored, table
from plumbline.llm.grams import MIX, MIX_2, added, fold, joined, slices, windows

SHARE = 0.3
LEAST = 2
HASHES = 2
MAX_BITS = 23
HELD = 400_000
PLAIN_LETTER = re.compile(rb"[A-Za-z]")
COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _usable(data: np.ndarray) -> np.ndarray:
    """Places whose gram has letters in the middle."""
    letter = data != 32
    return letter[1:-6] & letter[2:-5]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams by language, added up over the task as long as they fit."""
    held: dict[str, list] = {}
    def flush():
        for lang, parts in held.items():
            grams, n = added(parts)
            yield batch_of(COUNTED, [lang] * grams.size, grams.astype(np.int64), n)
        held.clear()
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, texts in slices(batch):
            mine = langs[first : first + len(texts)]
            for lang in dict.fromkeys(mine.tolist()):
                data, _ = joined([t for t, x in zip(texts, mine, strict=True) if x == lang])
                grams = np.sort(windows(data, 4)[_usable(data)].astype(np.uint32))
                edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if grams.size else np.empty(0, np.int64)
                parts = held.setdefault(lang, [])
                parts.append((grams[edges], np.diff(np.append(edges, grams.size))))
                if len(parts) > 8:
                    parts[:] = [added(parts)]
        if sum(p[0].size for parts in held.values() for p in parts) > HELD:
            yield from flush()
    yield from flush()


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = grams.astype(np.uint64)
    return [((wide + np.uint64(1)) * c >> np.uint64(64 - bits)).astype(np.int64) for c in (MIX, MIX_2)[:HASHES]]


class Filter:
    """Language masks by cell. `planes` holds 64 languages each."""

    def __init__(self, languages: list[str], common: str, planes: np.ndarray):
        self.languages, self.common, self.planes = languages, common, planes
        self.bits = planes.shape[1].bit_length() - 1
        fill = np.array([[float(((plane >> np.uint64(b)) & np.uint64(1)).mean()) for b in range(64)] for plane in planes]).ravel()[: len(languages)]
        self.chance = np.minimum(fill**HASHES, 0.999)

    def counts(self, data: np.ndarray, begins: np.ndarray):
        """Grams of each text, and how many of them each language holds."""
        usable = _usable(data)
        at = np.flatnonzero(usable)
        cells = _cells(windows(data, 4)[at], self.bits)
        edges = np.searchsorted(at, begins)
        n = np.diff(edges)
        out = np.zeros((n.size, len(self.languages)))
        for p, plane in enumerate(self.planes):
            masks = plane[cells[0]]
            for c in cells[1:]:
                masks = masks & plane[c]
            for b in range(min(64, len(self.languages) - 64 * p)):
                sums = np.concatenate([[0], np.cumsum((masks >> np.uint64(b)) & np.uint64(1), dtype=np.int64)])
                out[:, 64 * p + b] = np.diff(sums[edges])
        return n, out


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _has_letter(text: bytes) -> bool:
    return bool(PLAIN_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="ignore"))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    f = model.value
    for batch in batches:
        names, scores = [], []
        for _, texts in slices(batch):
            data, begins = joined(texts)
            if not f.languages:
                names += ["und"] * len(texts)
                scores += [0.0] * len(texts)
                continue
            n, held = f.counts(data, begins)
            sure = np.maximum(0.0, (held - n[:, None] * f.chance) / (1 - f.chance))
            best = sure.argmax(axis=1)
            top = sure[np.arange(n.size), best]
            share = np.divide(top, sure.sum(axis=1), out=np.zeros(n.size), where=top > 0)
            for i, text in enumerate(texts):
                if not _has_letter(text):
                    names.append("und"), scores.append(0.0)
                elif top[i] > 0:
                    names.append(f.languages[best[i]]), scores.append(float(min(1.0, share[i])))
                else:
                    names.append(f.common), scores.append(0.0)
        yield batch_of(PREDICTED, batch.column("doc_id"), names, scores)


CELLS = pa.schema([("plane", pa.int32()), ("cell", pa.int64()), ("mask", pa.int64())])


def _set_cells(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, number = batch.column("gram").to_numpy(), batch.column("number").to_numpy()
        masks = np.left_shift(np.uint64(1), (number % 64).astype(np.uint64)).view(np.int64)
        for cells in _cells(grams, bits):
            yield batch_of(CELLS, (number // 64).astype(np.int32), cells, masks)


def learn(rows: DataFrame) -> Filter:
    """The filter of (text, lang) rows; nulls teach nothing."""
    rows = rows.dropna(subset=["text", "lang"])
    counted = stored(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Filter([], "und", np.zeros((1, 2), np.uint64))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    numbers = rows.sparkSession.createDataFrame(list(zip(languages, range(len(languages)), strict=True)), "lang string, number int")
    rated = counted.filter(F.col("n") >= LEAST).join(F.broadcast(totals.join(numbers, "lang")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("number", "rate")).alias("held"))  # one entry a language
    owned = stored(top.select("gram", F.explode("held").alias("h"), "top").filter(F.col("h.rate") >= SHARE * F.col("top")).select("gram", F.col("h.number").alias("number")))
    bits = min(MAX_BITS, max(10, (8 * owned.select("gram").distinct().count()).bit_length()))
    planes = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
    cells = owned.mapInArrow(lambda b: _set_cells(b, bits), "plane int, cell long, mask long").groupBy("plane", "cell").agg(F.bit_or("mask").alias("mask"))
    found = cells.toArrow()  # at most the filter's cells
    planes[found["plane"].to_numpy(), found["cell"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Filter(languages, max(languages, key=lambda x: (sizes[x], x)), planes)


def predict(docs: DataFrame, model: Filter, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    return flat.mapInArrow(lambda b: _predict(b, sent), "doc_id long, lang_pred string, score double")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
