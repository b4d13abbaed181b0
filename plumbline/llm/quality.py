"""Quality by importance resampling: hashed n-gram models of good text and of all text, and Gumbel top-k on their ratio.

Both models are multinomials over hashed byte 4-grams (capitals, marks and digits as they are) and over one event per pair of
neighbouring words, alike or not, so that text repeating itself is told from prose. The target model learns from rows labelled good,
the raw model from every row; counts are added up over all rows. A text's log weight is the log of its probability under the target
model over that under the raw one. Its rate is the log weight over n_events + STEADY, so that a long text does not go for the sampling noise of
its many n-grams, nor a short one for a few odd ones. Resampling keeps the k rows of the highest rate + temperature * Gumbel noise.
Unless k is given it is the number of rows whose rate reaches the threshold that best tells labelled good rows from bad ones, so
the sample is as large as the good part of the corpus. The k-th key is found by counting between bounds, never by sorting all rows.

Noise is drawn from the hash of id and text, so runs repeat. Rows whose keys tie at the k-th place all stay, repeated rows together.
Null and empty texts have log weight 0. Null labels, unknown ids and null ids teach nothing; without good or without bad labels every row stays.
Other columns, whatever their names, are carried as they are or not read. A very long text is read whole, in memory in proportion to that one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, column, query, stored, table, whole_row
from plumbline.llm.grams import MIX, joined, labelled, slices, windows

BITS = 16
EVENTS = 2
STEADY = 1000
BINS = 4096
TEMPERATURE = 0.0005
SEED = 7
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)
COUNTED = pa.schema([("event", pa.int32()), ("n", pa.int64())])


def _events(texts: list[bytes]):
    """(places, events, begins): one event per 4-gram, then one per pair of neighbouring words of a text."""
    data, begins = joined(texts, None)
    most = int(begins[-1])
    blank = SPACE[data]
    at = np.flatnonzero(~(blank[:most] & blank[1 : most + 1]))
    grams = ((windows(data, 4)[at] + np.uint64(1)) * MIX >> np.uint64(64 - BITS)).astype(np.int64)
    starts = np.flatnonzero(blank[:most] & ~blank[1 : most + 1]) + 1
    ends = np.flatnonzero(~blank[:most] & blank[1 : most + 1]) + 1
    size = ends - starts
    heads = windows(data, 8)[starts] & MASKS[np.minimum(size, 8)]
    owner = np.searchsorted(begins, starts, "right")
    pair = owner[1:] == owner[:-1]
    alike = (heads[1:] == heads[:-1]) & (size[1:] == size[:-1])  # same length, same first eight bytes
    return np.concatenate([at, starts[1:][pair]]), np.concatenate([grams, (1 << BITS) + alike[pair]]), begins


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << BITS) + EVENTS, np.int64)
    for batch in batches:
        for _, texts in slices(batch):
            total += np.bincount(_events(texts)[1], minlength=total.size)
    at = np.flatnonzero(total)
    yield batch_of(COUNTED, at.astype(np.int32), total[at])


def _counts(rows: DataFrame) -> np.ndarray:
    out = np.zeros((1 << BITS) + EVENTS)
    found = rows.select("text").mapInArrow(_count, "event int, n long").groupBy("event").agg(F.sum("n").alias("n")).toArrow()  # one row an event at most
    out[found["event"].to_numpy()] = found["n"].to_numpy()
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of each event's probability, add-one smoothed; grams and word pairs are two distributions."""
    out = np.empty(target.size)
    for part in (slice(0, 1 << BITS), slice(1 << BITS, None)):
        t, r = target[part] + 1, raw[part] + 1
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


WEIGHED = pa.schema([("id", pa.int64()), ("n_events", pa.int64()), ("log_weight", pa.float64())])


def _weigh(batches: Iterator[pa.RecordBatch], ratios) -> Iterator[pa.RecordBatch]:
    """The batch without its text, with n_events and log_weight."""
    for batch in batches:
        n, weight = [], []
        for _, texts in slices(batch):
            at, events, begins = _events(texts)
            owner = np.searchsorted(begins, at, "right") - 1
            n.append(np.bincount(owner, minlength=len(texts)))
            weight.append(np.bincount(owner, ratios.value[events], len(texts)))
        names = [c for c in batch.schema.names if c != "text"]
        arrays = [pa.array(np.concatenate(x) if x else np.empty(0)) for x in (n, weight)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], arrays[0].cast(pa.int64()), arrays[1].cast(pa.float64())], names=[*names, "n_events", "log_weight"])


def weigh(rows: DataFrame, ratios) -> DataFrame:
    """`rows` with a text column, less it, plus n_events, log_weight."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda b: _weigh(b, ratios), f"{kind}, n_events long, log_weight double")


def rate():
    return F.col("log_weight") / (F.col("n_events") + STEADY)


def threshold(known: DataFrame) -> float | None:
    """The rate that tells good rows (y = 1) from bad ones with the highest balanced accuracy; the middle of the gap there. Rates are
    counted in bins of 1 / BINS. As no log ratio of counts passes 50, the driver sees a bounded table."""
    bins = known.groupBy(F.floor(rate() * BINS).alias("bin")).agg(
        F.sum((F.col("y") > 0).cast("long")).alias("good"), F.sum((F.col("y") <= 0).cast("long")).alias("bad"), F.min(rate()).alias("least"),
        F.max(rate()).alias("most")).orderBy("bin").collect()
    good, bad = np.array([b["good"] for b in bins], float), np.array([b["bad"] for b in bins], float)
    if not good.sum() or not bad.sum():
        return None
    right = (good.sum() - np.concatenate([[0], np.cumsum(good)])) / good.sum() + np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    k = int(right.argmax())
    if 0 < k < len(bins):
        return (bins[k - 1]["most"] + bins[k]["least"]) / 2
    return bins[0]["least"] if k == 0 else bins[-1]["most"] + 1


def gumbel(*columns):
    """Gumbel noise from a hash of the columns."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest `key`, exactly, by counting in ever narrower bounds; no key is sorted and 1024 counts reach the driver a pass."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    above = 0
    while low < high:
        width = (high - low) / 1024
        if width <= 0 or low + width <= low:
            break
        cell = F.least(F.lit(1023), F.floor((F.col("key") - low) / width))
        rows = keys.filter(F.col("key").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for row in sorted(rows, key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["n"] + above < k:
            return rows and min(r["a"] for r in rows)
        if (row["a"], row["b"]) == (low, high):
            break
        low, high = row["a"], row["b"]
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, text: str = "text", doc_id: str = "doc_id", carry=None) -> DataFrame:
    """doc_id, n_events, log_weight, key (rate and noise), kept of every row (and `carry`, a column of docs, if given)."""
    spark = docs.sparkSession
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"), *([carry.alias("row")] if carry is not None else []))
    rows = labelled(docs, labels, "quality", text, doc_id)
    ratios = spark.sparkContext.broadcast(log_ratios(_counts(rows.filter("y > 0")), _counts(flat)))
    key = rate() + temperature * gumbel("doc_id", "log_weight")
    weighed = weigh(flat, ratios).withColumn("key", key)
    if k is None:
        bound = threshold(weigh(rows.select("y", "text"), ratios))
        if bound is None:
            return weighed.withColumn("kept", F.lit(True))
        light = stored(weigh(flat.select("doc_id", "text"), ratios).select(rate().alias("rate"), key.alias("key")))
        k = light.filter(F.col("rate") >= bound).count()
    else:
        light = stored(weighed.select("key"))
    least = kth_largest(light, k)
    return weighed.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that resampling keeps, with all their columns."""
    return resample(docs, labels, carry=whole_row(docs), **options).filter("kept").select("row.*")


@query("op7_quality_resampling")
def op7_quality_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
