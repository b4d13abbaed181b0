"""Byte n-grams of whole texts as numbers, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import buffers, column

#: Lower-cases A-Z, keeps a-z and every byte above 7F, and turns the rest into spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEPARATOR = b" " * 8
SLICE_BYTES = 1 << 20
BROADCAST_ROWS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in runs of at most `size` bytes (or one text): (number of the first row, texts). Null is empty."""
    first, held, total = 0, [], 0
    for i, body in enumerate(buffers(batch.column(text))):
        body = body or b""
        if held and total + len(body) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(body)
        total += len(body) + len(SEPARATOR)
    if held:
        yield first, held


def joined(texts: list[bytes], by: bytes | None = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes with spaces around each, and where each begins (with the total end)."""
    data = SEPARATOR + SEPARATOR.join(texts) + SEPARATOR
    if by:
        data = data.translate(by)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SEPARATOR)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer(data, np.uint8), begins


def windows(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes (8 at most) from each place, as one number each; the last 7 places have none."""
    wide = np.ndarray((data.size - 7,), "<u8", data.data, strides=(1,))
    return wide & np.uint64((1 << 8 * n) - 1) if n < 8 else wide.copy()


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their summed counts."""
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), keys.size).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, y of the documents that have a label. The label side is broadcast only where its counted rows fit; else it shuffles."""
    known = labels.select(column(labels, doc_id, "long").alias("doc_id"), column(labels, label, "int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    flat = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return flat.join(known, "doc_id")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts
