"""What the operators share: the registry, the shared scratch folder, numbered rows and packed arrays."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(name, sql=None):
    """Register a query, with its SQL text if it has one."""
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share. Where that is unset, a temporary folder of this process if the
    master is local, else an error: executors of a cluster would not see it."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    _own = _own or tempfile.mkdtemp(prefix="plumbline-")
    return _own


def scratch(spark: SparkSession, note: bool = True) -> str:
    """A new folder name in the shared folder."""
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex[:12]}"
    if note and _registries:
        _registries[-1].append(path)
    return path


_registries: list[list[str]] = []


@contextmanager
def stage_tables(spark: SparkSession):
    """Within the block, tables made by `stored` are noted and deleted at its end. What the block returns must be written by then."""
    _registries.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _registries.pop():
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its partitions as they are, cut from its lineage by reliable files in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, note: bool = True) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later plans start at the files, whatever executors are lost."""
    path = scratch(df.sparkSession, note)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """Stored rows as (rid, row): `rid` is unique and, as the rows are stored, the same in every later read. `row` holds all columns."""
    return stored(df.select(F.monotonically_increasing_id().alias("rid"), whole_row(df).alias("row")))


def whole_row(df: DataFrame):
    """All columns as one struct, so that no column of the caller meets one of ours; names may even repeat."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def column(df: DataFrame, name: str, kind: str):
    """A column cast to `kind`, or nulls of that kind where the table has no such column."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def buffers(array: pa.Array) -> list[bytes | None]:
    """A text column's values as UTF-8 bytes, without decoding them."""
    return array.cast(pa.binary()).to_pylist()


def packed(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes, planes of equal significance together."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return values.dtype.char.encode() + zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
