"""Stable copies of tables: what is read twice must be the same twice, and survive lost executors."""

import tempfile
import uuid

_own = []


def shared_folder(spark):
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one on a local master without that setting; else None."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="plumbline-"))
        named = _own[0]
    return named.rstrip("/") if named else None


def new_folder(spark, name):
    """A folder name in the shared folder that is not in use."""
    top = shared_folder(spark)
    if top is None:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def materialised(df):
    """The table with its partitions as they are, behind a reliable checkpoint in the shared folder.

    On a cluster without such a folder the rows are only cached: a lost part is then computed again from the same shuffle.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = shared_folder(df.sparkSession)
        if named is None:
            return df.persist()
        context.setCheckpointDir(named)
    return df.checkpoint()  # written by the job that makes the rows


def stored(df):
    """The rows by column in the shared folder, for tables that are read many times: a scan decodes the columns that it needs and no others.

    Order and partitions are not kept. Columns get plain names in the files, so any header will do; a table with a type that the files cannot
    hold, or without such a folder, is kept as ``materialised`` keeps it.
    """
    types = [f.dataType.simpleString() for f in df.schema.fields]
    if not types or shared_folder(df.sparkSession) is None or any(word in t for t in types for word in ("void", "interval", "collate")):
        return materialised(df)
    folder = new_folder(df.sparkSession, "rows")
    df.toDF(*[f"c{i}" for i in range(len(types))]).write.parquet(folder)
    return df.sparkSession.read.parquet(folder).toDF(*df.columns)


def local(df):
    """A small table, of a row per column or less, as rows that the plan carries; reading it takes no job."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
