"""Analyse a growing table again whenever files arrive."""

from plumbline.sources.sinks import flat, write_table
from plumbline.streaming.accumulate import Accumulated

SECTIONS = ("gates", "statistics", "insights")


def watch_folder(spark, folder, schema, kind="parquet", max_files=None):
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(kind)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def analyse_arrivals(stream, out, state, order_by, label="arrivals", sections=SECTIONS, kind="parquet", trigger=None,
                     combined=False, test="moments"):
    """Add every micro-batch to the table and write the sections of the whole so far under ``out/<section>/batch=<id>``.

    A batch replaces only what was stored under its own number, so a replay after a failure changes nothing. The
    stream's progress and the accumulated table are kept in ``state``, which has to be on shared storage.
    """
    def one(batch, number):
        if batch.isEmpty():
            return
        table = Accumulated(batch.sparkSession, f"{state}/table", order_by, combined)
        table.add(batch, number)
        report = table.report(label, test)
        for name in sections:
            if name in report.tables:
                write_table(flat(report.tables[name]), f"{out}/{name}/batch={number}", kind)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/progress").trigger(
        **(trigger or {"availableNow": True})).start()
