"""Writers for cleaned tables and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.expr import col

# The columns of the statistics sheet.
STATISTICS_COLUMNS = ("column", "count", "mean", "median", "std", "variance", "min", "max", "range", "q1", "q3", "iqr",
                      "skewness", "kurtosis", "cv")
FORMATS = ("csv", "json", "parquet")


def write_table(df, path, kind="parquet", mode="overwrite"):
    """One table, in parallel; CSV gets a header in every part file."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    writer = df.write.mode(mode)
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)


def raw_extract(df, order_by, rows=None):
    """The table in its order, or its first rows (a sheet of 10,000, say)."""
    ordered = df.orderBy(*[col(c) for c in order_by])
    return ordered if rows is None else ordered.limit(rows)


def statistics_sheet(statistics):
    return statistics.select(*STATISTICS_COLUMNS)


def outlier_sheet(outliers, examples=3):
    """The outlier table with its first three extremes."""
    listed = F.slice(F.split(F.regexp_replace("extremes", r"[\[\]]", ""), ", "), 1, examples)
    return outliers.select("column", "count", "pct", "lb", "ub", "severity", F.concat_ws(", ", listed).alias("samples"))


def insight_sheet(ranked):
    """Numbered insights; the caller passes the ranked (k-row) insights."""
    place = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    number = F.row_number().over(Window.orderBy(place, F.desc("confidence"), "type", "subject"))
    return ranked.select(number.alias("number"), F.upper("type").alias("type"), F.upper("priority").alias("priority"),
                         "title", F.col("text").alias("description"))


def report_tables(tables):
    """From the sections of an analysis to the sheets of a report."""
    sheets = {}
    make = {"statistics": statistics_sheet, "outliers": outlier_sheet, "insights": insight_sheet}
    for name, df in tables.items():
        sheets[name] = make.get(name, lambda d: d)(df)
    return sheets


def flat(df):
    """Maps, arrays and structs as JSON text, which CSV can hold."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
    return df.withColumns({c: F.to_json(col(c)) for c in nested})


def write_report(tables, folder, kind="parquet"):
    """Every sheet under ``folder/<name>``, in as many files as its tasks write."""
    for name, df in report_tables(tables).items():
        write_table(flat(df) if kind == "csv" else df, f"{folder}/{name}", kind)
