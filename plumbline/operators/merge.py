"""Bag union of tables with source tags."""

from plumbline.functions.expr import col
from plumbline.operators.stats import union_all
from pyspark.sql import functions as F


def shared_columns(tables):
    """{column: [labels]} for columns that occur in more than one table."""
    where = {}
    for label, df in tables.items():
        for c in df.columns:
            where.setdefault(c, []).append(label)
    return {c: labels for c, labels in where.items() if len(labels) > 1}


def label_suffix(label):
    # Fixed value: the suffix of a shared column is the label without spaces and separators, 15 characters long.
    return label.replace(" ", "_").replace("›", "").strip()[:15]


def suffixes(tables):
    """{label: suffix}. Labels alike in their short suffix keep their whole length, and a number if even that is alike."""
    short = {label: label_suffix(label) for label in tables}
    taken, out = set(), {}
    for label in tables:
        suffix = short[label]
        if sum(s == suffix for s in short.values()) > 1:
            suffix = label.replace(" ", "_").replace("›", "").strip()
        base, n = suffix, 1
        while suffix in taken:
            n += 1
            suffix = f"{base}_{n}"
        taken.add(suffix)
        out[label] = suffix
    return out


def tagged_union(tables):
    """every row of every table with ``_source``; shared columns are kept apart by a label suffix."""
    shared, suffix = shared_columns(tables), suffixes(tables)
    frames = [
        df.select(*[col(c).alias(f"{c}__{suffix[label]}" if c in shared else c) for c in df.columns],
                  F.lit(label).alias("_source"))
        for label, df in tables.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def conflicts_table(spark, tables):
    """the shared columns and where they came from."""
    rows = [(c, len(labels), ", ".join(labels)) for c, labels in shared_columns(tables).items()]
    return spark.createDataFrame(rows, "column string, tables int, sources string")


def per_table(tables, operator):
    """the same operator on each table, the results tagged with the table's label."""
    return union_all([operator(df).withColumn("label", F.lit(label)) for label, df in tables.items()])
