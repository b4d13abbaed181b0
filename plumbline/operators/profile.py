"""What a table holds: shape, completeness, per-column profile, catalog of several tables."""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expr import (
    class_of, col, date_columns, finite, numbers, numeric_columns, rounded, text_columns, type_of,
)
from plumbline.functions.names import NON_NEGATIVE_WORDS, has_word
from plumbline.operators.roles import classify
from plumbline.operators.stats import (
    cardinality, frequencies, iqr_fences, per_column, union_all,
)

HINTS = {"Numeric": "SUM / AVG / COUNT", "Date/Time": "DATE HIERARCHY / GROUP BY", "Text": "GROUP BY / COUNT / FILTER"}
SAMPLE_WIDTH = {"Numeric": 30, "Date/Time": 10, "Text": 25}


def catalog(tables, preview=20):
    """One row per table with its size and first columns; the counts run as one union."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(label).alias("label"), "rows", F.lit(len(df.columns)).alias("columns"),
            F.lit(", ".join(df.columns[:preview])).alias("first_columns"))
        for label, df in tables.items()
    ]
    many = len(tables) > 1
    return union_all(frames).withColumns({"needs_choice": F.lit(many), "star_candidate": F.lit(many)})


def catalog_totals(catalogued):
    """A8."""
    return catalogued.agg(F.count(F.lit(1)).alias("total_tables"), F.sum("rows").alias("total_rows"))


def null_counts(df, columns=None):
    return per_column(df, columns or df.columns, lambda c: [
        (F.count(F.lit(1)) - F.count(col(c))).alias("null_count")])


def missing_table(df, digits=2):
    """C16, also B9's missing summary: columns with nulls, most first."""
    return null_counts(df).where("null_count > 0").select(
        "column", F.col("null_count").alias("missing"),
        F.round(F.col("null_count") / F.col("rows") * 100, digits).alias("pct"),
    ).orderBy(F.desc("missing"), "column")


def completeness(df):
    """C14: share of cells that hold a value; 100 for a table without cells."""
    cells = F.count(F.lit(1)) * len(df.columns)
    nulls = sum((F.count(F.lit(1)) - F.count(col(c)) for c in df.columns), F.lit(0))
    return df.agg(
        F.coalesce(F.round((1 - nulls / F.nullif(cells, F.lit(0))) * 100, 2), F.lit(100.0)).alias("completeness_pct"))


def duplicate_rows(df):
    """Rows beyond the first of each distinct row. Copies meet inside each task before the shuffle."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
HELD_VALUES = 2_000_000


def _plain(df, c):
    """A column as a whole number, a double (one NaN, one zero) or a text, equal for equal values."""
    kind = type_of(df, c)
    if isinstance(kind, WHOLE):
        return col(c).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(c)).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(c))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col(c)), F.lit(float("nan"))).otherwise(col(c).cast("double") + 0.0)
    if isinstance(kind, (T.MapType, T.VariantType, T.StructType, T.ArrayType)):
        return F.when(col(c).isNotNull(), F.to_json(F.struct(col(c))))
    return F.hex(col(c)) if isinstance(kind, T.BinaryType) else col(c).cast("string")


def _values_seen(batches):
    """i, a, b: which values each column has, from one set per column and task; a is the number itself, or a and b a text's 128-bit digest.
    Sets of more than HELD_VALUES entries are told and begun anew."""
    def told(sets):
        for i, (numbers, texts) in sets.items():
            a = np.concatenate([np.unique(np.concatenate(numbers))] if numbers else [np.empty(0, np.int64)])
            b = np.zeros(a.size, np.int64)
            if texts:
                digests = np.frombuffer(b"".join(blake2b(t.encode(), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
                a, b = digests[:, 0], digests[:, 1]
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, i, np.int32)), pa.array(a), pa.array(b)], names=["i", "a", "b"])

    sets, held = {}, 0
    for batch in batches:
        for i, column in enumerate(batch.columns):
            numbers, texts = sets.setdefault(i, ([], set()))
            values = pc.unique(column).drop_null()
            if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
                before = len(texts)
                texts.update(values.to_pylist())
                held += len(texts) - before
            elif len(values):
                whole = values.to_numpy()
                numbers.append(whole.view(np.int64))
                held += len(values)
                if len(numbers) > 64:
                    sets[i] = ([np.unique(np.concatenate(numbers))], texts)
                    held -= sum(map(len, numbers)) - len(sets[i][0][0])
        if held > HELD_VALUES:
            yield from told(sets)
            sets, held = {}, 0
    yield from told(sets)


def _distinct(df, columns):
    """column, distinct: non-null values of all columns in one scan and one shuffle; copies meet in their task before it."""
    plain = df.select(*[_plain(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    seen = plain.mapInArrow(_values_seen, "i int, a bigint, b bigint").distinct()
    counted = seen.groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column string")
    return names.join(counted, "i", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def distinct_counts(df, columns=None, approximate=False):
    """Distinct non-null values and their cardinality class."""
    columns = columns or df.columns
    if approximate:
        counted = per_column(df, columns, lambda c: [F.approx_count_distinct(col(c)).alias("distinct")])
    else:
        counted = _distinct(df, list(columns))
    return counted.select("column", "distinct", cardinality(F.col("distinct")).alias("cardinality"))


def _samples(df, order_by, width):
    """First three non-null values of every column in row order: a bounded top-three per task and column."""
    def first_three(c):
        kind = class_of(type_of(df, c))
        text = F.format_string("%.3f", finite(col(c))) if kind == "Numeric" else col(c).cast("string")
        key = F.struct(*[col(k) for k in order_by])
        known = df.where(finite(col(c)).isNotNull() if kind == "Numeric" else col(c).isNotNull())
        top = known.select(key.alias("k"), F.left(text, F.lit(width[kind])).alias("v")).orderBy("k", "v").limit(3)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"])
        return top.agg(F.count(F.lit(1)).alias("n"), F.concat_ws(", ", ordered).alias("samples")).where("n > 0").select(
            F.lit(c).alias("column"), "samples")

    return union_all([first_three(c) for c in df.columns])


def schema_profile(df, order_by=None, sources=None, column_sources=None, approximate=False):
    """One row per column. ``column_sources`` maps a column to the tables it came from."""
    profile = null_counts(df).join(distinct_counts(df, approximate=approximate).drop("cardinality"), "column")
    sources, column_sources = list(sources or []), column_sources or {}
    facts = []
    for i, f in enumerate(df.schema.fields):
        kind = class_of(f.dataType)
        present = sorted(column_sources.get(f.name, [])) or sources
        facts.append((f.name, i, kind, f.dataType.simpleString(), HINTS[kind], ", ".join(present), f.name == "_source"))
    static = df.sparkSession.createDataFrame(
        facts, "column string, position int, type string, dtype string, agg_hint string, present_in string, is_source boolean")
    out = static.join(profile, "column").select(
        "position", "column", "type", "dtype", "null_count",
        F.round(F.col("null_count") / F.greatest("rows", F.lit(1)) * 100, 1).alias("null_pct"),
        F.col("distinct").alias("unique"), "agg_hint", "present_in", "is_source")
    if order_by:
        out = out.join(_samples(df, order_by, SAMPLE_WIDTH), "column", "left")
    return out


def schema_answer(df, order_by=None):
    """The short profile, with three samples per column where a row order is given."""
    return schema_profile(df, order_by).select(
        "position", "column", "type", "dtype", "null_pct", "unique", *(["samples"] if order_by else []),
        F.when(F.col("type") == "Numeric", "SUM/AVG").otherwise("GROUP BY/COUNT").alias("agg_hint"))


def joined_schema_profile(df, fact_name, relationship_keys, key_columns, order_by=None):
    """Profile of a joined table with each column's origin and foreign-key hint.

    ``relationship_keys`` maps a joined key column to its dimension's name.
    """
    source, kind, hint = F.lit(fact_name), F.col("type"), F.lit("GROUP BY/FILTER")
    is_key = F.col("column").isin(list(key_columns)) if key_columns else F.lit(False)
    source = F.when(is_key, F.lit("Key/ID")).otherwise(source)
    for key, dim in relationship_keys.items():
        source = F.when(F.col("column") == key, F.lit(dim)).otherwise(source)
    measure = (kind == "Numeric") & ~is_key
    base = schema_profile(df, order_by).withColumn("source_table", source)
    columns = ["position", "column",
               F.when(kind == "Date/Time", kind).when(measure, "Numeric").when(is_key, "Key").otherwise("Text").alias("type"),
               "dtype", "null_count", "null_pct", "unique",
               F.when(measure, "SUM/AVG/MEASURE").when(is_key, F.concat(F.lit("FK → "), "source_table"))
               .otherwise(hint).alias("agg_hint"), "source_table", is_key.alias("is_id"),
               (kind == "Date/Time").alias("is_date")]
    return base.select(*columns, *(["samples"] if order_by else []))


def browse_schema(profile, kind="all", search=None):
    """Filter a profile by class or keys and by part of the name."""
    has_key = "is_id" in profile.columns
    is_key = (F.col("is_id") if has_key else F.lit(False)) | (F.col("type") == "Key")
    out = profile
    if kind == "keys":
        out = out.where(is_key)
    elif kind != "all":
        out = out.where(F.col("type") == kind)
    if search:
        out = out.where(F.contains(F.lower("column"), F.lit(search.lower())))
    return out.where(~F.col("is_source")) if "is_source" in profile.columns else out


def schema_class_counts(profile):
    """How many columns of each class."""
    return profile.groupBy("type").agg(F.count(F.lit(1)).alias("columns"))


def schema_by_source(profile, table="source_table"):
    """The columns of each source table, in name order."""
    return profile.groupBy(table).agg(
        F.count(F.lit(1)).alias("columns"), F.concat_ws(", ", F.array_sort(F.collect_list("column"))).alias("names"))


def understanding(df, classic=True):
    """One descriptive line per column, with its counts."""
    roles = classify(df, classic=classic)
    numeric = numeric_columns(df)
    texts, dates = text_columns(df), date_columns(df)

    def measure(c):
        known = F.count(col(c)).alias("present")
        if c in numeric:
            v = finite(col(c))
            return [known, F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"),
                    F.lit(None).cast("string").alias("since"), F.lit(None).cast("string").alias("until")]
        span = [F.min(col(c)).cast("string"), F.max(col(c)).cast("string")] if c in dates else [
            F.lit(None).cast("string")] * 2
        return [known, *[F.lit(None).cast("double").alias(n) for n in ("lo", "hi", "mean")],
                span[0].alias("since"), span[1].alias("until")]

    base = per_column(df, numeric + texts + dates, measure)
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))))
    if texts:
        top = frequencies(df, texts).groupBy("column").agg(
            F.count("value").alias("distinct"), best["v"].alias("top"))
    else:
        top = df.sparkSession.createDataFrame([], "column string, distinct bigint, top string")
    missing = F.col("rows") - F.col("present")
    lost = F.format_string("%d missing (%.1f%%)", missing, F.round(missing / F.col("rows") * 100, 1))
    line = (
        F.when(F.col("column").isin(roles.index), "Row number or identifier, left out of the analysis")
        .when(F.col("column").isin(dates), F.concat(F.lit("Dates from "), "since", F.lit(" to "), "until"))
        .when(F.col("column").isin(numeric), F.concat(
            F.format_string("Numbers from %,.2f to %,.2f, mean %,.2f, ", "lo", "hi", "mean"), lost))
        .otherwise(F.concat(F.format_string("Category of %d values, most often %s, ", "distinct",
                                            F.coalesce("top", F.lit("N/A"))), lost))
    )
    return base.join(top, "column", "left").select(
        "column", F.col("present"), missing.alias("missing"), F.round(missing / F.col("rows") * 100, 2).alias("missing_pct"),
        rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), rounded(F.col("mean")).alias("mean"),
        F.col("distinct"), "top", line.alias("description"))


def anomalies(df, columns=None, mode="auto"):
    """B9's anomaly list: beyond three interquartile ranges (C7), negative (C8), mostly zero."""
    columns = columns or classify(df, classic=True).numeric
    df = numbers(df, columns)
    fences = iqr_fences(df, columns, 3.0, mode)

    def measure(c):
        v = col(c)
        lo, hi = fences.get(c, (None, None, None, None))[:2]
        beyond = F.count(F.when((v < lo) | (v > hi), 1)) if lo is not None else F.lit(0).cast("bigint")
        return [F.count(v).alias("n"), beyond.alias("extreme"), F.count(F.when(v < 0, 1)).alias("negative"),
                F.count(F.when(v == 0, 1)).alias("zero"), F.lit(has_word(c, NON_NEGATIVE_WORDS)).alias("signed_name")]

    rows = per_column(df, columns, measure)
    zero_share = F.col("zero") / F.col("n")
    checks = F.array(
        F.when((F.col("n") >= 4) & (F.col("extreme") > 0), F.struct(
            F.lit("extreme_outliers").alias("check"), F.col("extreme").alias("rows"),
            F.format_string("%s: %d values beyond three interquartile ranges", "column", "extreme").alias("detail"))),
        F.when(F.col("signed_name") & (F.col("negative") > 0), F.struct(
            F.lit("negative_values").alias("check"), F.col("negative").alias("rows"),
            F.format_string("%s: some values are negative where none is expected", "column").alias("detail"))),
        F.when(zero_share > 0.5, F.struct(
            F.lit("mostly_zero").alias("check"), F.col("zero").alias("rows"),
            F.format_string("%s: %.1f%% zeros, which may stand for no value", F.col("column"), zero_share * 100)
            .alias("detail"))),
    )
    return rows.select("column", F.explode(F.array_compact(checks)).alias("a")).select("column", "a.*")


def export_summary(df, export_date):
    """A10: the metric/value sheet that goes with an exported table."""
    cells = F.count(F.lit(1)) * len(df.columns)
    nulls = sum((F.count(F.lit(1)) - F.count(col(c)) for c in df.columns), F.lit(0))
    wide = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"),
                  F.coalesce(F.round((1 - nulls / F.nullif(cells, F.lit(0))) * 100, 2), F.lit(100.0)).alias("full"))
    lines = [
        ("Total Rows", F.col("rows")), ("Total Columns", F.lit(len(df.columns))),
        ("Numeric Columns", F.lit(len(numeric_columns(df)))), ("Categorical Columns", F.lit(len(text_columns(df)))),
        ("Missing Values", F.col("nulls")), ("Completeness %", F.format_string("%.2f", "full")),
        ("Export Date", F.lit(export_date)),
    ]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), v.cast("string").alias("value"))
        for i, (m, v) in enumerate(lines)])).alias("r")).select("r.*")


def overview(df, classic=True):
    """The shape, the columns of each role, the completeness and one line per column, as rows."""
    roles = classify(df, classic=classic)
    shape = df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(
        F.struct(F.lit("rows").alias("item"), F.col("rows").cast("string").alias("value")),
        F.struct(F.lit("columns").alias("item"), F.lit(str(len(df.columns))).alias("value")),
        F.struct(F.lit("numeric_columns").alias("item"), F.lit(", ".join(roles.numeric)).alias("value")),
        F.struct(F.lit("categorical_columns").alias("item"), F.lit(", ".join(roles.categorical)).alias("value")),
    )).alias("r")).select("r.*")
    full = completeness(df).select(F.lit("completeness").alias("item"),
                                   F.format_string("%.2f%%", "completeness_pct").alias("value"))
    lines = understanding(df, classic).select(F.concat(F.lit("column "), "column").alias("item"),
                                              F.col("description").alias("value"))
    return union_all([shape, full, lines])
