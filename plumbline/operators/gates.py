"""Validation gates and data-quality checks. Gates yield status columns; nothing is raised."""

from pyspark.sql import functions as F

from plumbline.functions.expr import col, date_columns, number, numbers, numeric_columns, ratio, rounded, text_columns
from plumbline.functions.names import NON_NEGATIVE_WORDS_LONG, PERCENTAGE_WORDS, has_word
from plumbline.operators.stats import per_column, union_all

# The thresholds of the gates.
COLUMN_MISSING_PCT = 20.0
DATASET_MISSING_PCT = 60.0
COMBINED_MISSING_PCT = 75.0
MIN_ROWS = 5
NUMERIC_TEXT_SHARE = 0.7


def checked_columns(df):
    return [c for c in df.columns if not c.startswith("_")]


def _gate_values(df, parse=True):
    """One plain attribute per checked column: the number, whether a text parses as one (if asked for), or just its presence."""
    texts, numeric = text_columns(df), numeric_columns(df)

    def value(c):
        if c in texts and parse:
            return F.when(col(c).isNotNull(), number(col(c)).isNotNull().cast("double"))
        return F.when(col(c).isNotNull(), F.lit(0.0))

    others = df.withColumns({c: value(c) for c in checked_columns(df) if c not in numeric})
    return numbers(others, checked_columns(df))


def column_facts(df, warn=True):
    """What the gates read: one row per column of rows, present, total (of a text: how many parse as numbers), lo and hi.

    Facts of parts of a table add up to the facts of the whole. Only the warning parses texts; without it texts are not read
    beyond their presence.
    """
    return per_column(_gate_values(df, warn), checked_columns(df) or df.columns, lambda c: [
        F.count(col(c)).alias("present"), F.sum(col(c)).alias("total"), F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")])


def merged_column_facts(parts):
    """The facts of a table from those of its parts."""
    return parts.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "present", "total")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def column_gates(df, warn=True, facts=None):
    """Per column the null share, whether it is blocked and why, and, with ``warn``, the numbers-as-text warning."""
    texts, numeric = text_columns(df) if warn else [], numeric_columns(df)
    found = (column_facts(df, warn) if facts is None else facts).where(F.col("column").isin(checked_columns(df)))
    named = lambda names: F.col("column").isin(list(names)) if names else F.lit(False)
    rows = found.withColumns({
        "numeric_share": F.when(named(texts), ratio(F.col("total"), F.col("present"))).cast("double"),
        "constant": named(numeric) & F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)),
    })
    pct = (F.col("rows") - F.col("present")) / F.col("rows") * 100
    missing = pct > COLUMN_MISSING_PCT
    flat = ~missing & F.col("constant") & (F.col("present") >= 2)
    return rows.select(
        "column", "rows", (F.col("rows") - F.col("present")).alias("null_count"), F.round(pct, 2).alias("null_pct"),
        F.when(missing | flat, "BLOCK").otherwise("PASS").alias("status"),
        F.when(missing, F.format_string("%s is left out, %.1f%% of it is missing and 20%% is the limit", F.col("column"), pct))
        .when(flat, F.format_string("%s is left out, all its values are the same", "column")).alias("reason"),
        rounded(F.col("numeric_share")).alias("numeric_share"),
        F.when(~missing & (F.col("numeric_share") > NUMERIC_TEXT_SHARE), F.format_string(
            "%s holds text, yet %.0f%% of it reads as numbers", F.col("column"),
            F.col("numeric_share") * 100)).alias("warning"),
        flat.alias("zero_variance"),
    )


def dataset_gates(df, combined=False, facts=None):
    """C1-C3 on the whole table, one row per gate in order; ``passed`` is null behind a gate that blocked."""
    limit = COMBINED_MISSING_PCT if combined else DATASET_MISSING_PCT
    columns = checked_columns(df) or df.columns
    if facts is None:
        nulls = [F.count(F.lit(1)) - F.count(col(c)) for c in columns]
        counted = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*nulls).alias("nulls"))
    else:
        counted = facts.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.collect_list(F.col("rows") - F.col("present")).alias("nulls"))
    wide = counted.select(
        "rows", (F.aggregate("nulls", F.lit(0).cast("bigint"), lambda a, b: a + b) * 100
                 / F.nullif(F.col("rows") * len(columns), F.lit(0))).alias("pct"),
        F.size(F.filter("nulls", lambda v: v / F.nullif(F.col("rows"), F.lit(0)) * 100 <= COLUMN_MISSING_PCT)).alias("kept"))
    enough = F.col("rows") >= MIN_ROWS
    dense = F.coalesce(F.col("pct"), F.lit(0.0)) <= limit
    some = F.col("kept") > 0

    def gate(at, name, value, threshold, passed, reached, blocked_text):
        ok = F.when(reached, passed)
        return F.struct(
            F.lit(at).alias("position"), F.lit(name).alias("gate"), F.round(value.cast("double"), 2).alias("value"),
            F.lit(float(threshold)).alias("threshold"), ok.alias("passed"),
            F.when(ok, "PASS").when(~ok, "BLOCK").otherwise("SKIPPED").alias("status"),
            F.when(~ok, blocked_text).alias("reason"))

    rows = [
        gate(0, "min_rows", F.col("rows"), MIN_ROWS, enough, F.lit(True), F.format_string(
            "%d rows are too few, an analysis takes 5", "rows")),
        gate(1, "dataset_missing", F.coalesce("pct", F.lit(0.0)), limit, dense, enough, F.format_string(
            f"%.1f%% of the cells are missing, more than {limit}%%",
            "pct")),
        gate(2, "columns_left", F.col("kept"), 1, some, enough & dense, F.lit(
            "no column has few enough missing values")),
    ]
    return wide.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def gate_trace(df, label, combined=False, facts=None):
    """The gates as trace rows (step, status, detail, values)."""
    gates = dataset_gates(df, combined, facts).select(
        F.col("position"), F.concat(F.lit("gate:"), "gate").alias("step"), "status",
        F.coalesce("reason", F.format_string("%s = %.2f, threshold %.2f", "gate", "value", "threshold")).alias("detail"),
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("threshold"),
                     F.col("threshold").cast("string")).alias("values"))
    columns = column_gates(df, facts=facts).select(
        F.lit(10).alias("position"), F.concat(F.lit("column:"), "column").alias("step"), "status",
        F.coalesce("reason", F.format_string("'%s': %.1f%%", "column", "null_pct")).alias("detail"),
        F.create_map(F.lit("null_pct"), F.col("null_pct").cast("string")).alias("values"))
    return union_all([gates, columns]).withColumn("label", F.lit(label))


def sign_checks(df):
    """Columns whose name says they cannot be negative."""
    named = [c for c in numeric_columns(df) if has_word(c, NON_NEGATIVE_WORDS_LONG)]
    if not named:
        return _no_checks(df)
    rows = per_column(numbers(df, named), named, lambda c: [
        F.count(col(c)).alias("n"), F.count(F.when(col(c) < 0, 1)).alias("bad")])
    bad = F.col("bad") > 0
    return rows.where("n > 0").select(
        F.lit("sign").alias("check"), "column", F.when(bad, "FAIL").otherwise("PASS").alias("status"),
        F.col("bad").alias("rows"),
        F.when(bad, F.format_string("%s should not be negative but is in %d rows", "column", "bad"))
        .otherwise(F.format_string("%s has no negative value", "column")).alias("detail"))


def percentage_checks(df):
    """Columns named like percentages stay within [0, 100]."""
    named = [c for c in numeric_columns(df) if has_word(c, PERCENTAGE_WORDS)]
    if not named:
        return _no_checks(df)
    rows = per_column(numbers(df, named), named, lambda c: [
        F.count(col(c)).alias("n"), F.count(F.when((col(c) < 0) | (col(c) > 100), 1)).alias("bad")])
    bad = F.col("bad") > 0
    return rows.where("n > 0").select(
        F.lit("percentage_range").alias("check"), "column", F.when(bad, "WARN").otherwise("PASS").alias("status"),
        F.col("bad").alias("rows"),
        F.when(bad, F.format_string("%s reads as a percentage but leaves 0 to 100; check its unit", "column"))
        .otherwise(F.format_string("%s stays within 0 to 100", "column")).alias("detail"))


def future_date_checks(df, as_of=None):
    """C11: dates after ``as_of`` (the current time by default)."""
    dates = date_columns(df)
    if not dates:
        return _no_checks(df)
    limit = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    rows = per_column(df, dates, lambda c: [F.count(F.when(col(c).cast("timestamp") > limit, 1)).alias("bad")])
    bad = F.col("bad") > 0
    return rows.select(
        F.lit("future_date").alias("check"), "column", F.when(bad, "WARN").otherwise("PASS").alias("status"),
        F.col("bad").alias("rows"),
        F.when(bad, F.format_string("%s has %d dates that are yet to come", "column", "bad"))
        .otherwise(F.format_string("%s has no date yet to come", "column")).alias("detail"))


def constant_checks(df):
    """Columns with more than five values that are all the same."""
    numeric = numeric_columns(df)
    if not numeric:
        return _no_checks(df)
    rows = per_column(numbers(df, numeric), numeric, lambda c: [
        F.count(col(c)).alias("n"), F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")])
    return rows.where("n > 5 AND lo = hi").select(
        F.lit("constant").alias("check"), "column", F.lit("WARN").alias("status"), F.col("n").alias("rows"),
        F.format_string("%s is %.4f in every row and tells nothing", "column", "lo").alias("detail"))


def residual_null_check(df):
    """Grade of the share of cells still null after cleaning."""
    nulls = sum((F.count(F.lit(1)) - F.count(col(c)) for c in df.columns), F.lit(0))
    wide = df.agg(nulls.cast("bigint").alias("rows"),
                  (nulls / F.nullif(F.count(F.lit(1)) * len(df.columns), F.lit(0)) * 100).alias("pct"))
    pct = F.coalesce("pct", F.lit(0.0))
    return wide.select(
        F.lit("residual_nulls").alias("check"), F.lit("ALL").alias("column"),
        F.when(pct == 0, "PASS").when(pct < 5, "WARN").otherwise("FAIL").alias("status"), "rows",
        F.when(pct == 0, F.lit("no cell is empty after cleaning"))
        .when(pct < 5, F.format_string("%.1f%% of the cells remain empty", pct))
        .otherwise(F.format_string("%.1f%% of the cells are empty; look at them first", pct)).alias("detail"))


def _no_checks(df):
    schema = "check string, column string, status string, rows bigint, detail string"
    return df.sparkSession.createDataFrame([], schema)


def quality_checks(df, as_of=None):
    """C8, C10-C13 together. A constant column counts as a failure in the overall verdict."""
    return union_all([sign_checks(df), percentage_checks(df), future_date_checks(df, as_of), constant_checks(df),
                      residual_null_check(df)])


def overall_verdict(checks):
    """CLEAN unless some check failed."""
    failed = (F.col("status") == "FAIL") | (F.col("check") == "constant")
    return checks.agg(
        F.count(F.when(failed, 1)).alias("failures"),
        F.count(F.when((F.col("status") == "WARN") & ~failed, 1)).alias("warnings"),
        F.count(F.when(F.col("status") == "PASS", 1)).alias("passed"),
        F.when(F.max(failed.cast("int")) == 1, "HAS ISSUES").otherwise("CLEAN").alias("overall"))


def zero_inflation(df, columns=None, share=0.5):
    """Columns whose non-null values are mostly zero."""
    columns = list(columns or numeric_columns(df))
    rows = per_column(numbers(df, columns), columns, lambda c: [
        F.avg((col(c) == 0).cast("int")).alias("share"), F.count(col(c)).alias("n")])
    return rows.where(F.col("share") > share).select("column", "n", F.round(F.col("share") * 100, 1).alias("zero_pct"))
