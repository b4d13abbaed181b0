"""Cleaning steps. Each has a report of what it changes, so a cleaned table always comes with its log."""

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expr import as_number, columns_of, col, finite, numeric_columns, rounded, strip, text_columns
from plumbline.operators.profile import null_counts
from plumbline.operators.quantiles import quantiles
from plumbline.operators.stats import frequencies, per_column, union_all

# Texts that stand for a boolean, and the two missing-share limits of the older cleaning order.
BOOLEAN_VALUES = {"yes": 1, "y": 1, "true": 1, "1": 1, "no": 0, "n": 0, "false": 0, "0": 0}
IMPUTE_LIMIT_PCT = 30.0
INTEGER_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def sanitise(df):
    """NaN and the infinities become null in every floating column."""
    floating = columns_of(df, (T.FloatType, T.DoubleType))
    return df.withColumns({c: finite(col(c)) for c in floating})


def trim_strings(df, skip=()):
    """Strip white space of every kind around text values."""
    return df.withColumns({c: strip(col(c)) for c in text_columns(df, skip)})


def trim_report(df, skip=()):
    """How many values of each text column change."""
    rows = per_column(df, text_columns(df, skip), lambda c: [
        F.count(F.when(col(c) != strip(col(c)), 1)).alias("changed")])
    return rows.where("changed > 0").select("column", "changed")


def drop_empty_rows(df):
    """D2."""
    return df.dropna("all")


def dedupe(df):
    """D3: one of each set of identical rows. Copies meet inside each task before the shuffle."""
    return df.distinct()


def dedupe_report(df):
    """D3: rows before, after and removed, in one pass."""
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def missing_shares(df, columns):
    """{column: (rows, nulls)} for columns that have nulls."""
    found = null_counts(df, columns).where("null_count > 0").collect()
    return {r["column"]: (r["rows"], r["null_count"]) for r in found}


def modes(df, columns):
    """{column: most frequent value, smallest on ties}; text columns share one job."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    best = F.min(F.struct((-F.col("count")).alias("c"), F.col("value").alias("v")))["v"].alias("mode")
    found = {}
    if texts:
        counted = frequencies(df, texts).where("value IS NOT NULL")
        found.update({r["column"]: r["mode"] for r in counted.groupBy("column").agg(best).collect()})
    for c in columns:
        if c not in texts:
            counted = df.where(col(c).isNotNull()).groupBy(col(c).alias("value")).count()
            found[c] = counted.agg(best).first()["mode"]
    return found


def fill_plan(df, columns=None, limit_pct=None, mode="auto"):
    """[(column, method, value, filled, missing_pct)] for columns with nulls: median of numbers, else mode.

    With ``limit_pct`` only columns missing at most that share are filled. An all-null column stays as it is.
    """
    missing = missing_shares(df, columns or df.columns)
    wanted = [c for c in (columns or df.columns) if c in missing and (
        limit_pct is None or missing[c][1] / missing[c][0] * 100 <= limit_pct)]
    numeric = [c for c in wanted if c in numeric_columns(df)]
    medians = {c: v[0] for c, v in quantiles(df, numeric, [0.5], mode).items()}
    common = modes(df, [c for c in wanted if c not in numeric])
    plan = []
    for c in wanted:
        method, value = ("median", medians[c]) if c in medians else ("mode", common.get(c))
        if value is not None:
            rows, nulls = missing[c]
            plan.append((c, method, value, nulls, nulls / rows * 100))
    return plan


def _filled(df, c, value):
    """The column with its nulls (and NaN) replaced; every other value stays as it is.

    An integer column keeps its type unless the value has a fraction; then it becomes a decimal that holds both, as
    does a decimal column whose scale the value exceeds.
    """
    kind = df.schema[c].dataType
    if c not in numeric_columns(df):
        return F.coalesce(col(c), F.lit(value))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(finite(col(c)), F.lit(float(value)).cast(kind))
    exact = Decimal(repr(float(value)))
    needed = max(0, -exact.normalize().as_tuple().exponent)
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    if needed > scale:
        whole = kind.precision - kind.scale if isinstance(kind, T.DecimalType) else INTEGER_DIGITS[type(kind)]
        kind = T.DecimalType(38 if whole + needed > 38 else whole + needed, min(needed, 38 - whole))
    return F.coalesce(col(c).cast(kind), F.lit(str(exact)).cast(kind))


def apply_fill(df, plan):
    """Fill nulls from a plan."""
    return df.withColumns({c: _filled(df, c, v) for c, _, v, _, _ in plan})


def impute(df, columns=None, limit_pct=None, mode="auto"):
    return apply_fill(df, fill_plan(df, columns, limit_pct, mode))


def impute_report(df, columns=None, limit_pct=None, mode="auto"):
    """What would be filled with what; counts are taken before filling."""
    rows = [(c, m, str(v) if m == "mode" else f"{v:.4f}", n, round(p, 2))
            for c, m, v, n, p in fill_plan(df, columns, limit_pct, mode)]
    schema = "column string, method string, value string, filled bigint, missing_pct double"
    return df.sparkSession.createDataFrame(rows, schema)


def high_missing(df, limit_pct=IMPUTE_LIMIT_PCT):
    """Columns missing more than the limit; they are kept and not filled."""
    return null_counts(df).select(
        "column", "null_count", F.round(F.col("null_count") / F.col("rows") * 100, 2).alias("missing_pct")
    ).where(F.col("null_count") / F.col("rows") * 100 > limit_pct)


def boolean_columns(df):
    """Text columns whose every value stands for a boolean (and that have one at all)."""
    texts = text_columns(df)
    if not texts:
        return []
    known = list(BOOLEAN_VALUES)
    rows = per_column(df, texts, lambda c: [
        F.count(col(c)).alias("n"), F.bool_and(F.lower(col(c)).isin(known)).alias("boolean")])
    return [r["column"] for r in rows.where("n > 0 AND boolean").collect()]


def standardise_booleans(df, columns=None):
    """yes/no/true/false/y/n/1/0 in any case become 1 or 0."""
    ones = [k for k, v in BOOLEAN_VALUES.items() if v]
    zeros = [k for k, v in BOOLEAN_VALUES.items() if not v]
    columns = boolean_columns(df) if columns is None else columns
    return df.withColumns({
        c: F.when(F.lower(col(c)).isin(ones), 1).when(F.lower(col(c)).isin(zeros), 0) for c in columns})


def coerce_numbers(df, columns):
    """Text to double; what does not parse becomes null."""
    return df.withColumns({c: as_number(df, c) for c in columns})


def complete_rows(df, columns):
    """Rows where all the given columns hold a value."""
    return df.dropna("any", subset=list(columns))


def clean(df, blocked=(), mode="auto", materialise=lambda d: d):
    """Trim, drop copies (over all columns), then fill every kept column: (cleaned, log).

    The fill values need the deduplicated table several times; ``materialise`` may store it (see plans).
    """
    trimmed = trim_report(df, blocked).select(
        F.lit("Clean:Whitespace").alias("step"), "column", F.col("changed").alias("rows"), F.lit("stripped").alias("detail"))
    tidy = trim_strings(sanitise(df), blocked)
    removed = dedupe_report(tidy).where("removed > 0").select(
        F.lit("Clean:Duplicates").alias("step"), F.lit("ALL").alias("column"), F.col("removed").alias("rows"),
        F.lit("identical rows dropped").alias("detail"))
    unique = materialise(dedupe(tidy))
    plan = fill_plan(unique, [c for c in unique.columns if c not in blocked], mode=mode)
    filled = _fill_log(df, plan)
    return apply_fill(unique, plan), union_all([trimmed, removed, filled])


def clean_classic(df, mode="auto", materialise=lambda d: d):
    """The older order: trim, drop empty rows, drop copies, flag or fill by the 30 % limit, booleans."""
    trimmed = trim_report(df).select(
        F.lit("Strip whitespace").alias("step"), "column", F.col("changed").alias("rows"), F.lit("stripped").alias("detail"))
    tidy = trim_strings(sanitise(df))
    kept = drop_empty_rows(tidy)
    empty = tidy.agg((F.count(F.lit(1)) - F.count(F.when(F.coalesce(
        *[col(c).cast("string") for c in tidy.columns]).isNotNull(), 1))).alias("rows")).where("rows > 0").select(
        F.lit("Remove empty rows").alias("step"), F.lit("ALL").alias("column"), "rows",
        F.lit("rows without any value dropped").alias("detail"))
    removed = dedupe_report(kept).where("removed > 0").select(
        F.lit("Remove duplicates").alias("step"), F.lit("ALL").alias("column"), F.col("removed").alias("rows"),
        F.lit("identical rows dropped").alias("detail"))
    unique = materialise(dedupe(kept))
    flagged = high_missing(unique).select(
        F.lit("High missingness flag").alias("step"), "column", F.col("null_count").alias("rows"),
        F.format_string("%.1f%% missing, left unfilled", "missing_pct").alias("detail"))
    plan = fill_plan(unique, limit_pct=IMPUTE_LIMIT_PCT, mode=mode)
    filled = apply_fill(unique, plan)
    booleans = boolean_columns(filled)
    turned = df.sparkSession.createDataFrame(
        [("Standardize boolean", c, None, "words for yes and no became 1 and 0") for c in booleans],
        "step string, column string, rows bigint, detail string")
    log = union_all([trimmed, empty, removed, flagged, _fill_log(df, plan), turned])
    return standardise_booleans(filled, booleans), log


def _fill_log(df, plan):
    rows = [("Clean:Impute", c, n, f"filled with {m}={v:.4f}" if m == "median" else f"filled with {m}='{v}'")
            for c, m, v, n, _ in plan]
    return df.sparkSession.createDataFrame(rows, "step string, column string, rows bigint, detail string")


def rounded_table(df, digits=4):
    """Every floating column rounded for output."""
    return df.withColumns({c: rounded(col(c), digits) for c in columns_of(df, (T.FloatType, T.DoubleType))})
