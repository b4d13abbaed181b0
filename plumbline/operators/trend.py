"""Linear trend of a column over its row order, and short forecasts from the fitted line."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.expr import col, numbers, numeric_columns, ratio, rounded
from plumbline.functions.special import p_of_r
from plumbline.operators.order import with_row_index
from plumbline.operators.stats import facts

X = "_x_"


def index_columns(df, columns, order_by):
    """Clean values plus, per column, the index 0..n-1 over its non-null rows."""
    keys = {k: f"_key{i}" for i, k in enumerate(order_by)}
    keyed = df.withColumns({new: col(k) for k, new in keys.items()})
    clean = numbers(keyed, columns, list(keys.values()))
    return with_row_index(clean, list(keys.values()), valid={X + c: c for c in columns})


def line_measures(c, d, n):
    """Sums over the deviations of the value and of its index (whose mean is known from n)."""
    x = col(X + c)
    return [F.sum((x - F.lit((n - 1) / 2)) * d).alias("sxy"), F.sum(F.when(x == 0, col(c))).alias("first_value"),
            F.sum(F.when(x == F.lit(n - 1), col(c))).alias("last_value")]


def line_facts(df, columns, order_by, indexed=None):
    """Moments and unrounded line of each column: slope, r (0 for a constant column), errors, change."""
    columns = list(columns)
    indexed = index_columns(df, columns, order_by) if indexed is None else indexed
    n = F.col("n").cast("double")
    slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    r = F.when((n >= 2) & (F.col("syy") == 0), F.lit(0.0)).otherwise(
        F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0)))
    residual = F.greatest(F.lit(0.0), (1 - F.col("r") * F.col("r")) * F.col("syy"))
    base = facts(indexed, columns, line_measures, [X + c for c in columns]).withColumns({
        "sxx": n * (n * n - 1) / 12, "syy": F.col("squares")})
    return base.withColumns({
        "slope": F.when((n >= 2) & (F.col("syy") == 0), F.lit(0.0)).otherwise(slope),
        "r": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)),
    }).withColumns({
        "intercept": F.col("mean") - F.col("slope") * (n - 1) / 2,
        "slope_se": F.when(n == 2, F.lit(0.0)).otherwise(F.sqrt(residual / F.nullif(F.col("sxx") * (n - 2), F.lit(0.0)))),
        "residual_se": F.sqrt(residual / F.nullif(n - 2, F.lit(0.0))),
        "pct_change": F.coalesce(
            ratio(F.col("last_value") - F.col("first_value"), F.abs("first_value")), F.lit(0.0)),
    })


def direction(slope):
    return F.when(slope > 0, "↗ Increasing").when(slope < 0, "↘ Decreasing").otherwise("→ Flat")


def first_last(df, columns=None, order_by=()):
    """First and last non-null value in row order and the relative change between them."""
    lines = line_facts(df, columns or numeric_columns(df), order_by)
    return lines.select("column", "n", rounded(F.col("first_value")).alias("first_value"),
                        rounded(F.col("last_value")).alias("last_value"),
                        rounded(F.col("pct_change") * 100, 2).alias("pct_change"))


def trend_fit(df, columns=None, order_by=(), min_rows=10, lines=None, with_p=True):
    """The fitted line of each column with enough rows."""
    lines = line_facts(df, columns or numeric_columns(df), order_by) if lines is None else lines
    lines = lines.where((F.col("n") >= min_rows) & F.col("slope").isNotNull())
    out = [
        "column", "n", rounded(F.col("slope"), 6).alias("slope"), rounded(F.col("intercept")).alias("intercept"),
        rounded(F.col("r")).alias("r"), rounded(F.col("r") * F.col("r")).alias("r2"),
        rounded(F.col("slope_se"), 6).alias("se"), direction(F.col("slope")).alias("trend"),
    ]
    if with_p:
        lines = lines.withColumn("p", p_of_r(F.col("r"), F.col("n").cast("double")))
        out += [rounded(F.col("p"), 6).alias("p_value"), F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant")]
    return lines.select(*out)


def forecast(df, columns=None, order_by=(), steps=10, min_rows=10, band="slope", lines=None):
    """R2: point forecast and band for the next steps.

    ``band='slope'`` scales by the slope's standard error, as the reports this follows do; ``'residual'`` by
    the residual standard error, which is the textbook prediction band.
    """
    lines = line_facts(df, columns or numeric_columns(df), order_by) if lines is None else lines
    n = F.col("n")
    ahead = lines.where((n >= min_rows) & F.col("slope").isNotNull()).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x = n + F.col("i") - 1
    value = F.col("intercept") + F.col("slope") * x
    sxx = F.when(F.col("sxx") == 0, F.lit(1.0)).otherwise(F.col("sxx"))
    error = F.col(f"{band}_se") * F.sqrt(1 + 1 / n + F.pow(x - (n - 1) / 2, 2) / sxx)
    return ahead.select(
        "column", F.col("i").alias("ahead"), (n + F.col("i")).alias("step"), rounded(value).alias("value"),
        rounded(value - 1.96 * error).alias("lo"), rounded(value + 1.96 * error).alias("hi"),
        rounded(F.col("intercept") + F.col("slope") * (n - 1)).alias("last_fitted"))


def forecast_table(forecasts):
    """Width of the band and the direction against the step before (the last fitted value for step 1)."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("column").orderBy("step")), F.col("last_fitted"))
    return forecasts.select(
        "column", "step", "value", "lo", "hi", F.round(F.col("hi") - F.col("lo"), 3).alias("width"),
        F.when(F.col("value") > before, "↑").when(F.col("value") < before, "↓").otherwise("→").alias("direction"))


def fitted(df, column, order_by, min_rows=10):
    """Every non-null value with its index and fitted value; the line enters as constants."""
    indexed = index_columns(df, [column], order_by)
    line = line_facts(df, [column], order_by, indexed).first()
    enough = line["n"] >= min_rows and line["slope"] is not None
    value = (F.lit(line["intercept"]) + F.lit(line["slope"]) * col(X + column)) if enough else F.lit(None).cast("double")
    keys = [F.col(f"_key{i}").alias(k) for i, k in enumerate(order_by)]
    return indexed.where(col(X + column).isNotNull()).select(
        *keys, col(X + column).alias("x"), col(column).alias("value"), rounded(value).alias("fitted"))


def trend_answer(df, column, order_by, steps=5, min_rows=5):
    """One row per forecast step with the line's facts repeated."""
    lines = line_facts(df, [column], order_by)
    n = F.col("n")
    kept = lines.where((n >= min_rows) & F.col("slope").isNotNull()).withColumn(
        "p", p_of_r(F.col("r"), n.cast("double")))
    ahead = kept.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return ahead.select(
        "column", F.when(F.col("slope") > 0, "↗ Increasing").otherwise("↘ Decreasing").alias("trend"),
        rounded(F.col("slope"), 6).alias("slope"), rounded(F.col("r") * F.col("r")).alias("r2"),
        rounded(F.col("p"), 6).alias("p_value"), (F.col("p") < 0.05).alias("significant"),
        (n + F.col("i")).alias("step"),
        rounded(F.col("intercept") + F.col("slope") * (n + F.col("i") - 1), 3).alias("value"))
