"""Chart-ready aggregates. Limits are arguments; None means all."""

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.expr import col, finite, rounded
from plumbline.operators.order import every_kth
from plumbline.operators.quantiles import quantiles
from plumbline.operators.stats import facts, frequencies, top_per_column

# What a bar whose column or values are really dates or codes looks like.
DATE_NAME_PATTERN = r"(?i)date|time|datetime"
YEAR_VALUE_PATTERN = r"^\d{4}"
CODE_VALUE_PATTERN = r"^[A-Z]\d{5,}"


def _counts_with_rows(df, columns):
    """Value counts per column and the table's row count (every column counts every row once)."""
    counted = frequencies(df, columns)
    return counted, df.agg(F.count(F.lit(1)).alias("n")).scalar()


def bars(df, columns, k=12, max_columns=None, width=None, hide=False):
    """K1: top values per category with shares of all rows."""
    columns = list(columns)[:max_columns]
    counted, rows = _counts_with_rows(df, columns)
    top = top_per_column(counted.where("value IS NOT NULL"), k)
    out = top.select("column", F.col("rank").cast("int").alias("rank"), _short("value", width).alias("name"), "count",
                     F.round(F.col("count") / rows * 100, 1).alias("pct"))
    return visible_bars(out) if hide else out


def _short(column, width):
    return F.col(column) if width is None else F.left(column, F.lit(width))


def visible_bars(bar_rows):
    """K1: drop bars of date-like columns, and bars whose first value is a year or a code."""
    first = F.first_value("name").over(Window.partitionBy("column").orderBy("rank"))
    odd = first.rlike(YEAR_VALUE_PATTERN) | first.rlike(CODE_VALUE_PATTERN)
    return bar_rows.where(~F.col("column").rlike(DATE_NAME_PATTERN)).withColumn("_odd", odd).where("NOT _odd").drop("_odd")


def bar_captions(bar_rows):
    """K7: top and bottom value of each bar chart and the top's share of what is shown."""
    pair = F.struct("count", (-F.col("rank")).alias("r"))
    return bar_rows.groupBy("column").agg(
        F.max_by("name", pair).alias("top"), F.max("count").alias("top_count"), F.min_by("name", pair).alias("bottom"),
        F.min("count").alias("bottom_count"), F.round(F.max("count") / F.sum("count") * 100, 1).alias("top_pct"),
        F.count(F.lit(1)).alias("categories"))


def scale_groups(df, columns, per_group=None, base=None):
    """K2: columns grouped by the order of magnitude of their mean."""
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    scale = F.floor(F.log10(F.greatest(F.abs("mean"), F.lit(0.01)) + 1)).cast("int")
    base = facts(df, columns) if base is None else base
    placed = base.where("n > 0").select("column", scale.alias("scale"), order.alias("position"))
    rank = F.row_number().over(Window.partitionBy("scale").orderBy("position"))
    ranked = placed.withColumn("rank", rank).select("scale", "column", "rank")
    return ranked if per_group is None else ranked.where(F.col("rank") <= per_group)


def trend_points(df, columns, order_by, date=None, points=80, base=None):
    """K3: the systematic sample in long form with its scale group; x is the first date or the ordinal."""
    groups = scale_groups(df, columns, base=base)
    step = max(1, df.count() // points)
    x = (F.date_format(col(date).cast("timestamp_ntz"), "yyyy-MM-dd") if date
         else F.expr(f"_rn div {step}").cast("string"))
    needed = list(dict.fromkeys([*order_by, *columns, *([date] if date else [])]))
    sampled = every_kth(df.select(*[col(c) for c in needed]), order_by, step).select(
        F.expr(f"_rn div {step}").alias("point"), x.alias("x"), *[rounded(col(c)).alias(c) for c in columns])
    return sampled.unpivot(["point", "x"], columns, "column", "value").join(F.broadcast(groups.drop("rank")), "column")


def scatter_pairs(columns, most=None):
    """K4: pairs of numeric columns."""
    return list(combinations(list(columns), 2))[:most]


def scatter(df, x, y, order_by=(), k=None):
    """K4: the complete pairs, or the first k of them in row order."""
    pairs = df.where(finite(col(x)).isNotNull() & finite(col(y)).isNotNull())
    if k is not None:
        pairs = pairs.orderBy(*[col(o) for o in order_by]).limit(k)
    return pairs.select(rounded(col(x)).alias("x"), rounded(col(y)).alias("y"))


def pie(df, columns, least=2, most=8, width=None):
    """K5: shares of the first category that has two to eight values."""
    columns = list(columns)
    counted, rows = _counts_with_rows(df, columns)
    present = counted.where("value IS NOT NULL")
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    # The eight-value limit keeps this to a few rows per column before anything is compared.
    top = top_per_column(present, most + 1).withColumn("position", position)
    sized = top.withColumn("values", F.count(F.lit(1)).over(Window.partitionBy("column"))).where(
        (F.col("values") >= least) & (F.col("values") <= most))
    chosen = sized.where(F.col("position") == sized.agg(F.min("position").alias("p")).scalar())
    return chosen.select("column", _short("value", width).alias("name"), "count",
                         F.round(F.col("count") / rows * 100, 1).alias("pct"))


def boxes(df, columns, max_columns=None, min_rows=4, mode="auto", found=None, base=None):
    """K6: five numbers and the mean, with a hint which tail pulls the mean."""
    columns = list(columns)[:max_columns]
    found = quantiles(df, columns, [0.25, 0.5, 0.75], mode) if found is None else found
    pick = lambda i: F.create_map(*[x for c in columns for x in (
        F.lit(c), F.lit(found[c][i]).cast("double"))])[F.col("column")]
    base = facts(df, columns) if base is None else base
    return base.where(F.col("n") >= min_rows).select(
        "column", rounded(F.col("min")).alias("min"), rounded(pick(0)).alias("q1"), rounded(pick(1)).alias("median"),
        rounded(F.col("mean")).alias("mean"), rounded(pick(2)).alias("q3"), rounded(F.col("max")).alias("max"),
        F.when(F.col("mean") > pick(1), "right").otherwise("left").alias("skew"))
