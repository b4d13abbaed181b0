"""The table answers a question can ask for, as operators that return DataFrames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text_rules
from plumbline.functions.expr import col, finite, numbers, numeric_columns, rounded, text_columns
from plumbline.operators.profile import distinct_counts
from plumbline.operators.quantiles import quantiles
from plumbline.operators.ranks import medians
from plumbline.operators.stats import facts, iqr_outliers, per_column

# Aggregates by name. Medians are exact; ``group_agg`` has its own plan for them (see there).
AGGREGATES = {
    "mean": F.avg, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "max": F.max, "min": F.min,
    "count": lambda v: F.count(v).cast("double"), "std": F.stddev_samp, "var": F.var_samp,
    "range": lambda v: F.max(v) - F.min(v),
}


def group_agg(df, value, by, how="mean", k=20, descending=True):
    """One aggregate of a number by a category, best (or worst) groups first."""
    key, v = col(by).cast("string").alias("group"), finite(col(value)).alias("v")
    rows = df.select(key, v).where(F.col("group").isNotNull())
    grouped = medians(rows, ["group"]) if how == "median" else rows.groupBy("group").agg(AGGREGATES[how](F.col("v")).alias("value"))
    named = grouped.where("value IS NOT NULL").select("group", rounded(F.col("value"), 3).alias("value"), F.col("value").alias("_v"))
    return named.orderBy(F.desc("_v") if descending else F.asc("_v"), "group").drop("_v").limit(k)


def single_agg(df, value, how="mean"):
    """One number with how many values it used and how many nulls it left out."""
    v = finite(col(value))
    used = [F.count(v).alias("used"), (F.count(F.lit(1)) - F.count(v)).alias("nulls_excluded")]
    if how == "median":
        median = quantiles(df, [value], [0.5])[value][0]
        return df.agg(F.lit(median).cast("double").alias("value"), *used).select(
            rounded(F.col("value")).alias("value"), "used", "nulls_excluded")
    return df.agg(AGGREGATES[how](v).alias("value"), *used).select(
        rounded(F.col("value")).alias("value"), "used", "nulls_excluded")


def all_columns_agg(df, how="mean", columns=None, k=None):
    """One aggregate over each numeric column (the first k if none are named); columns without a result drop out."""
    columns = list(columns or numeric_columns(df)[:k])
    medians = quantiles(df, columns, [0.5]) if how == "median" else {}

    def measure(c):
        value = F.lit(medians[c][0]).cast("double") if how == "median" else AGGREGATES[how](col(c))
        return [value.alias("v"), F.count(col(c)).alias("n")]

    return per_column(numbers(df, columns), columns, measure).where("v IS NOT NULL").select(
        "column", rounded(F.col("v"), 3).alias("value"), "n")


def unique_counts(df, columns=None, k=None):
    """G20."""
    return distinct_counts(df, list(columns or df.columns[:k]))


def value_shares(df, column, k=20, digits=2):
    """The most frequent values with their share of all rows, rows without a value included."""
    counted = df.groupBy(col(column).cast("string").alias("value")).count()
    total = counted.agg(F.sum("count").alias("t")).scalar()
    return counted.where("value IS NOT NULL").select(
        "value", "count", F.round(F.col("count") / total * 100, digits).alias("pct")).orderBy(F.desc("count"), "value").limit(k)


def record_count(df):
    """G23 without a category."""
    return df.agg(F.count(F.lit(1)).alias("records"))


def summary_table(df, columns=None, max_columns=None):
    """Count, mean, median, std, min, max and sum for columns with two or more values."""
    columns = list(columns or numeric_columns(df)[:max_columns])
    medians = quantiles(df, columns, [0.5])
    base = facts(df, columns).where("n >= 2")
    median = _per_name({c: v[0] for c, v in medians.items()})
    return base.select(
        "column", F.col("n").alias("count"), rounded(F.col("mean"), 3).alias("mean"), rounded(median, 3).alias("median"),
        rounded(F.col("std"), 3).alias("std"), rounded(F.col("min"), 3).alias("min"), rounded(F.col("max"), 3).alias("max"),
        rounded(F.col("sum"), 2).alias("sum"))


def _per_name(values, name="column"):
    """A driver-side value per column name as an expression over the name column."""
    out = F.lit(None).cast("double")
    for c, v in values.items():
        out = F.when(F.col(name) == c, F.lit(v).cast("double")).otherwise(out)
    return out


def comparison(df, value, categories=None, k=15, all_categories=False):
    """Mean by the first category; with ``all_categories``, or where they are named, by each."""
    categories = list(categories or text_columns(df)[:None if all_categories else 1])
    long = df.select(finite(col(value)).alias("v"), *[col(c).cast("string").alias(c) for c in categories]).unpivot(
        ["v"], categories, "category", "group").where(F.col("group").isNotNull())
    means = long.groupBy("category", "group").agg(F.avg("v").alias("m")).where("m IS NOT NULL")
    order = Window.partitionBy("category").orderBy(F.desc("m"), "group")
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "category", "group", rounded(F.col("m"), 3).alias("value"), "rank")


def measures(df, numeric=None, categories=None, k=None):
    """Measures with their value and a BI formula; average, total, max, min, then distinct counts."""
    numeric, categories = list(numeric or numeric_columns(df)), list(categories or text_columns(df))
    forms = (("Avg", "mean", "AVERAGE"), ("Total", "sum", "SUM"), ("Max", "max", "MAX"), ("Min", "min", "MIN"))
    base = per_column(numbers(df, numeric), numeric, lambda c: [F.count(col(c)).alias("n")] + [
        AGGREGATES[how](col(c)).alias(how) for _, how, _ in forms])
    at = _per_name({c: float(i) for i, c in enumerate(numeric)}).cast("int")
    listed = base.where("n >= 2").select("column", at.alias("at"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("form"), F.concat(F.lit(f"{word} "), "column").alias("name"), F.lit(how).alias("fn"),
                 rounded(F.when(F.col(how) != 0, F.col(how)), 3).alias("value"),
                 F.format_string(f"{word}_%s = {function}(Table[%s])", "column", "column").alias("formula"))
        for i, (word, how, function) in enumerate(forms)])).alias("m")).select("at", "m.*")
    if categories:
        place = _per_name({c: float(i) for i, c in enumerate(categories)}).cast("int") + len(numeric)
        counted = distinct_counts(df, categories).select(
            place.alias("at"), F.lit(0).alias("form"), F.concat(F.lit("Count "), "column").alias("name"),
            F.lit("count").alias("fn"), F.col("distinct").cast("double").alias("value"),
            F.format_string("Count_%s = DISTINCTCOUNT(Table[%s])", "column", "column").alias("formula"))
        listed = listed.unionByName(counted)
    ordered = listed.orderBy("at", "form")
    return (ordered if k is None else ordered.limit(k)).drop("at", "form")


def measure_dictionary(df, columns, profit="Profit", profit_pct="Profit_Pct"):
    """Sum, mean, median, min, max and count of every measure; profit columns keep the parts they report."""
    extra = [c for c in (profit, profit_pct) if c in df.columns and c not in columns]
    names = list(columns) + extra
    medians = _per_name({c: v[0] for c, v in quantiles(df, names, [0.5]).items()})
    name = F.col("column")
    no_sum, no_median = name == profit_pct, name == profit
    return facts(df, names).where("n > 0").select(
        "column", F.when(~no_sum, rounded(F.col("sum"), 2)).alias("sum"), rounded(F.col("mean")).alias("mean"),
        F.when(~no_median, rounded(medians)).alias("median"), F.when(~no_sum, rounded(F.col("min"))).alias("min"),
        F.when(~no_sum, rounded(F.col("max"))).alias("max"), F.col("n").alias("count"))


def distribution_answer(df, column, min_rows=5):
    """One row of facts, with normality tested over all rows by the third and fourth moment (eight values or more)."""
    q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    base = facts(df, [column], lambda c, d, n: [F.count(F.when(
        (col(c) < F.lit(q1 - 1.5 * (q3 - q1))) | (col(c) > F.lit(q3 + 1.5 * (q3 - q1))), 1)
    ).alias("outliers")] if q1 is not None else [F.lit(0).alias("outliers")])
    number = lambda v: rounded(F.lit(v).cast("double"), 3)
    tail = F.when(F.col("n") >= 8, F.exp(-F.col("n") / 12 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)))
    return base.where(F.col("n") >= min_rows).select(
        "column", rounded(F.col("mean"), 3).alias("mean"), number(median).alias("median"),
        rounded(F.col("std"), 3).alias("std"), rounded(F.col("min"), 3).alias("min"), rounded(F.col("max"), 3).alias("max"),
        number(q1).alias("q1"), number(q3).alias("q3"),
        number(None if q1 is None else q3 - q1).alias("iqr"), rounded(F.col("skewness"), 3).alias("skewness"),
        skew_side(F.col("skewness")).alias("shape"), "outliers",
        F.round(F.col("outliers") / F.col("n") * 100, 1).alias("outlier_pct"), rounded(tail, 6).alias("normal_p"),
        (tail > 0.05).alias("is_normal"))


def skew_side(s):
    return F.when(s > 0.5, "Right-skewed").when(s < -0.5, "Left-skewed").otherwise("Approximately symmetric")


def outlier_list(df, columns=None, order_by=(), max_columns=None):
    """Columns with outliers, most first, with three examples in row order."""
    columns = list(columns or numeric_columns(df)[:max_columns])
    found = iqr_outliers(df, columns, order_by, k=3).where("count > 0")
    return found.select(
        "column", F.col("count").alias("outliers"), F.round("pct", 1).alias("pct"), *(["extremes"] if order_by else [])
    ).orderBy(F.desc("outliers"), "column")


def column_summary(df, column):
    """Describe-style metric and value rows of one column."""
    q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    base = facts(df, [column]).where("n >= 2")
    lines = [("Count", F.col("n").cast("double")), ("Mean", F.col("mean")), ("Median", F.lit(median).cast("double")),
             ("Std Dev", F.col("std")), ("Min", F.col("min")), ("Max", F.col("max")), ("Sum", F.col("sum")),
             ("Q25", F.lit(q1).cast("double")), ("Q75", F.lit(q3).cast("double"))]
    return base.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), rounded(v, 3).alias("value"))
        for i, (m, v) in enumerate(lines)])).alias("r")).select("r.*").where("value IS NOT NULL")


def quick_stats(df, columns=None, max_columns=None):
    """Mean, min, max and count of the numeric columns."""
    return facts(df, list(columns or numeric_columns(df)[:max_columns])).where("n >= 2").select(
        "column", rounded(F.col("mean"), 2).alias("mean"), rounded(F.col("min"), 2).alias("min"),
        rounded(F.col("max"), 2).alias("max"), F.col("n").alias("count"))


def general_stats(df, column):
    """G28, the older fallback: mean, median, min and max of one column."""
    median = quantiles(df, [column], [0.5])[column][0]
    return facts(df, [column]).select(
        "column", rounded(F.col("mean"), 3).alias("mean"), rounded(F.lit(median).cast("double"), 3).alias("median"),
        rounded(F.col("min"), 3).alias("min"), rounded(F.col("max"), 3).alias("max"))


def rank_values(df, value, k=10, ascending=False, most=None):
    """The k largest (or smallest) values, numbered after the limit."""
    k = k if most is None else min(k, most)
    v = finite(col(value))
    top = df.where(v.isNotNull()).select(rounded(v).alias("value"))
    order = F.asc("value") if ascending else F.desc("value")
    return _numbered(top.orderBy(order).limit(k), [order])


def rank_categories(df, category, k=10, ascending=False, most=None):
    """Categories by count."""
    k = k if most is None else min(k, most)
    counted = df.where(col(category).isNotNull()).groupBy(col(category).cast("string").alias("value")).count()
    order = [F.asc("count") if ascending else F.desc("count"), F.asc("value")]
    return _numbered(counted.orderBy(*order).limit(k), order)


def rank_groups(df, value, by, k=10, ascending=False, most=None):
    """Groups by mean."""
    k = k if most is None else min(k, most)
    means = df.where(col(by).isNotNull()).groupBy(col(by).cast("string").alias("group")).agg(
        F.avg(finite(col(value))).alias("m")).where("m IS NOT NULL")
    order = [F.asc("m") if ascending else F.desc("m"), F.asc("group")]
    return _numbered(means.orderBy(*order).limit(k), order).select("rank", "group", rounded(F.col("m"), 3).alias("value"))


def _numbered(limited, order):
    """Ranks over a result that a limit has already bounded."""
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def tag_questions(df, text="text", mode="reference"):
    """Q1-Q3 on a text column: intent, aggregation word, requested number, direction."""
    t, lowered = col(text), F.col("_lowered")
    return df.withColumn("_lowered", F.lower(t)).withColumns({
        "intent": text_rules.intent(t, mode, lowered), "aggregation": text_rules.aggregation(t, lowered=lowered),
        "top_n": text_rules.top_n(t), "ascending": text_rules.ascending(t, lowered)}).drop("_lowered")
