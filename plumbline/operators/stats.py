"""Descriptive statistics: all metrics of all columns come out of one wide aggregate, then one row per column."""

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import chunks, col, finite, numbers, numeric_columns, ratio, rounded, text_columns
from plumbline.functions.special import shapiro_wilk
from plumbline.operators.quantiles import quantiles

# Wider aggregates outgrow what the JVM compiles; a further scan of other columns costs far less.
COLUMNS_PER_AGGREGATE = 12
# The quantiles a statistics table reports.
QUANTILE_NAMES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p5": 0.05, "p10": 0.1, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)


def per_column(df, columns, measure):
    """One output row per column: ``column``, ``rows`` and the aggregates ``measure(name)`` returns."""
    if not columns:
        none = df.limit(0).select(F.lit(None).cast("double").alias("_none"))
        return per_column(none, ["_none"], measure).where(F.lit(False))
    frames = []
    for part in chunks(list(columns), COLUMNS_PER_AGGREGATE):
        wide = df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.struct(*measure(c)).alias(f"m{i}") for i, c in enumerate(part)]
        )
        rows = [
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("at"), F.col("rows"), F.col(f"m{i}").alias("m"))
            for i, c in enumerate(part)
        ]
        frames.append(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.column", "r.rows", "r.m.*"))
    return union_all(frames)


def first_pass(df, columns):
    """{column: rows, n, sum, lo, hi} of columns that are already plain doubles."""
    found = per_column(df, columns, lambda c: [
        F.count(col(c)).alias("n"), F.sum(col(c)).alias("sum"), F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")])
    return {r["column"]: r for r in found.collect()}


def adjusted_skewness():
    n = F.col("n").cast("double")
    return F.when((n < 3) | (F.col("variance") == 0), F.lit(0.0)).otherwise(
        F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("g1"))


def adjusted_kurtosis():
    n = F.col("n").cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n < 4) | (F.col("variance") == 0), F.lit(0.0)).otherwise(
        scale * ((n + 1) * F.col("g2") + 6))


def skew_label(s):
    return (
        F.when(s > 1, "Highly right-skewed").when(s > 0.5, "Moderately right-skewed")
        .when(s < -1, "Highly left-skewed").when(s < -0.5, "Moderately left-skewed")
        .otherwise("Approximately symmetric")
    )


def kurtosis_label(k):
    return (
        F.when(k > 1, "Leptokurtic (heavy tails)").when(k < -1, "Platykurtic (light tails)")
        .otherwise("Mesokurtic (normal-like)")
    )


def facts(df, columns, extra=None, keep=(), powers=False):
    """Unrounded moments per column, with adjusted skewness and kurtosis.

    Two scans of plain sums: the first finds the means (k numbers), the second sums powers of the deviations
    from them, which is both cheaper per row than running central moments and exact to the last digits.
    ``extra(name, deviation, n)`` may add aggregates that also see the ``keep`` columns; ``powers`` keeps the sums of third and
    fourth powers about the mean, from which parts of a table can be merged.
    """
    columns = list(columns)
    clean = numbers(df, columns, keep)
    known = first_pass(clean, columns)
    mean = {c: (known[c]["sum"] / known[c]["n"] if known[c]["n"] else None) for c in columns}
    names = {c: f"_d{i}" for i, c in enumerate(columns)}
    shifted = clean.withColumns({names[c]: col(c) - F.lit(mean[c]).cast("double") for c in columns})

    def measure(c):
        d, k = F.col(names[c]), known[c]
        sums = [F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4")]
        fixed = [F.lit(k["n"]).cast("bigint").alias("n"), F.lit(k["sum"]).cast("double").alias("sum"),
                 F.lit(mean[c]).cast("double").alias("mean"), F.lit(k["lo"]).cast("double").alias("min"),
                 F.lit(k["hi"]).cast("double").alias("max")]
        return fixed + sums + (extra(c, d, k["n"]) if extra else [])

    n = F.col("n").cast("double")
    off = F.col("s1") / F.nullif(n, F.lit(0.0))
    squares = F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(F.greatest(F.col("s2") - n * off * off, F.lit(0.0)))
    cubes = F.col("s3") - 3 * off * F.col("s2") + 2 * n * F.pow(off, F.lit(3))
    fourths = F.col("s4") - 4 * off * F.col("s3") + 6 * off * off * F.col("s2") - 3 * n * F.pow(off, F.lit(4))
    summed = per_column(shifted, columns, measure).withColumns({"squares": squares, "cubes": cubes, "fourths": fourths}).drop("s1", "s2", "s3", "s4")
    return summed if powers else shaped(summed)


def shaped(summed):
    """Variance to kurtosis from sums of powers about the mean: squares, cubes, fourths."""
    n = F.col("n").cast("double")
    m2 = F.col("squares")
    spread = F.nullif(m2, F.lit(0.0))
    return summed.withColumns({
        "variance": m2 / F.nullif(n - 1, F.lit(0.0)), "std": F.sqrt(m2 / F.nullif(n - 1, F.lit(0.0))),
        "g1": F.sqrt(n) * F.col("cubes") / F.pow(spread, F.lit(1.5)), "g2": n * F.col("fourths") / (spread * spread) - 3,
    }).withColumns({"skewness": adjusted_skewness(), "kurtosis": adjusted_kurtosis()}).drop("cubes", "fourths")


def moments(df, columns=None, signed_cv=False, base=None):
    """Count to labels for columns with at least two values, rounded for display; ``base`` has their facts if they are known."""
    base = (facts(df, columns or numeric_columns(df)) if base is None else base).where("n >= 2")
    sem = ratio(F.col("std"), F.sqrt("n"))
    cv = ratio(F.col("std"), F.col("mean") if signed_cv else F.abs("mean")) * 100
    if not signed_cv:
        cv = F.when(F.col("std") != 0, cv)
    return base.select(
        "column", F.col("n").alias("count"), rounded(F.col("sum"), 2).alias("sum"),
        rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"),
        rounded(F.col("variance")).alias("variance"), rounded(sem).alias("sem"),
        rounded(F.col("min")).alias("min"), rounded(F.col("max")).alias("max"),
        rounded(F.col("max") - F.col("min")).alias("range"), rounded(cv, 2).alias("cv"),
        rounded(F.col("mean") - 1.96 * sem).alias("ci95_low"), rounded(F.col("mean") + 1.96 * sem).alias("ci95_high"),
        rounded(F.col("skewness")).alias("skewness"), rounded(F.col("kurtosis")).alias("kurtosis"),
        skew_label(F.col("skewness")).alias("skew_label"), kurtosis_label(F.col("kurtosis")).alias("kurt_label"),
    )


def quantile_table(df, columns=None, mode="auto", names=QUANTILE_NAMES, found=None):
    """One row per column with the named quantiles and the interquartile range; ``found`` has the values if they are known."""
    found = quantiles(df, columns or numeric_columns(df), list(names.values()), mode) if found is None else found
    rows = [(c, *values) for c, values in found.items() if values[0] is not None]
    schema = "column string, " + ", ".join(f"{n} double" for n in names)
    table = df.sparkSession.createDataFrame(rows, schema)
    if {"q1", "q3"} <= set(names):
        table = table.withColumn("iqr", F.col("q3") - F.col("q1"))
    return table.select("column", *[rounded(F.col(c)).alias(c) for c in table.columns[1:]])


def frequencies(df, columns, data_type="string"):
    """(column, value, count) with the counting done before the shuffle; null values are counted too."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, value {data_type}, count bigint")
    cast = df.select(*[col(c).cast(data_type).alias(c) for c in columns])
    return cast.unpivot([], columns, "column", "value").groupBy("column", "value").count()


def mode_table(df, columns=None):
    """Most frequent value per numeric column, smallest on ties."""
    best = F.min(F.struct((-F.col("count")).alias("c"), F.col("value").cast("double").alias("v")))
    def counted(c):
        values = df.where(finite(col(c)).isNotNull()).groupBy(col(c).alias("value")).count()
        return values.agg(best.alias("best")).select(F.lit(c).alias("column"), "best").where("best IS NOT NULL")
    return union_all([counted(c) for c in columns or numeric_columns(df)]).select(
        "column", rounded(F.col("best.v")).alias("mode"), (-F.col("best.c")).alias("mode_count"))


def statistics_table(df, columns=None, mode="auto", base=None, found=None, common=None):
    """G1-G8 side by side: moments, quantiles and mode of every numeric column, each of which may be known already."""
    columns = columns or numeric_columns(df)
    common = mode_table(df, columns) if common is None else common
    return (
        moments(df, columns, base=base)
        .join(F.broadcast(quantile_table(df, columns, mode, found=found)), "column", "left")
        .join(common.drop("mode_count"), "column", "left")
    )


def top_per_column(counted, k, by=None):
    """The k most frequent values per column; each task keeps only k rows per column before the shuffle."""
    order = Window.partitionBy("column").orderBy(*(by or [F.desc("count"), F.asc("value")]))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cardinality(distinct):
    return F.when(distinct > 50, "High").when(distinct > 10, "Medium").otherwise("Low")


def category_profile(df, columns=None, k=20):
    """Top values with shares of the non-null rows, distinct count, missing count and mode."""
    counted = frequencies(df, columns or text_columns(df))
    present = F.col("value").isNotNull()
    summary = counted.groupBy("column").agg(
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(~present, F.col("count"))), F.lit(0)).alias("missing"),
        F.sum(F.when(present, F.col("count"))).alias("present"),
        F.min(F.when(present, F.struct((-F.col("count")).alias("c"), F.col("value").alias("v")))).alias("best"),
    )
    top = top_per_column(counted.where(present), k)
    return top.join(summary, "column").select(
        "column", F.col("rank").cast("int").alias("rank"), "value", "count",
        rounded(F.col("count") / F.col("present") * 100, 2).alias("pct"), "distinct", "missing",
        F.col("best.v").alias("mode"), cardinality(F.col("distinct")).alias("cardinality"),
    )


def histogram(df, columns=None, most_bins=20, least_bins=5, min_rows=5):
    """Equal-width bins, last one closed; a constant column gets the range value - 0.5 .. value + 0.5."""
    columns = columns or numeric_columns(df)
    df = numbers(df, columns)
    bounds = list(first_pass(df, columns).values())
    cells, plans = [], []
    for b in bounds:
        if b["n"] < min_rows:
            continue
        bins = min(most_bins, max(least_bins, b["n"] // 3))
        lo, hi = (b["lo"], b["hi"]) if b["lo"] < b["hi"] else (b["lo"] - 0.5, b["hi"] + 0.5)
        width = (hi - lo) / bins
        plans.append((b["column"], bins))
        v = col(b["column"])
        guess = F.least(F.floor((v - lo) * (bins / (hi - lo))), F.lit(bins - 1))
        edge = lo + guess * width
        cell = (
            guess - (v < edge).cast("bigint")
            + ((guess < bins - 1) & (v >= lo + (guess + 1) * width)).cast("bigint")
        )
        cells.append(F.struct(F.lit(b["column"]).alias("column"), cell.cast("int").alias("bin"),
                              F.lit(lo).alias("lo"), F.lit(width).alias("width")))
    schema = "column string, bins int"
    frame = df.sparkSession.createDataFrame(plans, schema).select(
        "column", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    if not cells:
        return frame.select("column", "bin", *[F.lit(None).cast("double").alias(n) for n in ("low", "high", "center")],
                            F.lit(0).cast("bigint").alias("count"))
    counted = df.select(F.explode(F.array(*cells)).alias("c")).where("c.bin IS NOT NULL").groupBy(
        "c.column", "c.bin").count()
    ranges = {b["column"]: b for b in bounds}
    lows, widths = [], []
    for name, bins in plans:
        b = ranges[name]
        lo, hi = (b["lo"], b["hi"]) if b["lo"] < b["hi"] else (b["lo"] - 0.5, b["hi"] + 0.5)
        lows += [F.lit(name), F.lit(lo)]
        widths += [F.lit(name), F.lit((hi - lo) / bins)]
    low = F.create_map(*lows)[F.col("column")]
    width = F.create_map(*widths)[F.col("column")]
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin", rounded(low + F.col("bin") * width).alias("low"),
        rounded(low + (F.col("bin") + 1) * width).alias("high"),
        rounded(low + (F.col("bin") + 0.5) * width).alias("center"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def iqr_fences(df, columns, factor=1.5, mode="auto", found=None):
    """{column: (low fence, high fence, q1, q3)} for columns that have values; ``found`` has the quartiles if they are known."""
    found = quantiles(df, columns, [0.25, 0.75], mode) if found is None else found
    return {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1), q1, q3)
            for c, (q1, q3) in found.items() if q1 is not None}


def first_values(df, conditions, order_by, k, digits=4):
    """First k values in row order per column where its condition holds, as ``[a, b, ...]`` text.

    Rows that match nothing are dropped before the sort, and each task keeps only k rows per column.
    """
    keys = [col(o).alias(f"_o{i}") for i, o in enumerate(order_by)]
    hits = [F.struct(F.lit(c).alias("column"), finite(col(c)).alias("value"), cond.alias("hit"))
            for c, cond in conditions.items()]
    listed = df.select(*keys, F.explode(F.array(*hits)).alias("h")).where("h.hit").select(
        "h.column", "h.value", *[f"_o{i}" for i in range(len(order_by))])
    order = Window.partitionBy("column").orderBy(*[f"_o{i}" for i in range(len(order_by))], "value")
    ranked = listed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("at", F.format_string(f"%.{digits}f", "value").alias("v"))))
    return ranked.groupBy("column").agg(ordered.alias("vs")).select(
        "column", F.concat(F.lit("["), F.concat_ws(", ", "vs.v"), F.lit("]")).alias("extremes"))


def iqr_outliers(df, columns=None, order_by=(), k=6, factor=1.5, min_rows=4, mode="auto", quartiles=None):
    """Fences, outlier count and share, first k extremes in row order, severity."""
    columns = columns or numeric_columns(df)
    fences = iqr_fences(df, columns, factor, mode, quartiles)
    columns = [c for c in columns if c in fences]
    df = numbers(df, columns, order_by)
    outside = {c: (col(c) < fences[c][0]) | (col(c) > fences[c][1]) for c in columns}
    counted = per_column(df, columns, lambda c: [
        F.count(col(c)).alias("n"), F.count(F.when(outside[c], 1)).alias("count"),
        F.lit(fences[c][0]).alias("lb"), F.lit(fences[c][1]).alias("ub")]).where(F.col("n") >= min_rows)
    share = F.col("count") / F.col("n")
    table = counted.select(
        "column", "n", "count", rounded(share * 100, 2).alias("pct"), rounded(F.col("lb")).alias("lb"),
        rounded(F.col("ub")).alias("ub"),
        F.when(share > 0.1, "High").when(share > 0.03, "Medium").otherwise("Low").alias("severity"),
    )
    if not order_by:
        return table
    return table.join(first_values(df, outside, order_by, k), "column", "left").withColumn(
        "extremes", F.coalesce("extremes", F.lit("[]")))


def extreme_outliers(df, columns=None, mode="auto"):
    """Columns with values beyond three interquartile ranges, and how many."""
    return iqr_outliers(df, columns, factor=3.0, mode=mode).where("count > 0").select("column", "count")


def severity_tally(outliers):
    """G16."""
    return outliers.groupBy("severity").agg(F.count(F.lit(1)).alias("columns"))


def normality(df, columns=None, order_by=(), first=5000, min_rows=8):
    """G11(a): Shapiro-Wilk on the first values in row order, a bounded sample per column."""
    columns = columns or numeric_columns(df)
    keys = list(order_by)
    samples = [
        df.where(finite(col(c)).isNotNull()).orderBy(*[col(k) for k in keys]).limit(first)
        .select(F.lit(c).alias("column"), finite(col(c)).alias("value"))
        for c in columns
    ]

    def test(group: pd.DataFrame) -> pd.DataFrame:
        known = len(group) >= min_rows
        w, p = shapiro_wilk(group["value"].to_numpy()) if known else (None, None)
        return pd.DataFrame({
            "column": [group["column"].iloc[0]], "tested": [len(group)], "w": [w], "p_value": [p],
            "is_normal": [bool(p > 0.05) if known else None]})

    schema = "column string, tested long, w double, p_value double, is_normal boolean"
    return union_all(samples).groupBy("column").applyInPandas(test, schema)


def jarque_bera(df, columns=None, min_rows=8, base=None):
    """G11(b): normality over all rows from the third and fourth moments; p is the asymptotic tail."""
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    score = n / 6 * (g1 * g1 + g2 * g2 / 4)
    base = facts(df, columns or numeric_columns(df)) if base is None else base
    return base.where(n >= min_rows).select(
        "column", "n", rounded(score).alias("jb"), rounded(F.exp(-score / 2), 6).alias("p_value"),
        (F.exp(-score / 2) > 0.05).alias("is_normal"))


def confidence_score(rows, n, mean, std):
    """0-100 from completeness, sample size and relative spread."""
    return confidence_parts(rows, n, mean, std)["score"]


def confidence_parts(rows, n, mean, std):
    complete = n / F.greatest(rows, F.lit(1)) * 40
    size = F.when(n >= 5, F.least(F.lit(30.0), F.log10(F.greatest(n, F.lit(1))) / F.log10(F.lit(300.0)) * 30)).otherwise(0.0)
    spread = F.when((n >= 2) & (std > 0) & (mean != 0),
                    F.greatest(F.lit(0.0), 30 * (1 - F.abs(std / mean) / 2))).otherwise(15.0)
    total = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), complete + size + spread))).cast("int")
    return {
        "score": total,
        "reliability": F.when(total >= 80, "HIGH").when(total >= 60, "MEDIUM").otherwise("LOW"),
        "low_reliability": total < 60,
        "completeness_pts": F.round(complete, 1), "sample_size_pts": F.round(size, 1),
        "variance_pts": F.round(spread, 1),
    }


def confidence(df, columns=None, base=None):
    """I1 as a table: one row per numeric column."""
    parts = confidence_parts(F.col("rows"), F.col("n"), F.col("mean"), F.col("std"))
    base = facts(df, columns or numeric_columns(df)) if base is None else base
    return base.select(
        "column", F.col("n").alias("sample_n"), *[v.alias(k) for k, v in parts.items()])


def sort_statistics(table, metric, descending=True):
    """Order a statistics table by any metric, nulls counting as 0."""
    key = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
    return table.orderBy(key.desc() if descending else key.asc(), "column")


