"""Pearson association between numeric columns."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.expr import chunks, col, finite, numbers, numeric_columns, rounded
from plumbline.functions.special import p_of_r
from plumbline.operators.stats import first_pass, union_all

PAIRS_PER_AGGREGATE = 15
WIDE_COLUMNS = 24
COLUMNS_PER_BLOCK = 256


def pair_facts(df, pairs, wide_from=WIDE_COLUMNS):
    """Unrounded pairwise-complete facts; slope and intercept predict the second column from the first.

    Products of deviations from the column means are summed. A pair of columns without nulls needs one sum of
    its own, a pair with nulls sums its complete rows. More than ``wide_from`` columns are summed in one scan by Python tasks, as
    compiled sums would take a scan for every few pairs; null, flat and rounding rules are the same.
    """
    pairs = list(pairs)
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    clean = numbers(df, columns)
    known = first_pass(clean, columns)
    mean = {c: (known[c]["sum"] / known[c]["n"] if known[c]["n"] else 0.0) for c in columns}
    at = {c: i for i, c in enumerate(columns)}
    shifted = clean.select(*[(col(c) - F.lit(mean[c])).alias(f"d{i}") for c, i in at.items()])
    flat = {c for c in columns if known[c]["lo"] == known[c]["hi"]}
    if len(columns) > wide_from:
        return finished_pairs(_gram_sums(shifted, columns, pairs, mean, flat))
    full = {c for c in columns if known[c]["n"] == known[c]["rows"]}
    frames = []
    for part in chunks(pairs, PAIRS_PER_AGGREGATE):
        sums, rows = {}, []
        for j, (a, b) in enumerate(part):
            x, y = F.col(f"d{at[a]}"), F.col(f"d{at[b]}")
            if a in full and b in full:
                sums.update({f"s{at[a]}": F.sum(x), f"q{at[a]}": F.sum(x * x), f"s{at[b]}": F.sum(y), f"q{at[b]}": F.sum(y * y)})
                own = {"sx": F.col(f"s{at[a]}"), "sxx": F.col(f"q{at[a]}"), "sy": F.col(f"s{at[b]}"), "syy": F.col(f"q{at[b]}")}
                own["n"] = F.lit(known[a]["n"]).cast("double")
            else:
                both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
                made = {"sx": F.sum(both_x), "sxx": F.sum(both_x * both_x), "sy": F.sum(both_y), "syy": F.sum(both_y * both_y),
                        "n": F.count(both_x).cast("double")}
                sums.update({f"{k}_{j}": v for k, v in made.items()})
                own = {k: F.col(f"{k}_{j}") for k in made}
            sums[f"p{j}"] = F.sum(x * y)
            own["sxy"] = F.col(f"p{j}")
            rows.append(F.struct(
                F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.lit(mean[a]).alias("c1"), F.lit(mean[b]).alias("c2"),
                F.lit(a in flat or b in flat).alias("flat"), *[v.cast("double").alias(k) for k, v in own.items()]))
        wide = shifted.agg(*[v.alias(k) for k, v in sums.items()])
        frames.append(wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    return finished_pairs(union_all(frames))


def finished_pairs(sums):
    """r, means and line from n and the sums sx, sy, sxx, syy, sxy of deviations from c1 and c2."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    size = F.nullif(n, F.lit(0.0))
    cross = F.col("sxy") - sx * sy / size
    across = F.when(~F.col("flat"), F.greatest(F.lit(0.0), F.col("sxx") - sx * sx / size))
    upward = F.when(~F.col("flat"), F.greatest(F.lit(0.0), F.col("syy") - sy * sy / size))
    return sums.withColumns({
        "r": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cross / F.nullif(F.sqrt(across * upward), F.lit(0.0)))),
        "slope": cross / F.nullif(across, F.lit(0.0)), "mean1": F.col("c1") + sx / size, "mean2": F.col("c2") + sy / size,
    }).withColumn("r", F.when(across * upward > 0, F.col("r"))).select(
        "col1", "col2", n.cast("bigint").alias("n"), "r", "mean1", "mean2", "slope",
        (F.col("mean2") - F.col("slope") * F.col("mean1")).alias("intercept"))


def _gram_sums(shifted, columns, pairs, mean, flat, block=COLUMNS_PER_BLOCK):
    """The sums of all pairs in one scan: each task adds up the products of column blocks of its rows, and tells them block by block."""
    k = len(columns)
    cuts = [(a, min(k, a + block)) for a in range(0, k, block)]
    ranges = [(p, q) for i, p in enumerate(cuts) for q in cuts[i:]]

    def partial(batches):
        totals = [np.zeros((6, b - a, d - c)) for (a, b), (c, d) in ranges]
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            present = ~np.isnan(x)
            x, m = np.where(present, x, 0.0), present.astype(float)
            squares = x * x
            for total, ((a, b), (c, d)) in zip(totals, ranges):
                left, right = slice(a, b), slice(c, d)
                for t, (u, v) in enumerate(((m, m), (x, m), (m, x), (x, x), (squares, m), (m, squares))):
                    total[t] += u[:, left].T @ v[:, right]
        for total, ((a, _), (c, _)) in zip(totals, ranges):
            i, j = np.nonzero(np.arange(total.shape[1])[:, None] + a < np.arange(total.shape[2])[None] + c)
            yield pd.DataFrame({"i": (i + a).astype("int32"), "j": (j + c).astype("int32"), **{f"t{t}": total[t][i, j] for t in range(6)}})

    summed = shifted.mapInPandas(partial, "i int, j int, " + ", ".join(f"t{t} double" for t in range(6)))
    summed = summed.groupBy("i", "j").agg(*[F.sum(f"t{t}").alias(f"t{t}") for t in range(6)])
    at = {c: i for i, c in enumerate(columns)}
    wanted = [(a, b, min(at[a], at[b]), max(at[a], at[b]), at[a] > at[b], mean[a], mean[b], a in flat or b in flat) for a, b in pairs]
    listed = shifted.sparkSession.createDataFrame(wanted, "col1 string, col2 string, i int, j int, turned boolean, c1 double, c2 double, flat boolean")
    either = lambda p, q: F.when(F.col("turned"), F.col(q)).otherwise(F.col(p))
    return listed.join(summed, ["i", "j"]).select(
        "col1", "col2", "c1", "c2", "flat", F.col("t0").alias("n"), either("t1", "t2").alias("sx"), either("t2", "t1").alias("sy"), F.col("t3").alias("sxy"),
        either("t4", "t5").alias("sxx"), either("t5", "t4").alias("syy"))


def corr_pairs(df, columns=None, wide_from=WIDE_COLUMNS, facts=None):
    """Every unordered pair in column order, pairwise complete; ``facts`` has the pair facts if they are known."""
    columns = columns or numeric_columns(df)
    facts = pair_facts(df, list(combinations(columns, 2)), wide_from) if facts is None else facts
    return facts.select("col1", "col2", "n", rounded(F.col("r")).alias("r"))


def corr_matrix(df, columns=None):
    """G12 as a full matrix in long form, diagonal included."""
    columns = columns or numeric_columns(df)
    pairs = corr_pairs(df, columns).drop("n")
    varying = df.agg(*[F.struct(F.min(finite(col(c))).alias("lo"), F.max(finite(col(c))).alias("hi")).alias(f"d{i}")
                       for i, c in enumerate(columns)])
    diagonal = varying.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col1"), F.lit(c).alias("col2"),
                 F.when(F.col(f"d{i}.lo") < F.col(f"d{i}.hi"), F.lit(1.0)).alias("r"))
        for i, c in enumerate(columns)])).alias("d")).select("d.*")
    mirrored = pairs.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")
    return union_all([pairs, mirrored, diagonal])


def strength(r):
    size = F.abs(r)
    return (
        F.when(size >= 0.9, "Very Strong").when(size >= 0.7, "Strong").when(size >= 0.5, "Moderate").otherwise("Weak")
    )


def strong_pairs(pairs, least=0.3, k=None):
    """G13 over a pair table: all pairs of at least that size, or the k strongest of them."""
    r = F.col("r")
    found = pairs.where(F.abs(r) >= least).select(
        "col1", "col2", "r", F.round(r * r, 4).alias("r2"), strength(r).alias("strength"),
        F.when(r > 0, "Positive").otherwise("Negative").alias("direction"),
        F.round(r * r * 100, 1).alias("p_explained"),
    ).orderBy(F.abs(r).desc(), "col1", "col2")
    return found if k is None else found.limit(k)


def correlation_answer(pairs, touching=None, k=15):
    """Strongest pairs of any size, optionally only those with one given column."""
    found = pairs.where("r IS NOT NULL")
    if touching is not None:
        found = found.where((F.col("col1") == touching) | (F.col("col2") == touching))
    return found.select(
        "col1", "col2", "r", F.round(F.col("r") * F.col("r"), 4).alias("r2"), strength(F.col("r")).alias("strength")
    ).orderBy(F.abs("r").desc(), "col1", "col2").limit(k)


def best_predictor(df, columns=None, targets=None, min_rows=5):
    """For each target the other column with the largest |r| (unrounded), with its fitted line and p."""
    columns = columns or numeric_columns(df)
    targets = targets or columns
    pairs = [(p, t) for t in targets for p in columns if p != t]
    order = {c: i for i, c in enumerate(columns)}
    place = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])[F.col("col1")]
    ranked = pair_facts(df, pairs).where((F.col("n") >= min_rows) & F.col("r").isNotNull()).withColumn(
        "at", F.row_number().over(Window.partitionBy("col2").orderBy(F.abs("r").desc(), place)))
    return ranked.where("at = 1").withColumn("p", p_of_r(F.col("r"), F.col("n").cast("double"))).select(
        F.col("col2").alias("target"), F.col("col1").alias("predictor"), rounded(F.col("r")).alias("r"),
        rounded(F.col("r") * F.col("r")).alias("r2"), rounded(F.col("slope")).alias("slope"),
        rounded(F.col("intercept")).alias("intercept"), rounded(F.col("p"), 6).alias("p_value"),
        (F.col("p") < 0.05).alias("significant"),
        F.format_string("%s = %.4f×%s + %.4f", "col2", "slope", "col1", "intercept").alias("equation"))


def scatter_hint(points, x="x", y="y"):
    """R of the plotted points with a word for its size; null for five points or fewer."""
    r = F.corr(F.col(x), F.col(y))
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return points.agg(n.alias("points"), F.when(n > 5, rounded(r, 3)).alias("r")).withColumn(
        "hint", F.when(F.abs("r") >= 0.7, "Strong").when(F.abs("r") >= 0.4, "Moderate").when(
            F.col("r").isNotNull(), "Weak"))
