"""Derived columns, each with a row that names it, its formula and its reason."""

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.functions.expr import as_number, col, date_columns, finite, numeric_columns, ratio
from plumbline.operators.order import over_previous, with_row_index
from plumbline.operators.profile import null_counts
from plumbline.operators.stats import facts

FEATURE_SCHEMA = "name string, formula string, type string, why string"


def add_measures(df, amount="Amount", boxes="Boxes", unit_cost="Cost_per_box", cost="Cost",
                 profit="Profit", profit_pct="Profit_Pct"):
    """Cost (unless the table has one), profit and profit percent (null unless the amount is positive)."""
    if cost not in df.columns:
        if unit_cost not in df.columns or boxes not in df.columns:
            return df
        df = df.withColumn(cost, as_number(df, unit_cost) * as_number(df, boxes))
    if amount not in df.columns:
        return df
    value = as_number(df, amount)
    return df.withColumn(profit, value - as_number(df, cost)).withColumn(
        profit_pct, F.when(value > 0, ratio(col(profit), value) * 100))


def pct_change(df, columns=None, order_by=(), max_columns=None, least=3):
    """Percent change against the previous value in row order, nulls standing for the value before them.

    Columns without nulls share one pass. A column with nulls numbers its non-null rows, so its previous
    value is always one step back and no value has to be carried over an unbounded gap. Columns of fewer than
    ``least`` values get no change; ``max_columns`` limits only columns that are not named.
    """
    columns = list(columns or numeric_columns(df)[:max_columns])
    known = {r["column"]: (r["rows"], r["null_count"]) for r in null_counts(df, columns).collect()}
    columns = [c for c in columns if known[c][0] - known[c][1] >= least]
    gaps = [c for c in columns if known[c][1]]
    full = [c for c in columns if c not in gaps]
    out = with_row_index(df, order_by, valid={f"_x_{c}": c for c in gaps})
    if full:
        out = over_previous(out, 1, lambda order, frame: {
            f"{c}_pct_change": _change(c, order) for c in full})
    for c in gaps:
        known = over_previous(out.where(col(c).isNotNull()), 1, lambda order, frame, c=c: {
            f"{c}_pct_change": _change(c, order)}, at=f"_x_{c}")
        first = out.where(col(c).isNotNull()).agg(F.min("_rn").alias("r")).first()["r"]
        flat = F.lit(None).cast("double") if first is None else F.when(F.col("_rn") > first, F.lit(0.0))
        out = known.unionByName(out.where(col(c).isNull()).withColumn(f"{c}_pct_change", flat))
    return out.drop("_rn", *[f"_x_{c}" for c in gaps])


def _change(c, order):
    before = F.lag(finite(col(c))).over(order)
    return ratio(finite(col(c)) - before, before) * 100


def moving_window(rows):
    """W3's window length for a table of that many rows."""
    return min(5, rows // 4) if rows >= 10 else 3


def moving_average(df, columns=None, order_by=(), window=None, max_columns=None, least=5):
    """Mean of the non-null values on the last ``window`` rows; a table of fewer than ``least`` rows has none."""
    columns = list(columns or numeric_columns(df)[:max_columns])
    rows = df.count()
    if rows < least or not columns:
        return df
    window = window or moving_window(rows)
    return over_previous(with_row_index(df, order_by), window - 1, lambda order, frame: {
        f"{c}_ma{window}": F.avg(finite(col(c))).over(frame) for c in columns}).drop("_rn")


def _numeric_facts(df, columns):
    found = facts(df, columns).select("column", "rows", "n", F.col("min").alias("lo"), "mean", "std").collect()
    return {r["column"]: r for r in found}


def ratio_pairs(df, columns=None, most=None):
    """The pairs whose second column is positive and not dwarfed by the first."""
    columns = list(columns or numeric_columns(df))
    known = _numeric_facts(df, columns)
    usable = [
        (a, b) for a, b in combinations(columns, 2)
        if known[a]["n"] >= 3 and known[b]["n"] >= 3 and known[b]["lo"] > 0
        and abs(known[a]["mean"]) / max(abs(known[b]["mean"]), 0.001) <= 100
    ]
    return usable[:most]


def ratios(df, columns=None, most=None):
    """``a_per_b`` for the chosen pairs."""
    return df.withColumns({f"{a}_per_{b}": ratio(col(a), col(b)) for a, b in ratio_pairs(df, columns, most)})


def zscores(df, columns=None, max_columns=None):
    """(x - mean) / std for columns with at least five values and some spread."""
    columns = list(columns or numeric_columns(df)[:max_columns])
    known = _numeric_facts(df, columns)
    kept = [c for c in columns if known[c]["n"] >= 5 and (known[c]["std"] or 0) > 0]
    return df.withColumns({
        f"{c}_zscore": (finite(col(c)) - F.lit(known[c]["mean"])) / F.lit(known[c]["std"]) for c in kept})


def date_parts(df, columns=None, max_columns=None):
    """Year, month and day of week (Monday is 0)."""
    parts = {}
    for c in list(columns or date_columns(df)[:max_columns]):
        parts.update({f"{c}_year": F.year(col(c)), f"{c}_month": F.month(col(c)), f"{c}_dow": F.weekday(col(c))})
    return df.withColumns(parts)


def feature_table(df, numeric=None, dates=None, changes=None, averages=None, pairs=None, scores=None, parts=None):
    """Names, formulas and reasons of the columns the feature operators would add to this table. The five numbers limit how many of
    each kind are listed; None lists all."""
    numeric = list(numeric or numeric_columns(df))
    dates = list(dates or date_columns(df))
    known = _numeric_facts(df, numeric) if numeric else {}
    rows_in_table = next(iter(known.values()))["rows"] if known else df.count()
    rows = [
        (f"{c}_pct_change", f"({c}[n] - {c}[n-1]) / {c}[n-1] × 100", "Growth Rate",
         f"Relative change of {c} between consecutive records")
        for c in numeric[:changes] if known[c]["n"] >= 3
    ]
    if rows_in_table >= 5:
        window = moving_window(rows_in_table)
        rows += [(f"{c}_ma{window}", f"Rolling mean of {c} over {window} rows", "Moving Average",
                  f"Smooths {c} to show its trend") for c in numeric[:averages]]
    rows += [(f"{a}_per_{b}", f"{a} / {b}", "Ratio", f"Normalises {a} by {b}") for a, b in ratio_pairs(df, numeric, pairs)]
    rows += [(f"{c}_zscore", f"({c} - mean({c})) / std({c})", "Z-Score",
              f"Standardised {c}; beyond ±3 is an outlier")
             for c in numeric[:scores] if known[c]["n"] >= 5 and (known[c]["std"] or 0) > 0]
    rows += [(f"{c}_year / _month / _dow", f"Extract year, month, day-of-week from {c}", "Date Decomposition",
              "Allows time-based grouping") for c in dates[:parts]]
    return df.sparkSession.createDataFrame(rows, FEATURE_SCHEMA)


def with_features(df, order_by, numeric=None, dates=None):
    """All feature operators in the usual order."""
    numeric = list(numeric or numeric_columns(df))
    out = pct_change(df, numeric, order_by) if numeric else df
    if numeric:
        out = moving_average(out, numeric, order_by)
        out = zscores(ratios(out, numeric), numeric)
    return date_parts(out, dates)
