"""Exact, linearly interpolated quantiles of many columns without shuffling or collecting the rows.

Each wanted order statistic is narrowed by repeated scans of all columns, at every size. One scan sketches cut points close to either side of every
target (bounded sketches), the next counts how many values lie at each cut and between neighbouring cuts, in one array per task. Every target then
sits either at a cut, which settles it, or in an open interval between two cuts that holds only a few
ten-thousandths of the values, which is narrowed again until its checked count is small enough to sort; only rows with a value in such an
interval are looked at then, and each interval is sorted on its own. A value that repeats billions of times becomes a cut, so skew ends the
search instead of prolonging it.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions.expr import chunks, col, finite

INSIDE_ROWS = 200_000
SMALL_ROWS = 10_000
ACCURACY = 10_000
COLUMNS_PER_SCAN = 200


def quantiles(df, columns, probabilities, mode="auto", inside_rows=INSIDE_ROWS):
    """{column: [value per probability]}; None where the column has no finite value.

    ``mode``: ``auto`` and ``refine`` narrow, ``exact`` uses the built-in (which keeps every distinct value of a column
    in memory), ``approx`` returns the sketch's answer.
    """
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    if not columns:
        return {}
    found = {}
    for part in chunks(columns, COLUMNS_PER_SCAN):
        if mode in ("auto", "refine"):
            found.update(_refine(df, part, probabilities, inside_rows))
        else:
            found.update(_one_scan(df, part, probabilities, mode == "approx"))
    return found


def _one_scan(df, columns, probabilities, approx):
    wanted = F.array(*[F.lit(p) for p in probabilities])

    def answer(c):
        value = finite(col(c))
        return F.percentile_approx(value, probabilities, ACCURACY) if approx else F.percentile(value, wanted)

    row = df.agg(*[answer(c).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"q{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}


def _around(shares):
    """Sketch probabilities a safe distance either side of each share, so that the cuts enclose the target."""
    slack = 2.0 / ACCURACY
    return sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)})


def _refine(df, columns, probabilities, inside_rows):
    df = df.select(*[finite(col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    first = df.agg(*[
        F.struct(F.count(f"v{i}").alias("n"),
                 F.percentile_approx(f"v{i}", _around(probabilities), ACCURACY).alias("cuts")).alias(f"s{i}")
        for i in range(len(columns))
    ]).first()
    settled, cells, sizes = {}, [], {}
    for i, c in enumerate(columns):
        n = sizes[c] = first[f"s{i}"]["n"]
        if n:
            # Both neighbours of each (possibly fractional) position are wanted, as 1-based ranks.
            ranks = {f(p * (n - 1)) + 1 for p in probabilities for f in (math.floor, math.ceil)}
            cells.append({"column": c, "name": f"v{i}", "low": None, "high": None, "n": n,
                          "ranks": {r: r for r in ranks}, "cuts": first[f"s{i}"]["cuts"]})
    least = min(inside_rows, SMALL_ROWS)  # a column of that size is sorted at once
    _sort_small(df, [x for x in cells if x["n"] <= least], settled)
    cells = [x for x in cells if x["n"] > least]
    while cells:
        cells = _count_between_cuts(df, cells, settled)
        _sort_small(df, [x for x in cells if x["n"] <= inside_rows], settled)
        cells = [x for x in cells if x["n"] > inside_rows]
        if cells:
            _sketch_cuts(df, cells)
    return {c: [_at(settled, c, p * (sizes[c] - 1)) if sizes[c] else None for p in probabilities] for c in columns}


def _at(settled, c, position):
    low, high = settled[c, math.floor(position) + 1], settled[c, math.ceil(position) + 1]
    return low + (high - low) * (position - math.floor(position))


def _picked(df, cells):
    """cell, v: the values that lie in each cell's open interval. All others are dropped in the scan."""
    names = list(dict.fromkeys(x["name"] for x in cells))
    wanted = [(names.index(x["name"]), x["low"], x["high"]) for x in cells]

    def pick(batches):
        for batch in batches:
            known = [c.drop_null().to_numpy(zero_copy_only=False) for c in batch.columns]
            for i, (at, low, high) in enumerate(wanted):
                v = known[at]
                if low is not None:
                    v = v[v > low]
                if high is not None:
                    v = v[v < high]
                if v.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, i, np.int32)), pa.array(v)], names=["cell", "v"])

    return df.select(*names).mapInArrow(pick, "cell int, v double")


def _sketch_cuts(df, cells):
    row = _picked(df, cells).agg(*[
        F.percentile_approx(F.when(F.col("cell") == i, F.col("v")), _around([r / x["n"] for r in x["ranks"].values()]), ACCURACY).alias(f"s{i}")
        for i, x in enumerate(cells)
    ]).first()
    for i, x in enumerate(cells):
        x["cuts"] = row[f"s{i}"]


def _count_between_cuts(df, cells, settled):
    """One counting scan for all cells: position 2i is the gap below cut i, position 2i + 1 is cut i itself."""
    for x in cells:
        x["cuts"] = sorted(set(x["cuts"]))
    counted = {}
    for r in _places(df, cells).collect():  # at most 2 * cuts + 1 positions per cell
        counted.setdefault(r["cell"], []).append((r["place"], r["count"]))
    narrowed = {}
    for i, x in enumerate(cells):
        held = sorted(counted[i])
        for original, rank in x["ranks"].items():
            passed = 0
            for place, count in held:
                if rank <= passed + count:
                    break
                passed += count
            cut = place // 2
            if place % 2:
                settled[x["column"], original] = x["cuts"][cut]
                continue
            low = x["cuts"][cut - 1] if cut else x["low"]
            high = x["cuts"][cut] if cut < len(x["cuts"]) else x["high"]
            cell = narrowed.setdefault((x["column"], low, high), {
                "column": x["column"], "name": x["name"], "low": low, "high": high, "n": count, "ranks": {}})
            cell["ranks"][original] = rank - passed
    return list(narrowed.values())


def _places(df, cells):
    """cell, place, count: each task finds the places of its values by binary search and adds them up in one array per cell."""
    names = list(dict.fromkeys(x["name"] for x in cells))
    wanted = [(x["name"], x["low"], x["high"], np.array(x["cuts"], float)) for x in cells]

    def count(batches):
        totals = [np.zeros(2 * len(cuts) + 1, np.int64) for _, _, _, cuts in wanted]
        for batch in batches:
            known = {}
            for total, (name, low, high, cuts) in zip(totals, wanted):
                if name not in known:
                    known[name] = batch.column(names.index(name)).drop_null().to_numpy(zero_copy_only=False)
                v = known[name]
                if low is not None:
                    v = v[v > low]
                if high is not None:
                    v = v[v < high]
                place = np.searchsorted(cuts, v, "left") + np.searchsorted(cuts, v, "right")
                total += np.bincount(place, minlength=total.size)
        cell = np.repeat(np.arange(len(totals), dtype=np.int32), [t.size for t in totals])
        place = np.concatenate([np.arange(t.size, dtype=np.int32) for t in totals])
        flat = np.concatenate(totals)
        yield pa.RecordBatch.from_arrays([pa.array(a[flat > 0]) for a in (cell, place, flat)], names=["cell", "place", "count"])

    counted = df.select(*names).mapInArrow(count, "cell int, place int, count bigint")
    return counted.groupBy("cell", "place").agg(F.sum("count").alias("count"))


def _sort_small(df, cells, settled):
    """Intervals whose size is proven small: each is sorted on its own, and the wanted ranks are read off."""
    for part in chunks(cells, COLUMNS_PER_SCAN):
        ranks = F.create_map(*[e for i, x in enumerate(part) for e in (F.lit(i), F.array(*[F.lit(r) for r in x["ranks"].values()]))])[F.col("cell")]
        ordered = _picked(df, part).groupBy("cell").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        for r in ordered.select("cell", F.transform(ranks, lambda rank: F.get(F.col("vs"), rank - 1)).alias("found")).collect():
            x = part[r["cell"]]
            for original, value in zip(x["ranks"], r["found"]):
                settled[x["column"], original] = value
