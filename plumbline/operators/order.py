"""Row order as data: dense row indexes and samples by rank, without ever putting all rows into one task.

An index takes one shuffle into sorted ranges, whose number follows the size of the table and has no bound. The place of a row in the
input takes part in the range borders after the keys, so that rows equal in all keys are spread over ranges too. The ranges
are kept as they are, their sizes are summed up (a number per range), and every row's index is the sum before its range plus its
place within. A sample by rank sorts nothing: the wanted ranks are narrowed by counting rows between key tuples, and
only the few rows around them are compared with each other.
"""

import decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expr import col
from plumbline.functions.store import stored

CUTS = 256
MOST_CUTS = 4096
SAMPLE_PER_CUT = 24
RANGE_ROWS = 500_000
INSIDE_ROWS = 20_000
MOST_RANKS = 1_000
PLACE = (1 << 33) - 1


def sorted_ranges(df, order_by, ranges=None, range_rows=RANGE_ROWS):
    """The rows in sorted ranges with their range and place as ``_at`` (range * 2**33 + place), stored with it.

    ``ranges`` is the least number of ranges; a table of more than ``range_rows`` rows a range gets more, so that no task's share grows.
    """
    keys = [*[col(k) for k in order_by], F.col("_tie")]
    needed = -(-df.count() // range_rows)
    if needed > (ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
        ranges = needed
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(ranges, *keys) if ranges else tied.repartitionByRange(*keys)
    return stored(spread.sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))


def with_row_index(df, order_by, name="_rn", valid=None, ranges=None):
    """Append the dense index 0..n-1 under a total order; rows equal in all keys are numbered in the order of the input.

    ``valid`` maps a new column name to an existing column: the new one numbers only the rows where that
    column is not null (null elsewhere), which is the x axis of a trend over a column with gaps.
    """
    order_by, valid = list(order_by), dict(valid or {})
    kept = sorted_ranges(df, order_by, ranges).withColumn("_range", F.shiftright("_at", 33))
    seen = {f"_n{i}": source for i, source in enumerate(valid.values())}
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.count(col(s)).alias(n) for n, s in seen.items()])
    begins, total = [], [0] * (1 + len(seen))
    for r in sorted(sizes.collect(), key=lambda r: r["_range"]):  # a row per range
        begins.append((r["_range"], *total))
        total = [t + r[n] for t, n in zip(total, ("_n", *seen))]
    schema = "_range bigint, " + ", ".join(f"_b{i} bigint" for i in range(len(total)))
    placed = kept.join(F.broadcast(df.sparkSession.createDataFrame(begins, schema)), "_range")
    added = {name: F.col("_b0") + F.col("_at").bitwiseAND(F.lit(PLACE))}
    running = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, (new, source) in enumerate(valid.items(), 1):
        # without nulls it is the index itself; else the rows are shuffled once more, to count within their ranges
        added[new] = added[name] if total[i] == total[0] else F.when(col(source).isNotNull(), F.col(f"_b{i}") + F.count(col(source)).over(running) - 1)
    return placed.withColumns(added).select(*[col(c) for c in df.columns], *[col(c) for c in added])


def _portable(name, data_type):
    """A key as something of the same order that survives the trip to the driver and back."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(col(name))
    if isinstance(data_type, T.TimestampNTZType):
        return col(name).cast("string")
    if isinstance(data_type, T.DateType):
        return F.unix_date(col(name))
    return F.hex(col(name)) if isinstance(data_type, T.BinaryType) else col(name)


def _keys(df, order_by):
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_portable(k, types[k]).alias(f"k{i}") for i, k in enumerate(order_by)])


def _comparable(values):
    """A key column as arrays that compare elementwise as Spark orders them: nulls before values before NaN, then the value."""
    if isinstance(values, pa.Array):
        if pa.types.is_integer(values.type) or pa.types.is_floating(values.type):
            rank = values.is_valid().to_numpy(zero_copy_only=False).astype(np.int8)
            plain = values.fill_null(0).to_numpy(zero_copy_only=False)
            odd = np.isnan(plain)
            return rank + odd, np.where(odd, plain.dtype.type(0), plain)
        values = values.to_pylist()
    rank = np.array([0 if v is None else 2 if v != v else 1 for v in values], np.int8)
    plain = [0 if r != 1 else v for v, r in zip(values, rank)] if not (rank == 1).all() else values
    if plain and any(isinstance(v, (str, decimal.Decimal)) for v in plain):
        blank = "" if any(isinstance(v, str) for v in plain) else decimal.Decimal(0)
        out = np.empty(len(plain), object)
        out[:] = [blank if r != 1 else v for v, r in zip(plain, rank)]
        return rank, out
    return rank, np.array(plain)


def cut_arrays(tuples):
    """Sorted key tuples as arrays that compare as Spark orders them, two a key; made once a task."""
    return [a for c in zip(*tuples) for a in _comparable(c)]


def key_places(columns, tuples, cuts=None):
    """Where key tuples lie among sorted ones: 2i in the gap below the i-th, 2i + 1 at it. By binary search, all rows at once."""
    if not columns or not tuples:
        return np.zeros(len(columns[0]) if columns else 0, np.int32)
    rows = [a for c in columns for a in _comparable(c)]
    cuts = cut_arrays(tuples) if cuts is None else cuts
    needed = [i for i in range(len(rows)) if i % 2 or (rows[i] != 1).any() or (cuts[i] != 1).any()]  # no flags where all are plain values
    rows, cuts = [rows[i] for i in needed], [cuts[i] for i in needed]
    # the first key alone settles every row that equals no cut's first key
    low, high = np.searchsorted(cuts[0], rows[0], "left"), np.searchsorted(cuts[0], rows[0], "right")
    place, open_ = 2 * low, np.flatnonzero(high > low)
    place[open_] = _searched([r[open_] for r in rows], cuts, low[open_], high[open_])
    return place.astype(np.int32)


def _searched(rows, cuts, low, high):
    """Places of rows that lie from cut ``low`` on and below cut ``high``."""
    def compared(at):
        """Whether the cut at each place is less than the row, and whether it equals it."""
        less, alike = np.zeros(at.size, bool), None
        for cut, row in zip(cuts, rows):  # later columns are looked at only where all before are equal
            here, own = (cut[at], row) if alike is None else (cut[at[alike]], row[alike])
            smaller, same = (here < own).astype(bool), (here == own).astype(bool)
            less[slice(None) if alike is None else alike] = smaller
            alike = np.flatnonzero(same) if alike is None else alike[same]
            if not alike.size:
                break
        equal = np.zeros(at.size, bool)
        equal[alike] = True
        return less, equal

    last, end = cuts[0].size - 1, high
    while (low < high).any():
        middle = (low + high) // 2
        less, _ = compared(np.minimum(middle, last))
        more = (low < high) & less
        high = np.where((low < high) & ~less, middle, high)
        low = np.where(more, middle + 1, low)
    _, equal = compared(np.minimum(low, last))
    return 2 * low + (equal & (low < end))


def _counted(keys, tuples):
    """_p, n: how many rows lie at each place, added up per task."""
    def count(batches):
        total, cuts = np.zeros(2 * len(tuples) + 1, np.int64), cut_arrays(tuples)
        for batch in batches:
            total += np.bincount(key_places(batch.columns, tuples, cuts), minlength=total.size)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total[places])], names=["_p", "n"])

    return keys.mapInArrow(count, "_p int, n bigint").groupBy("_p").agg(F.sum("n").alias("n"))


def _within(keys, tuples, places):
    """The keys at the given places, with their place."""
    wanted = np.zeros(2 * len(tuples) + 1, bool)
    wanted[list(places)] = True

    def pick(batches):
        cuts = cut_arrays(tuples)
        for batch in batches:
            place = key_places(batch.columns, tuples, cuts)
            held = batch.filter(pa.array(wanted[place]))
            yield pa.RecordBatch.from_arrays([pa.array(place[wanted[place]]), *held.columns], names=["_p", *held.schema.names])

    return keys.mapInArrow(pick, T.StructType([T.StructField("_p", T.IntegerType()), *keys.schema.fields]))


def rows_at_ranks(df, order_by, ranks, name="_rn", inside_rows=INSIDE_ROWS, cuts=CUTS, rows=None):
    """The rows at the given ranks (from 0) of an order, with their rank; of rows equal in all keys any may stand at each of their ranks.

    Rounds read keys only. Each draws key tuples from the gaps that hold wanted ranks, counts the rows between and at them in one scan,
    and keeps the gaps with a rank in them, until each is small by count. The keys in those gaps are numbered, which gives the key of
    every wanted rank, and the rows with these keys are found by a join.
    """
    ranks = sorted(set(ranks))
    none = df.withColumn(name, F.lit(None).cast("bigint")).limit(0)
    keys = _keys(df, order_by)
    edges, large, rounds = [], None, 0
    while True:
        rows = sum(large.values()) if large else df.count() if rows is None else rows
        if not rows or not ranks:
            return none
        known = _within(keys, edges, large).drop("_p") if large else keys
        drawn = _sorted(tuple(r) for r in known.sample(min(1.0, cuts * SAMPLE_PER_CUT / rows), 11 + rounds).collect())
        step = max(1, len(drawn) // cuts)
        edges = _sorted({*edges, *drawn[step // 2 :: step]})
        counts = {r["_p"]: r["n"] for r in _counted(keys, edges).collect()}
        wanted, before, at = {}, 0, 0
        for p in sorted(counts):
            while at < len(ranks) and ranks[at] < before + counts[p]:
                wanted.setdefault(p, (before, []))[1].append(ranks[at])
                at += 1
            before += counts[p]
        large = {p: counts[p] for p in wanted if p % 2 == 0 and counts[p] > inside_rows}
        rounds += 1
        if not large:
            break
        edges, large = _trimmed(edges, wanted, large)
    return _rows_of_keys(df, order_by, _keys_at(keys, edges, wanted), name) if wanted else none


def _trimmed(edges, wanted, large):
    """Only the edges around wanted places, and the large gaps by their new places."""
    keep = sorted({i for p in wanted for i in ((p - 1) // 2, p // 2) if 0 <= i < len(edges)})
    moved = {i: k for k, i in enumerate(keep)}
    return [edges[i] for i in keep], {2 * moved.get(p // 2, len(keep)): n for p, n in large.items()}


def _keys_at(keys, edges, wanted):
    """[(key tuple, rank)]: settled places are edges, the others are numbered within their gaps."""
    found = [(edges[p // 2], r) for p, (_, rs) in wanted.items() if p % 2 for r in rs]
    gaps = {p: v for p, v in wanted.items() if p % 2 == 0}
    if gaps:
        listed = keys.sparkSession.createDataFrame([(p, r - before, r) for p, (before, rs) in gaps.items() for r in rs], "_p int, _place bigint, _rank bigint")
        number = F.row_number().over(Window.partitionBy("_p").orderBy(*keys.columns)) - 1
        inside = _within(keys, edges, gaps).withColumn("_place", number.cast("bigint")).join(F.broadcast(listed), ["_p", "_place"])
        found += [(tuple(r[c] for c in keys.columns), r["_rank"]) for r in inside.collect()]  # a row per wanted rank
    return found


def _rows_of_keys(df, order_by, found, name):
    kinds = _keys(df, order_by).schema.fields
    # of rows with one key that is wanted several times, as many are taken as there are ranks
    counted, listed = {}, []
    for key, rank in sorted(found, key=lambda f: f[1]):
        counted[key] = counted.get(key, 0) + 1
        listed.append((*key, counted[key], rank))
    wanted = df.sparkSession.createDataFrame(listed, T.StructType([*[T.StructField(f"_{f.name}", f.dataType) for f in kinds], T.StructField("_place", T.IntegerType()), T.StructField(name, T.LongType())]))
    types = {f.name: f.dataType for f in df.schema.fields}
    own = df.withColumns({f"_own{i}": _portable(k, types[k]) for i, k in enumerate(order_by)})
    same = reduce(lambda a, b: a & b, [F.col(f"_own{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(order_by))])
    hit = own.join(F.broadcast(wanted.where("_place = 1").drop("_place", name)), same, "left_semi")
    most = max(counted.values())
    place = F.row_number().over(Window.partitionBy(*[f"_own{i}" for i in range(len(order_by))]).orderBy(F.lit(0)))
    taken = hit.withColumn("_taken", place).where(F.col("_taken") <= most)  # each task keeps that many per key before the shuffle
    return taken.join(F.broadcast(wanted), same & (F.col("_taken") == F.col("_place"))).select(*[col(c) for c in df.columns], name)


def _sorted(tuples):
    """As Spark sorts them: nulls first, NaN last."""
    return sorted(tuples, key=lambda t: [(v is not None, v != v, 0 if v is None or v != v else v) for v in t])


def every_kth(df, order_by, step=None, points=80):
    """Systematic sample: rows 0, step, 2*step, ... with step = max(1, n // points)."""
    n = df.count()
    step = step or max(1, n // points)
    if step == 1 or n // step > MOST_RANKS:
        return with_row_index(df, order_by).where(F.col("_rn") % step == 0)
    cuts = min(MOST_CUTS, max(CUTS, 2 * n // INSIDE_ROWS))  # more cuts in a scan, not more scans
    return rows_at_ranks(df, order_by, range(0, n, step), rows=n, cuts=cuts)


def first_k(df, order_by, k):
    """First k rows of an order: a bounded top-k per task, then a merge."""
    return df.orderBy(*[col(c) for c in order_by]).limit(k)


def over_previous(df, depth, build, at="_rn", block=100_000):
    """Add columns that look at up to ``depth`` earlier rows of a dense index.

    ``build(order, frame)`` gets a window specification for ``lag`` and one framed to the last ``depth`` rows
    plus the current one. Rows are cut into blocks of consecutive indexes and the last ``depth`` rows of a
    block are also sent to the next, so every window stays inside a bounded block.
    """
    own = F.expr(f"{at} div {block}")
    edge = F.col(at) % block >= block - depth
    spread = df.withColumn("_block", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy("_block").orderBy(at)
    added = build(order, order.rowsBetween(-depth, Window.currentRow))
    return spread.withColumns(added).where(F.col("_block") == own).drop("_block")
