import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.store import stored
from plumbline.operators import order
from plumbline.operators.features import moving_average, pct_change
from plumbline.operators.order import every_kth, over_previous, rows_at_ranks, sorted_ranges, with_row_index
from plumbline.operators.quantiles import quantiles

narrowing = sys.modules["plumbline.operators.quantiles"]


def shuffled(spark, n=5000):
    base = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 9 != 0, F.col("id").cast("double")).alias("v"))
    # One value of the first key holds a third of all rows.
    return base.withColumn("hot", F.when(F.col("k") % 3 == 0, 5).otherwise(F.col("k") % 11)).repartition(6)


@pytest.mark.parametrize("ranges", [None, 1, 2, 7, 64])
def test_row_index_equals_global_row_number(spark, ranges):
    got = with_row_index(shuffled(spark), ["hot", "k"], valid={"x": "v"}, ranges=ranges)
    order = Window.orderBy("hot", "k")
    same = got.withColumn("want", F.row_number().over(order) - 1).withColumn(
        "want_x", F.when(F.col("v").isNotNull(), F.count("v").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    assert same.where("NOT (_rn <=> want AND x <=> want_x)").count() == 0


@pytest.mark.parametrize("key", [["hot", "k"], ["hot"], ["one"]])
def test_hot_keys_are_split(spark, key):
    """A key value of a third of the rows, or of all rows, is spread over ranges; rows equal in all keys keep the order of the input."""
    df = shuffled(spark).withColumn("one", F.lit(1))
    sizes = sorted_ranges(df, key, 8).groupBy(F.shiftright("_at", 33).alias("r")).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 5000 / 8 * 2 and sizes[1] >= 7
    got = with_row_index(df, key, ranges=8)
    assert got.select("_rn").distinct().count() == 5000 and got.agg(F.max("_rn"), F.min("_rn")).first()[:] == (4999, 0)


@pytest.mark.parametrize("ranges", [None, 6])
def test_ranges_follow_the_table(spark, ranges):
    """No range holds much more than its share, whatever number of ranges was named or set."""
    df = shuffled(spark)
    sizes = sorted_ranges(df, ["hot", "k"], ranges, range_rows=100).groupBy(F.shiftright("_at", 33).alias("r")).count()
    assert sizes.agg(F.max("count")).first()[0] < 300


@pytest.mark.parametrize("kind, make", [
    ("date", lambda c: F.date_add(F.lit("2020-01-01"), c.cast("int"))),
    ("timestamp", lambda c: F.timestamp_seconds(c * 3607)),
    ("timestamp_ntz", lambda c: F.timestamp_seconds(c * 3607).cast("timestamp_ntz")),
    ("string", lambda c: F.lpad(c.cast("string"), 6, "0")),
    ("decimal", lambda c: (c / 7).cast("decimal(20,6)")),
    ("nulls", lambda c: F.when(c > 40, c)),
])
def test_key_types(spark, kind, make):
    df = spark.range(600).select(make(F.col("id")).alias("key"), F.col("id").alias("tie")).repartition(4)
    got = with_row_index(df, ["key", "tie"], ranges=5)
    assert got.where("_rn <> tie").count() == 0
    picked = rows_at_ranks(df, ["key", "tie"], [0, 7, 41, 42, 300, 598, 599, 700], inside_rows=20, cuts=8)
    assert sorted((r["_rn"], r["tie"]) for r in picked.collect()) == [(k, k) for k in (0, 7, 41, 42, 300, 598, 599)]


def test_empty_table(spark):
    assert with_row_index(spark.range(0), ["id"]).count() == 0


def test_every_kth(spark):
    got = [r["id"] for r in every_kth(spark.range(200), ["id"]).orderBy("id").collect()]
    assert got == list(range(0, 200, 2))


def test_ranks_of_tied_rows(spark):
    df = shuffled(spark, 3000)
    ordered = [r["hot"] for r in df.orderBy("hot").collect()]
    picked = rows_at_ranks(df, ["hot"], range(0, 3000, 100), inside_rows=10, cuts=4).collect()
    assert [(r["_rn"], r["hot"]) for r in sorted(picked, key=lambda r: r["_rn"])] == [(k, ordered[k]) for k in range(0, 3000, 100)]
    assert len({r["k"] for r in picked}) == 30
    assert rows_at_ranks(df.limit(0), ["hot"], [0, 1]).count() == 0 and rows_at_ranks(df, ["hot"], []).count() == 0


def test_systematic_sample_sorts_no_table(spark):
    df = shuffled(spark).withColumn("text", F.repeat(F.lit("x"), 50))
    got = every_kth(df, ["hot", "k"])
    want = with_row_index(df, ["hot", "k"]).where("_rn % 62 = 0")
    assert sorted(map(tuple, got.select("_rn", "k").collect())) == sorted(map(tuple, want.select("_rn", "k").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "RepartitionByExpression" not in plan and "Sort [" not in plan


def test_over_previous_crosses_blocks(spark):
    df = spark.range(50).withColumnRenamed("id", "_rn")
    got = over_previous(df, 2, lambda order, frame: {"s": F.sum("_rn").over(frame), "p": F.lag("_rn").over(order)}, block=7)
    assert got.where("p <> _rn - 1").count() == 0 and got.count() == 50
    assert got.where("_rn >= 2 AND s <> 3 * _rn - 3").count() == 0


def test_pct_change_pads_gaps(spark):
    df = spark.createDataFrame([(0, None), (1, 10.0), (2, None), (3, 15.0), (4, 0.0), (5, 5.0)], "t int, v double")
    got = [r["v_pct_change"] for r in pct_change(df, ["v"], ["t"]).orderBy("t").collect()]
    assert got == [None, None, 0.0, 50.0, -100.0, None]


def test_moving_average_ignores_nulls(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(8)], "t int, v double")
    got = [r["v_ma3"] for r in moving_average(df, ["v"], ["t"]).orderBy("t").collect()]
    assert got == [0.0, 0.5, 1.0, 1.5, 3.0, 4.5, 5.0, 6.0]


PROBABILITIES = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("inside", [10, 200, 10_000])
def test_narrowed_quantiles_agree_with_exact(spark, inside):
    df = spark.range(3000).select(
        (F.col("id") * 7919 % 3000 / 7).alias("spread"), F.when(F.col("id") % 3 == 0, 4.0).otherwise(F.col("id") * 1.0).alias("hot"),
        F.lit(2.5).alias("flat"), F.when(F.col("id") < 4, F.col("id") * 1.0).alias("few"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(-F.col("id") * 1.0).alias("nans"))
    exact = quantiles(df, df.columns, PROBABILITIES, "exact")
    refined = quantiles(df, df.columns, PROBABILITIES, "refine", inside_rows=inside)
    for c in df.columns:
        assert refined[c] == pytest.approx(exact[c]) if exact[c][0] is not None else refined[c] == exact[c]


def test_larger_tables_get_more_cuts_not_more_scans(spark, monkeypatch):
    """A table of two million rows is cut finely enough for one counting scan, with the cuts made ready once a task."""
    given, counted = {}, []
    find, count = order.rows_at_ranks, order._counted
    monkeypatch.setattr(order, "rows_at_ranks", lambda *a, **k: (given.update(k), find(*a, **k))[1])
    monkeypatch.setattr(order, "_counted", lambda *a: (counted.append(1), count(*a))[1])
    monkeypatch.setattr(order, "INSIDE_ROWS", 1000)
    got = [r["id"] for r in order.every_kth(spark.range(2_000_000), ["id"]).orderBy("id").collect()]
    assert got == list(range(0, 2_000_000, 25_000)) and given["cuts"] == 4000 and len(counted) == 1


def test_index_over_a_full_column_is_the_row_index(spark):
    """Counting within ranges shuffles all rows once more, which only columns with nulls need."""
    got = with_row_index(shuffled(spark), ["hot", "k"], valid={"x": "k", "y": "v"}, ranges=5)
    plan = got.select("x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and got.where("x <> _rn OR x IS NULL").count() == 0
    assert got.agg(F.max("y")).first()[0] == got.where("v IS NOT NULL").count() - 1


def test_large_gaps_are_sorted_without_another_round(spark, monkeypatch):
    """A gap of tens of thousands of values costs no further rounds over the whole table."""
    rounds, sketch = [], narrowing._sketch_cuts
    monkeypatch.setattr(narrowing, "ACCURACY", 100)
    monkeypatch.setattr(narrowing, "_sketch_cuts", lambda *a: (rounds.append(1), sketch(*a)))
    df = spark.range(600_000).select((F.col("id") * 7919 % 600_000).cast("double").alias("v"), (F.col("id") % 7).cast("double").alias("few"))
    assert quantiles(df, ["v", "few"], [0.25, 0.5]) == {"v": [149_999.75, 299_999.5], "few": [1.0, 3.0]} and not rounds


def test_stored_rows_are_read_by_column(spark):
    """Any header and type comes back as it was; a scan reads only what it needs."""
    df = spark.range(50).select(F.col("id").alias("a b,c"), F.lit("x").alias("d.e"), F.lit("y").alias("é=()"), (F.col("id") / 3).alias("z"), F.timestamp_seconds("id").alias("t"),
                                F.array(F.struct(F.col("id").alias("n m"))).alias("l"), F.when(F.col("id") > 9, F.timestamp_seconds("id").cast("timestamp_ntz")).alias("u"))
    got = stored(df)
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())
    plan = got.select("z")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "struct<c3:double>" in plan
    odd = df.withColumn("v", F.lit(None))
    assert sorted(map(str, stored(odd).collect())) == sorted(map(str, odd.collect()))
