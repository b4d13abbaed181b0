import math
import random
import statistics
import struct

from pyspark.sql import functions as F

from plumbline.operators import ask, ranks

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       0.1, 0.30000000000000004, 1 / 3, 2.0 ** 52, 2.0 ** 53 - 1, 2.0 ** -1022, 1e-310, 123456.789]


def bits(x):
    whole = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -whole if x < 0 else whole


def test_keys_are_the_bits_in_order(spark):
    rnd = random.Random(1)
    values = ODD + [rnd.gauss(0, 1) * 10 ** rnd.randint(-300, 300) for _ in range(3000)] + [math.ldexp(1 + k * 2.0 ** -52, e) for k in (0, 1) for e in range(-1022, 1023, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.order_key(F.col("v")).alias("k")).collect()
    assert all(r.k == bits(r.v) for r in rows)


def test_ranks_of_groups_with_repeated_values(spark):
    rnd = random.Random(2)
    groups = {"one": [7.5], "same": [2.0] * 500, "mixed": [rnd.choice([-3.5, 0.0, 1.25, 1e9]) for _ in range(400)], "spread": [rnd.gauss(0, 1e6) for _ in range(1001)],
              "close": [1e15 + k / 4 for k in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    counted = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").count()
    wanted = [(g, k, r) for g, vs in groups.items() for k, r in enumerate([1, 2, len(vs) // 2 + 1, len(vs), len(vs) + 1])]
    found = ranks.select_ranks(counted, spark.createDataFrame(wanted, "g string, target int, rank int"), ["g"]).collect()
    got = {(r.g, r.target): r.value for r in found}
    assert got == {(g, k): sorted(groups[g])[r - 1] for g, k, r in wanted if r <= len(groups[g])}


def test_one_group_of_all_rows_has_its_median(spark):
    for n in (9999, 10000):
        rows = spark.range(n).select(F.lit("all").alias("c"), (F.hash("id") % 50_000 / 7).alias("v"))
        values = [r.v for r in rows.collect()]
        (found,) = ask.group_agg(rows, "v", "c", "median").collect()
        assert found["value"] == round(statistics.median(values), 3)
    assert ask.group_agg(rows.limit(0), "v", "c", "median").count() == 0
    nulls = spark.createDataFrame([("a", None), ("b", 1.0), (None, 2.0)], "c string, v double")
    assert [tuple(r) for r in ask.group_agg(nulls, "v", "c", "median").collect()] == [("b", 1.0)]


def test_no_filter_finds_the_keys_again(spark):
    """A round's join must not push a filter on the key below the counts, where it would run on every row."""
    rows = spark.range(50).select(F.lit("a").alias("c"), F.expr("CASE WHEN id % 7 <> 0 THEN id / 3 END").alias("v"))
    plan = ask.group_agg(rows, "v", "c", "median")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "LOG2" in line.upper()]


def test_rounds_are_kept_where_targets_are_few(spark):
    """With kept states no plan grows with the rounds, and nothing is left to run for the found values."""
    from plumbline.functions.store import local
    rows = spark.range(40_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 == 0, -0.25).otherwise(F.col("id") / 7 - 900).alias("v"), F.lit(1).cast("bigint").alias("count"))
    celled = rows.withColumn("cell", ranks.prefix(ranks.order_key(F.col("v")), ranks.BITS))
    targets = celled.groupBy("g", "cell").count().select("g", "cell", F.explode(F.array(F.lit(1).cast("bigint"), F.expr("count div 2 + 1"), "count")).alias("rank"))
    targets = targets.distinct().withColumn("target", F.col("rank").cast("int"))
    plain = {tuple(r) for r in ranks.select_ranks(celled, targets, ["g", "cell"]).collect()}
    for few in (ranks.FEW_ROWS, 0):
        ranks.FEW_ROWS, kept = few, ranks.FEW_ROWS
        found = ranks.select_ranks(celled, targets, ["g", "cell"], "cell", local)
        ranks.FEW_ROWS = kept
        assert {tuple(r) for r in found.collect()} == plain and len(plain) > 20
        assert "Range (0" not in found._jdf.queryExecution().optimizedPlan().toString()
