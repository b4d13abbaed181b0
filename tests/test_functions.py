import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text_rules
from plumbline.functions.expr import finite, money, number, ratio, strip
from plumbline.functions.names import default_roles, is_key_name, is_row_index_name
from plumbline.functions.special import correlation_p, incomplete_beta, p_of_r, shapiro_wilk


# Tabulated two-sided Student t points: P(|T| > t) for v degrees of freedom.
@pytest.mark.parametrize("t, v, p", [
    (12.706204736, 1, 0.05), (2.570581836, 5, 0.05), (2.228138852, 10, 0.05), (3.169272673, 10, 0.01),
    (1.983971519, 100, 0.05), (1.960201264, 10000, 0.05), (4.586893859, 10, 0.001),
])
def test_p_of_correlation_matches_t_table(t, v, p):
    r = t / math.sqrt(v + t * t)
    assert correlation_p(r, v + 2) == pytest.approx(p, rel=1e-6)


def test_p_edge_cases():
    assert correlation_p(1.0, 10) == 0.0 and correlation_p(0.0, 10) == pytest.approx(1.0)
    assert correlation_p(0.5, 2) == 1.0 and math.isnan(correlation_p(float("nan"), 10))
    assert incomplete_beta(2, 3, 0) == 0 and incomplete_beta(2, 3, 1) == 1
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_shapiro_wilk_on_published_samples():
    # Weights of eleven men, the worked example of the test's original paper: W = 0.79.
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and 0.005 < p < 0.01
    rng = np.random.default_rng(1)
    assert shapiro_wilk(rng.normal(size=2000))[1] > 0.05
    assert shapiro_wilk(rng.exponential(size=500))[1] < 1e-10
    assert shapiro_wilk([3, 3, 3, 3])[0] == 1.0


def test_p_udf(spark):
    df = spark.createDataFrame([(0.5, 12.0), (None, 12.0)], "r double, n double").select(p_of_r("r", "n").alias("p"))
    got = [r["p"] for r in df.collect()]
    assert got[0] == pytest.approx(correlation_p(0.5, 12)) and got[1] is None


def test_numbers_and_ratios(spark):
    df = spark.createDataFrame([("1.5", 2.0, 0.0), ("x", float("nan"), 1.0), ("Infinity", float("-inf"), 4.0)],
                               "t string, a double, b double")
    got = df.select(number(F.col("t")).alias("n"), finite(F.col("a")).alias("f"), ratio(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r["n"] for r in got] == [1.5, None, None]
    assert [r["f"] for r in got] == [2.0, None, None]
    assert [r["q"] for r in got] == [None, None, None]


def test_money_and_strip(spark):
    df = spark.createDataFrame([(2_500_000.0, "\t a "), (34_567.0, "b"), (0.0, None), (None, " ")], "v double, s string")
    got = df.select(money(F.col("v")).alias("m"), strip(F.col("s")).alias("s")).collect()
    assert [r["m"] for r in got] == ["$2.5M", "$35K", "—", "—"]
    assert [r["s"] for r in got] == ["a", "b", None, ""]


def test_name_rules():
    assert is_row_index_name(" ID ") and is_row_index_name("row 12") and not is_row_index_name("idea")
    assert is_row_index_name("s.no", classic=True) and not is_row_index_name("s.no")
    assert is_key_name("customer_id") and is_key_name("idea") and not is_key_name("idea", "strict")
    assert is_key_name("GID") and not is_key_name("amount")
    found = default_roles(["total sales", "Amount", "item_code", "Region", "Geo"])
    assert found["amount"] == "Amount" and found["product"] == "item_code" and found["region"] == "Region"


QUESTIONS = [
    ("Average sales by region", "groupby", "groupby", "mean", 10),
    ("Top 10 products", "ranking", "ranking", None, 10),
    ("Correlation between columns", "correlation", "correlation", None, 10),
    ("What is the correlation of a and b", "general", "correlation", None, 10),
    ("any outliers", "general", "outlier", None, 10),
    ("trend in sales", "trend", "trend", None, 10),
    ("how many rows", "count", "count", None, 10),
    ("minimum of 25x or 7", "aggregation", "aggregation", "min", 7),
    ("", "general", "general", None, 10), (None, None, None, None, 10),
]


@pytest.mark.parametrize("mode, at", [("reference", 1), ("stem", 2)])
def test_intents(spark, mode, at):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "i int, q string")
    got = [r["t"] for r in df.select("i", text_rules.intent(F.col("q"), mode).alias("t")).orderBy("i").collect()]
    assert got == [q[at] for q in QUESTIONS]


def test_aggregation_words_and_numbers(spark):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS) if q[0] is not None], "i int, q string")
    got = df.select("i", text_rules.aggregation(F.col("q")).alias("a"), text_rules.top_n(F.col("q")).alias("n"),
                    text_rules.top_n(F.lit("top 90 of 3"), most=50).alias("m")).orderBy("i").collect()
    assert [r["a"] for r in got] == [q[3] for q in QUESTIONS if q[0] is not None]
    assert [r["n"] for r in got] == [q[4] for q in QUESTIONS if q[0] is not None]
    assert got[0]["m"] == 50
