"""Joins, unions, aggregates and answers (inventory E-G, W5, Q)."""

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import ask, assoc, merge, profile, stats
from plumbline.operators.roles import detect_keys
from plumbline.operators.star import (
    Dim, containment, detect_fact, fact_candidates, relationships, schema_type, shared_keys, star_join,
)
from plumbline.plans.model import join_model
from plumbline.sources import sinks

from suite.base import GAPS_SQL, SERIES_SQL, each, gaps, query, series, table

NUMBERS = ("l_quantity", "l_discount", "l_tax", "price_k", "disc_gap", "tax_sparse")


def _orders_with_customers(spark, sf):
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return star_join(orders, [Dim(customer, "o_custkey", "c_custkey", "customer")]), nation


@query("e1_star_join", """
SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def e1(spark, sf):
    joined, _ = _orders_with_customers(spark, sf)
    return joined.drop("o_orderstatus", "o_orderdate", "o_orderpriority")


@query("e1_null_and_hot_keys", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber < 5 THEN 1 ELSE l_suppkey END AS s_suppkey, s_name
FROM lineitem LEFT JOIN supplier ON s_suppkey = CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber < 5 THEN 1 ELSE l_suppkey END""")
def e1_hot(spark, sf):
    fact = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber < 5 THEN 1 ELSE l_suppkey END AS s_suppkey")
    dim = Dim(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", name="supplier", keys=["s_suppkey"])
    return star_join(fact, [dim])


@query("e1_star_join_fan_out", """
SELECT n_regionkey, count(*) AS rows, count(extra) AS matched, round(sum(s_acctbal), 2) AS balance
FROM supplier LEFT JOIN (SELECT n_nationkey, n_regionkey, 'a' AS extra FROM nation WHERE n_nationkey < 20 UNION ALL
  SELECT n_nationkey, n_regionkey, 'b' FROM nation WHERE n_nationkey < 5) ON s_nationkey = n_nationkey GROUP BY 1""")
def e1_fan(spark, sf):
    nation = table(spark, sf, "nation")
    dim = nation.where("n_nationkey < 20").selectExpr("n_nationkey", "n_regionkey", "'a' AS extra").unionByName(
        nation.where("n_nationkey < 5").selectExpr("n_nationkey", "n_regionkey", "'b' AS extra"))
    joined = star_join(table(spark, sf, "supplier"), [Dim(dim, "s_nationkey", "n_nationkey", "nation")])
    return joined.groupBy("n_regionkey").agg(
        F.count("*").alias("rows"), F.count("extra").alias("matched"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("e2_e3_pruned_renamed_join", """
SELECT s_acctbal AS balance, s_nationkey, s_name AS name, n_name AS name_nations_ FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey""")
def e2(spark, sf):
    fact = table(spark, sf, "supplier").selectExpr("s_acctbal AS balance", "s_nationkey", "s_name AS name")
    dim = table(spark, sf, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name AS name", "n_regionkey AS region_id")
    return star_join(fact, [Dim(dim, "s_nationkey", "s_nationkey", "nations_of_the_world")])


_MODEL = ("region", "nation", "customer", "orders", "lineitem")


@query("e4_fact_candidates", " UNION ALL ".join(
    f"SELECT {i} AS position, '{t}' AS \"table\", count(*) AS rows, {m} AS measures, count(*) = (SELECT count(*) FROM lineitem) AS is_fact FROM {t}"
    for i, (t, m) in enumerate((("region", 1), ("nation", 1), ("customer", 2), ("orders", 2), ("lineitem", 8)))))
def e4(spark, sf):
    tables = {t: table(spark, sf, t) for t in _MODEL}
    keys = {t: detect_keys(df) for t, df in tables.items()}
    return fact_candidates(tables, keys).withColumn("is_fact", F.col("table") == detect_fact(tables, keys))


def _relation_sql(fact, dim, fk, dk, where="true", kind="many-to-one"):
    return (f"SELECT '{fact}' AS fact, '{dim}' AS dim, '{fk}' AS key, '{kind}' AS type, count({fk}) AS keyed_rows, "
            f"count({fk}) FILTER (WHERE {fk} IN (SELECT {dk} FROM {dim} WHERE {where})) AS matched, "
            f"count({fk}) FILTER (WHERE {fk} NOT IN (SELECT {dk} FROM {dim} WHERE {where})) AS orphans FROM {fact}")


@query("e5_relationships", _relation_sql("lineitem", "orders", "l_orderkey", "o_orderkey", "o_orderstatus <> 'P'") + " UNION ALL "
       + _relation_sql("lineitem", "part", "l_partkey", "p_partkey") + " UNION ALL "
       + _relation_sql("lineitem", "supplier", "l_suppkey", "s_suppkey", "s_acctbal > 0"))
def e5(spark, sf):
    dims = [Dim(table(spark, sf, "orders").where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey", "orders"),
            Dim(table(spark, sf, "part"), "l_partkey", "p_partkey", "part"),
            Dim(table(spark, sf, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey", "supplier")]
    return relationships(table(spark, sf, "lineitem"), dims, "lineitem")


def _keyed(spark, sf):
    return {
        "clients": table(spark, sf, "customer").selectExpr("c_custkey AS cust_id", "c_nationkey AS nation_id"),
        "sold": table(spark, sf, "orders").selectExpr("o_orderkey AS order_id", "o_custkey AS cust_id"),
        "lines": table(spark, sf, "lineitem").selectExpr("l_orderkey AS order_id", "l_tax"),
    }


def _contained(key, a, av, at, b, bv, bt):
    return (f"SELECT '{key}' AS key, '{a}' AS from_table, '{b}' AS to_table, count(DISTINCT {av}) AS \"values\", "
            f"count(DISTINCT {av}) FILTER (WHERE {av} IN (SELECT {bv} FROM {bt})) AS found, "
            f"round(count(DISTINCT {av}) FILTER (WHERE {av} IN (SELECT {bv} FROM {bt})) / count(DISTINCT {av}), 4) AS containment FROM {at}")


_CONTAINED = (("cust_id", "clients", "c_custkey", "customer", "sold", "o_custkey", "orders"),
              ("order_id", "sold", "o_orderkey", "orders", "lines", "l_orderkey", "lineitem"))


@query("e6_shared_keys", " UNION ALL ".join(
    _contained(k, *left, *right) for k, *x in _CONTAINED for left, right in ((x[:3], x[3:]), (x[3:], x[:3]))))
def e6(spark, sf):
    tables = _keyed(spark, sf)
    return containment(tables, shared_keys(tables))


@query("e6_schema_type", """SELECT CASE WHEN (SELECT count(*) FROM lineitem) > 0 THEN 'relational' END AS keyed,
 'star_schema' AS named, 'independent' AS apart, 'single' AS alone""")
def e6_type(spark, sf):
    keyed = _keyed(spark, sf)
    named = {"fact_sales": keyed["sold"], "product_lookup": keyed["lines"]}
    apart = {"a": keyed["clients"].select("cust_id"), "b": keyed["lines"].select("l_tax")}
    kinds = [schema_type(t) for t in (keyed, named, apart, {"a": keyed["sold"]})]
    return keyed["lines"].limit(1).select(*[F.lit(k).alias(n) for n, k in zip(("keyed", "named", "apart", "alone"), kinds)])


def _model_tables(spark, sf):
    return {
        "shipments": table(spark, sf, "lineitem").selectExpr(
            "concat('P', CAST(l_partkey AS STRING)) AS PID", "concat('S', CAST(l_suppkey AS STRING)) AS SPID",
            "l_shipdate AS Shipdate", "l_extendedprice AS Amount", "l_quantity AS Boxes"),
        "products": table(spark, sf, "part").selectExpr(
            "concat('P', CAST(p_partkey AS STRING)) AS PID", "p_name AS Product", "p_type AS Category", "p_retailprice AS Cost_per_box"),
        "people": table(spark, sf, "supplier").selectExpr("concat('S', CAST(s_suppkey AS STRING)) AS SPID", "s_name AS Sales_person"),
    }


_MODEL_SQL = """WITH joined AS (SELECT l_extendedprice AS Amount, l_quantity AS Boxes, p_retailprice AS Cost_per_box, p_type,
 s_name, p_retailprice * l_quantity AS Cost, l_extendedprice - p_retailprice * l_quantity AS Profit,
 (l_extendedprice - p_retailprice * l_quantity) / l_extendedprice * 100 AS Profit_Pct
 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


@query("e7_join_model", _MODEL_SQL + """
SELECT p_type AS "Category", count(*) AS rows, count(s_name) AS people, round(sum(Amount), 2) AS amount, round(sum(Cost), 2) AS cost,
 round(sum(Profit), 2) AS profit, round(avg(Profit_Pct), 4) AS profit_pct FROM joined GROUP BY 1""")
def e7(spark, sf):
    model = join_model(_model_tables(spark, sf))
    return model.df.groupBy("Category").agg(
        F.count("*").alias("rows"), F.count("Sales_person").alias("people"), F.round(F.sum("Amount"), 2).alias("amount"),
        F.round(F.sum("Cost"), 2).alias("cost"), F.round(F.sum("Profit"), 2).alias("profit"),
        F.round(F.avg("Profit_Pct"), 4).alias("profit_pct"))


_SOURCES = {"PID": "products", "SPID": "people"}


@query("b6_joined_schema", """WITH n AS (SELECT count(*) AS rows, count(DISTINCT l_partkey) AS pids, count(DISTINCT l_suppkey) AS spids FROM lineitem)
SELECT 'PID' AS "column", 'Key' AS type, 'products' AS source_table, 'FK → products' AS agg_hint, true AS is_id, pids AS "unique" FROM n UNION ALL
SELECT 'SPID', 'Key', 'people', 'FK → people', true, spids FROM n UNION ALL
SELECT 'Shipdate', 'Date/Time', 'shipments', 'GROUP BY/FILTER', false, count(DISTINCT l_shipdate) FROM lineitem UNION ALL
SELECT 'Amount', 'Numeric', 'shipments', 'SUM/AVG/MEASURE', false, count(DISTINCT l_extendedprice) FROM lineitem UNION ALL
SELECT 'Product', 'Text', 'shipments', 'GROUP BY/FILTER', false, count(DISTINCT p_name) FROM lineitem JOIN part ON l_partkey = p_partkey""")
def b6(spark, sf):
    model = join_model(_model_tables(spark, sf))
    return model.schema().where(F.col("column").isin("PID", "SPID", "Shipdate", "Amount", "Product")).select(
        "column", "type", "source_table", "agg_hint", "is_id", "unique")


@query("b12_schema_by_source", "SELECT * FROM (VALUES ('people', 1 :: BIGINT, 'SPID'), ('products', 1, 'PID'), ('shipments', 9, "
       "'Amount, Boxes, Category, Cost, Cost_per_box, Product, Profit, Profit_Pct, Shipdate')) t(source_table, columns, names) "
       "WHERE (SELECT count(*) FROM lineitem) > 0 UNION ALL SELECT 'none', 0, '' FROM lineitem WHERE false")
def b12_source(spark, sf):
    schema = join_model(_model_tables(spark, sf)).schema()
    return profile.schema_by_source(schema.where("column <> 'Sales_person'"))


def _union_tables(spark, sf):
    return {
        "north.csv": table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS sales"),
        "a long label › two": table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS visits"),
    }


@query("f1_tagged_union", """
SELECT s_suppkey AS "id__north.csv", s_name AS "name__north.csv", s_acctbal AS sales, 'north.csv' AS "_source",
 NULL :: BIGINT AS "id__a_long_label__t", NULL :: VARCHAR AS "name__a_long_label__t", NULL :: INT AS visits FROM supplier
UNION ALL SELECT NULL, NULL, NULL, 'a long label › two', c_custkey, c_name, c_nationkey FROM customer""")
def f1(spark, sf):
    return merge.tagged_union(_union_tables(spark, sf))


@query("f1_union_like_labels", """
SELECT s_suppkey AS "id__quarterly_report_2021", s_acctbal AS sales, 'quarterly_report_2021' AS "_source", NULL :: BIGINT AS "id__quarterly_report_2022", NULL :: INT AS visits FROM supplier
UNION ALL SELECT NULL, NULL, 'quarterly_report_2022', c_custkey, c_nationkey FROM customer""")
def f1_like(spark, sf):
    north, south = _union_tables(spark, sf).values()
    return merge.tagged_union({"quarterly_report_2021": north.drop("name"), "quarterly_report_2022": south.drop("name")})


@query("f1_union_conflicts", """SELECT * FROM (VALUES ('id', 2, 'north.csv, a long label › two'), ('name', 2, 'north.csv, a long label › two'))
 t("column", tables, sources) WHERE (SELECT count(*) FROM supplier) > 0""")
def f1_conflicts(spark, sf):
    return merge.conflicts_table(spark, _union_tables(spark, sf))


@query("f3_separate_tables", "SELECT round((1 - 0 / (count(*) * 4)) * 100, 2) AS completeness_pct, 'supplier' AS label FROM supplier UNION ALL "
       + GAPS_SQL.replace("WITH gaps AS", "SELECT * FROM (WITH gaps AS") + " SELECT round((1 - (2 * count(*) - count(price_k) - count(flag_gap)) / (count(*) * 2)) * 100, 2), 'gaps' FROM gaps)")
def f3(spark, sf):
    return merge.per_table({"supplier": table(spark, sf, "supplier"), "gaps": gaps(spark, sf).select("price_k", "flag_gap")},
                           profile.completeness)


# ---- statistics ---------------------------------------------------------------------------------------------------
_MOMENTS = """
 count({c}) AS count, round(sum({c}), 2) AS sum, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(var_samp({c}), 4) AS variance, round(stddev_samp({c}) / sqrt(count({c})), 4) AS sem, round(min({c}), 4) AS min,
 round(max({c}), 4) AS max, round(max({c}) - min({c}), 4) AS range, round(stddev_samp({c}) / abs(avg({c})) * 100, 2) AS cv,
 round(avg({c}) - 1.96 * stddev_samp({c}) / sqrt(count({c})), 4) AS ci95_low,
 round(avg({c}) + 1.96 * stddev_samp({c}) / sqrt(count({c})), 4) AS ci95_high,
 round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
 CASE WHEN skewness({c}) > 1 THEN 'Highly right-skewed' WHEN skewness({c}) > 0.5 THEN 'Moderately right-skewed'
      WHEN skewness({c}) < -1 THEN 'Highly left-skewed' WHEN skewness({c}) < -0.5 THEN 'Moderately left-skewed'
      ELSE 'Approximately symmetric' END AS skew_label,
 CASE WHEN kurtosis({c}) > 1 THEN 'Leptokurtic (heavy tails)' WHEN kurtosis({c}) < -1 THEN 'Platykurtic (light tails)'
      ELSE 'Mesokurtic (normal-like)' END AS kurt_label"""
_MOMENTS_SQL = GAPS_SQL + " " + each(NUMBERS, _MOMENTS, "gaps")


def _moments(spark, sf, *names):
    return stats.moments(gaps(spark, sf), NUMBERS).select("column", *names)


def _part(*names):
    listed = ", ".join(f'"{n}"' for n in names)
    return f'SELECT "column", {listed} FROM ({_MOMENTS_SQL})'


for _name, _columns in (
    ("g1_moments", ("count", "sum", "mean", "std", "variance", "sem", "min", "max", "range")),
    ("g4_skewness", ("skewness",)), ("g5_kurtosis", ("kurtosis",)), ("g6_cv", ("cv",)),
    ("g7_mean_interval", ("ci95_low", "ci95_high")), ("g8_shape_labels", ("skew_label", "kurt_label")),
):
    query(_name, _part(*_columns))(lambda spark, sf, names=_columns: _moments(spark, sf, *names))

_QUANTILES = ", ".join(f"round(quantile_cont({{c}}, {p}), 4) AS {n}" for n, p in stats.QUANTILE_NAMES.items()) + \
    ", round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr"


@query("g2_quantiles", GAPS_SQL + " " + each(NUMBERS, _QUANTILES, "gaps"))
def g2(spark, sf):
    return stats.quantile_table(gaps(spark, sf), NUMBERS)


@query("g2_quantiles_narrowed", GAPS_SQL + " " + each(("l_quantity", "price_k"), _QUANTILES, "gaps"))
def g2_narrowed(spark, sf):
    return stats.quantile_table(gaps(spark, sf), ["l_quantity", "price_k"], mode="refine")


_MODE = "(SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("g3_mode", GAPS_SQL + ' SELECT * FROM (' + each(NUMBERS, f"round({_MODE}, 4) AS mode, (SELECT count(*) FROM gaps g "
       f"WHERE g.{{c}} = {_MODE}) AS mode_count", "(SELECT 1)") + ")")
def g3(spark, sf):
    return stats.mode_table(gaps(spark, sf), NUMBERS)


@query("a11_statistics_sheet", GAPS_SQL + " SELECT * EXCLUDE (sum, sem, ci95_low, ci95_high, skew_label, kurt_label, p5, p10, p90, p95, p99) "
       "FROM (" + each(NUMBERS, _MOMENTS + ", " + _QUANTILES, "gaps") + ")")
def a11(spark, sf):
    return sinks.statistics_sheet(stats.statistics_table(gaps(spark, sf), NUMBERS))


_CATEGORIES = ("flag_gap", "padded", "number_text", "ship_text")
_TOP = """
SELECT '{c}' AS "column", (row_number() OVER (ORDER BY n DESC, v)) :: INT AS rank, v AS value, n AS count,
 round(n / sum(n) OVER () * 100, 2) AS pct, count(*) OVER () AS "distinct",
 (SELECT count(*) - count({c}) FROM gaps) AS missing, first_value(v) OVER (ORDER BY n DESC, v) AS mode,
 CASE WHEN count(*) OVER () > 50 THEN 'High' WHEN count(*) OVER () > 10 THEN 'Medium' ELSE 'Low' END AS cardinality
FROM (SELECT {c} AS v, count(*) AS n FROM gaps WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("g9_category_profile", GAPS_SQL + " SELECT * FROM (" + " UNION ALL ".join(_TOP.replace("{c}", c) for c in _CATEGORIES)
       + ") WHERE rank <= 20")
def g9(spark, sf):
    return stats.category_profile(gaps(spark, sf), _CATEGORIES)


_HIST_COLUMNS = ("l_quantity", "price_k", "tax_sparse", "flat")
_HIST = """
SELECT '{c}' AS "column", bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high,
 round(lo + (bin + 0.5) * w, 4) AS center, (SELECT count(*) FROM gaps WHERE {c} IS NOT NULL AND
   ({c} >= lo + bin * w OR bin = 0) AND ({c} < lo + (bin + 1) * w OR bin = 19)) AS count
FROM (SELECT lo, (hi - lo) / 20 AS w FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
 CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM gaps)), (SELECT range :: INT AS bin FROM range(20))"""


@query("g10_histogram", GAPS_SQL + " " + " UNION ALL ".join(_HIST.replace("{c}", c) for c in _HIST_COLUMNS))
def g10(spark, sf):
    return stats.histogram(gaps(spark, sf), _HIST_COLUMNS)




@query("g11_jarque_bera", SERIES_SQL + " SELECT \"column\", n, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS is_normal "
       "FROM (SELECT \"column\", n, n / 6 * (pow(skew * (n - 2) / sqrt(n * (n - 1)), 2) + pow(kurt, 2) / 4) AS jb FROM ("
       + each(("value", "gappy", "drift"), "count({c}) :: BIGINT AS n, skewness({c}) AS skew, kurtosis_pop({c}) AS kurt", "series") + "))")
def g11_jb(spark, sf):
    return stats.jarque_bera(series(spark, sf), ["value", "gappy", "drift"])


_MIXED = """WITH mixed AS (SELECT l_quantity, l_extendedprice / 1000 AS price_k,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000 + l_quantity END AS blend,
  l_extendedprice / 500 - l_tax * 300 AS mostly_price, l_tax FROM lineitem)"""
MIXED = ("l_quantity", "price_k", "blend", "mostly_price", "l_tax")


def mixed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice / 1000 AS price_k",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000 + l_quantity END AS blend",
        "l_extendedprice / 500 - l_tax * 300 AS mostly_price", "l_tax")


_PAIRS = _MIXED + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 4) AS r FROM mixed"
    for a, b in combinations(MIXED, 2)) + ")"
_STRENGTH = "CASE WHEN abs(r) >= 0.9 THEN 'Very Strong' WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END"


@query("g12_correlations", _PAIRS + " SELECT * FROM pairs")
def g12(spark, sf):
    return assoc.corr_pairs(mixed(spark, sf), MIXED)


@query("g12_correlations_gram", _PAIRS + " SELECT * FROM pairs")
def g12_gram(spark, sf):
    return assoc.corr_pairs(mixed(spark, sf), MIXED, wide_from=0)


@query("g12_correlation_matrix", _PAIRS + " SELECT col1, col2, r FROM pairs UNION ALL SELECT col2, col1, r FROM pairs UNION ALL "
       "SELECT c, c, 1.0 FROM (VALUES " + ", ".join(f"('{c}')" for c in MIXED) + ") t(c)")
def g12_matrix(spark, sf):
    return assoc.corr_matrix(mixed(spark, sf), MIXED)


@query("g13_strong_pairs", _PAIRS + f""" SELECT col1, col2, r, round(r * r, 4) AS r2, {_STRENGTH} AS strength,
 CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction, round(r * r * 100, 1) AS p_explained FROM pairs
 WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, col1, col2 LIMIT 20""")
def g13(spark, sf):
    return assoc.strong_pairs(assoc.corr_pairs(mixed(spark, sf), MIXED), k=20)


_FENCED = """WITH a AS (SELECT ts, event_id, value, CASE WHEN user_id % 20 = 1 THEN -value * 9 ELSE value END AS wild, value + user_id AS mild,
 CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_id % 7 END AS even FROM events)"""
_FENCES = """ SELECT '{c}' AS "column", n, c AS count, round(c / n * 100, 2) AS pct, round(lo, 4) AS lb, round(hi, 4) AS ub,
 CASE WHEN c / n > 0.1 THEN 'High' WHEN c / n > 0.03 THEN 'Medium' ELSE 'Low' END AS severity,
 coalesce((SELECT concat('[', string_agg(printf('%.4f', {c}), ', ' ORDER BY ts), ']') FROM (SELECT ts, {c} FROM a WHERE {c} < lo OR {c} > hi
  ORDER BY ts LIMIT {k})), '[]') AS extremes
FROM (SELECT lo, hi, (SELECT count({c}) FROM a) AS n, (SELECT count(*) FROM a WHERE {c} < lo OR {c} > hi) AS c
 FROM (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
 (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM a)))"""


def fenced(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "ts", "event_id", "value", "CASE WHEN user_id % 20 = 1 THEN -value * 9 ELSE value END AS wild", "value + user_id AS mild",
        "CASE WHEN event_id % 5 = 1 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) END AS even")


def _fences(columns, k):
    return _FENCED + " " + " UNION ALL ".join(_FENCES.replace("{c}", c).replace("{k}", str(k)) for c in columns)


_FENCE_COLUMNS = ("value", "wild", "mild", "even")


@query("a11_report_sheets", "WITH outliers AS (" + _fences(("value", "wild", "mild"), 6) + """), matrix AS (
SELECT 'value' AS col1, 'wild' AS col2, round(corr(value, wild), 4) AS r FROM (SELECT value, CASE WHEN user_id % 20 = 1 THEN -value * 9 ELSE value END AS wild, value + user_id AS mild FROM events) UNION ALL SELECT 'value' AS col1, 'mild' AS col2, round(corr(value, mild), 4) AS r FROM (SELECT value, CASE WHEN user_id % 20 = 1 THEN -value * 9 ELSE value END AS wild, value + user_id AS mild FROM events) UNION ALL SELECT 'wild' AS col1, 'mild' AS col2, round(corr(wild, mild), 4) AS r FROM (SELECT value, CASE WHEN user_id % 20 = 1 THEN -value * 9 ELSE value END AS wild, value + user_id AS mild FROM events)),
shares AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1)
SELECT 'outliers' AS sheet, concat_ws('|', "column", count, printf('%.2f', pct), printf('%.4f', lb), printf('%.4f', ub), severity,
 array_to_string(list_slice(string_split(replace(replace(extremes, '[', ''), ']', ''), ', '), 1, 3), ', ')) AS line FROM outliers UNION ALL
SELECT 'matrix', concat_ws('|', col1, col2, printf('%.4f', r)) FROM matrix UNION ALL
SELECT 'categories', concat_ws('|', 'event_type', row_number() OVER (ORDER BY n DESC, v), v, n, printf('%.2f', round(n / (SELECT count(*) FROM events) * 100, 2))) FROM shares""")
def a11_sheets(spark, sf):
    df, columns = fenced(spark, sf), ["value", "wild", "mild"]
    sheets = sinks.report_tables({
        "outliers": stats.iqr_outliers(df, columns, ["ts"]), "matrix": assoc.corr_pairs(df, columns),
        "categories": stats.category_profile(table(spark, sf, "events"), ["event_type"])})
    text = lambda c, digits: F.format_string(f"%.{digits}f", c)
    lines = {
        "outliers": ["column", F.col("count").cast("string"), text("pct", 2), text("lb", 4), text("ub", 4), "severity", "samples"],
        "matrix": ["col1", "col2", text("r", 4)],
        "categories": ["column", F.col("rank").cast("string"), "value", F.col("count").cast("string"), text("pct", 2)]}
    return stats.union_all([sheets[s].select(F.lit(s).alias("sheet"), F.concat_ws("|", *parts).alias("line")) for s, parts in lines.items()])


@query("g14_iqr_outliers", _fences(_FENCE_COLUMNS, 6).replace("(SELECT quantile_cont(even", "(SELECT quantile_cont(even :: DOUBLE"))
def g14(spark, sf):
    return stats.iqr_outliers(fenced(spark, sf), _FENCE_COLUMNS, ["ts"])


@query("g15_outlier_list", "SELECT \"column\", count AS outliers, round(pct, 1) AS pct, extremes FROM (" + _fences(_FENCE_COLUMNS, 3) + ") WHERE count > 0")
def g15(spark, sf):
    return ask.outlier_list(fenced(spark, sf), _FENCE_COLUMNS, ["ts"])


@query("g16_severity_tally", "SELECT severity, count(*) AS columns FROM (" + _fences(_FENCE_COLUMNS, 3) + ") GROUP BY 1")
def g16(spark, sf):
    return stats.severity_tally(stats.iqr_outliers(fenced(spark, sf), _FENCE_COLUMNS))


# ---- answers ------------------------------------------------------------------------------------------------------
_SQL_AGG = {"mean": "avg(v)", "sum": "sum(v)", "max": "max(v)", "min": "min(v)", "count": "count(v) :: DOUBLE",
            "median": "quantile_cont(v, 0.5)", "std": "stddev_samp(v)", "var": "var_samp(v)", "range": "max(v) - min(v)"}
HOWS = tuple(_SQL_AGG)


@query("g17_grouped_aggregate", GAPS_SQL + ", g AS (SELECT flag_gap AS k, price_k AS v FROM gaps WHERE flag_gap IS NOT NULL) "
       + " UNION ALL ".join(f"SELECT '{h}' AS how, k AS \"group\", round({_SQL_AGG[h]}, 3) AS value FROM g GROUP BY k" for h in HOWS))
def g17(spark, sf):
    df = gaps(spark, sf)
    return stats.union_all([ask.group_agg(df, "price_k", "flag_gap", h).select(F.lit(h).alias("how"), "group", "value") for h in HOWS])


@query("g17_top_groups", """SELECT p_brand AS "group", round(avg(l_extendedprice), 3) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
 GROUP BY 1 ORDER BY avg(l_extendedprice), 1 LIMIT 7""")
def g17_top(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = star_join(table(spark, sf, "lineitem"), [Dim(part, "l_partkey", "p_partkey", "part")], prune=False)
    return ask.group_agg(joined, "l_extendedprice", "p_brand", "mean", k=7, descending=False)


@query("g18_single_aggregate", GAPS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{h}' AS how, round({_SQL_AGG[h].replace('v)', 'price_k)').replace('(v,', '(price_k,')}, 4) AS value, count(price_k) AS used, "
    f"count(*) - count(price_k) AS nulls_excluded FROM gaps" for h in HOWS))
def g18(spark, sf):
    df = gaps(spark, sf)
    return stats.union_all([ask.single_agg(df, "price_k", h).withColumn("how", F.lit(h)) for h in HOWS])


@query("g19_all_columns_aggregate", GAPS_SQL + " " + each(NUMBERS, "round(quantile_cont({c}, 0.5), 3) AS value, count({c}) AS n", "gaps"))
def g19(spark, sf):
    return ask.all_columns_agg(gaps(spark, sf), "median", NUMBERS)


@query("g20_distinct_counts", GAPS_SQL + " SELECT *, CASE WHEN \"distinct\" > 50 THEN 'High' WHEN \"distinct\" > 10 THEN 'Medium' ELSE 'Low' END AS cardinality FROM ("
       + each(("l_linenumber", "l_quantity", "flag_gap", "padded", "ship_text", "price_k"), "count(DISTINCT {c}) AS \"distinct\"", "gaps") + ")")
def g20(spark, sf):
    return ask.unique_counts(gaps(spark, sf), ["l_linenumber", "l_quantity", "flag_gap", "padded", "ship_text", "price_k"])


@query("g21_percentage_breakdown", GAPS_SQL + """ SELECT ship_text AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM gaps) * 100, 2) AS pct
 FROM gaps GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15""")
def g21(spark, sf):
    return ask.value_shares(gaps(spark, sf), "ship_text", k=15)


@query("g22_summary_table", GAPS_SQL + " " + each(NUMBERS, """ count({c}) AS count, round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5), 3) AS median,
 round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(sum({c}), 2) AS sum""", "gaps"))
def g22(spark, sf):
    return ask.summary_table(gaps(spark, sf), NUMBERS)


@query("g23_frequency", GAPS_SQL + """ SELECT flag_gap AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM gaps) * 100, 1) AS pct
 FROM gaps WHERE flag_gap IS NOT NULL GROUP BY 1""")
def g23(spark, sf):
    return ask.value_shares(gaps(spark, sf), "flag_gap", digits=1)


@query("g23_record_count", "SELECT count(*) AS records FROM lineitem")
def g23_count(spark, sf):
    return ask.record_count(table(spark, sf, "lineitem"))


@query("g24_comparison", GAPS_SQL + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c} AS \"group\", avg(price_k) AS m FROM gaps WHERE {c} IS NOT NULL GROUP BY 2" for c in ("flag_gap", "number_text"))
    + """), r AS (SELECT category, "group", round(m, 3) AS value, (row_number() OVER (PARTITION BY category ORDER BY m DESC, "group")) :: INT AS rank
 FROM m WHERE m IS NOT NULL) SELECT * FROM r WHERE rank <= 15""")
def g24(spark, sf):
    return ask.comparison(gaps(spark, sf), "price_k", ["flag_gap", "number_text"], all_categories=True)


_FORMS = (("Avg", "mean", "avg", "AVERAGE"), ("Total", "sum", "sum", "SUM"), ("Max", "max", "max", "MAX"), ("Min", "min", "min", "MIN"))


@query("g25_measure_table", GAPS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{w} {c}' AS name, '{fn}' AS fn, round(nullif({sql}({c}), 0), 3) AS value, '{w}_{c} = {bi}(Table[{c}])' AS formula FROM gaps"
    for c in ("l_quantity", "price_k", "l_tax") for w, fn, sql, bi in _FORMS) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'Count {c}', 'count', count(DISTINCT {c}), 'Count_{c} = DISTINCTCOUNT(Table[{c}])' FROM gaps" for c in ("flag_gap", "padded")))
def g25(spark, sf):
    return ask.measures(gaps(spark, sf), ["l_quantity", "price_k", "l_tax"], ["flag_gap", "padded"])


@query("g26_measure_dictionary", _MODEL_SQL + " " + each(("Amount", "Boxes", "Cost_per_box"), """ round(sum({c}), 2) AS sum, round(avg({c}), 4) AS mean,
 round(quantile_cont({c}, 0.5), 4) AS median, round(min({c}), 4) AS min, round(max({c}), 4) AS max, count({c}) AS count""", "joined")
 + """ UNION ALL SELECT 'Profit', round(sum(Profit), 2), round(avg(Profit), 4), NULL, round(min(Profit), 4), round(max(Profit), 4), count(Profit) FROM joined
 UNION ALL SELECT 'Profit_Pct', NULL, round(avg(Profit_Pct), 4), round(quantile_cont(Profit_Pct, 0.5), 4), NULL, NULL, count(Profit_Pct) FROM joined""")
def g26(spark, sf):
    return join_model(_model_tables(spark, sf)).measures()


@query("g27_distribution_answer", _FENCED + """, q AS (SELECT quantile_cont(wild, 0.25) AS q1, quantile_cont(wild, 0.5) AS q2, quantile_cont(wild, 0.75) AS q3 FROM a)
SELECT 'wild' AS "column", round(avg(wild), 3) AS mean, round(any_value(q2), 3) AS median, round(stddev_samp(wild), 3) AS std, round(min(wild), 3) AS min,
 round(max(wild), 3) AS max, round(any_value(q1), 3) AS q1, round(any_value(q3), 3) AS q3, round(any_value(q3 - q1), 3) AS iqr, round(skewness(wild), 3) AS skewness,
 CASE WHEN skewness(wild) > 0.5 THEN 'Right-skewed' WHEN skewness(wild) < -0.5 THEN 'Left-skewed' ELSE 'Approximately symmetric' END AS shape,
 count(*) FILTER (WHERE wild < q1 - 1.5 * (q3 - q1) OR wild > q3 + 1.5 * (q3 - q1)) AS outliers,
 round(count(*) FILTER (WHERE wild < q1 - 1.5 * (q3 - q1) OR wild > q3 + 1.5 * (q3 - q1)) / count(wild) * 100, 1) AS outlier_pct,
 round(exp(-count(wild) / 12 * (pow(skewness(wild) * (count(wild) - 2) / sqrt(count(wild) * (count(wild) - 1)), 2) + pow(kurtosis_pop(wild), 2) / 4)), 6) AS normal_p,
 exp(-count(wild) / 12 * (pow(skewness(wild) * (count(wild) - 2) / sqrt(count(wild) * (count(wild) - 1)), 2) + pow(kurtosis_pop(wild), 2) / 4)) > 0.05 AS is_normal FROM a, q""")
def g27(spark, sf):
    return ask.distribution_answer(fenced(spark, sf), "wild")


@query("g28_column_summary", GAPS_SQL + " " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{m}' AS metric, round({e}, 3) AS value FROM gaps" for i, (m, e) in enumerate((
        ("Count", "count(price_k) :: DOUBLE"), ("Mean", "avg(price_k)"), ("Median", "quantile_cont(price_k, 0.5)"), ("Std Dev", "stddev_samp(price_k)"),
        ("Min", "min(price_k)"), ("Max", "max(price_k)"), ("Sum", "sum(price_k)"), ("Q25", "quantile_cont(price_k, 0.25)"), ("Q75", "quantile_cont(price_k, 0.75)")))))
def g28(spark, sf):
    return ask.column_summary(gaps(spark, sf), "price_k")


@query("g28_quick_stats", GAPS_SQL + " " + each(NUMBERS, "round(avg({c}), 2) AS mean, round(min({c}), 2) AS min, round(max({c}), 2) AS max, count({c}) AS count", "gaps"))
def g28_quick(spark, sf):
    return ask.quick_stats(gaps(spark, sf), NUMBERS)


@query("g28_general_stats", GAPS_SQL + " " + each(("price_k",), "round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5), 3) AS median, round(min({c}), 3) AS min, round(max({c}), 3) AS max", "gaps"))
def g28_general(spark, sf):
    return ask.general_stats(gaps(spark, sf), "price_k")


@query("g29_correlation_answer", _PAIRS + f""" SELECT col1, col2, r, round(r * r, 4) AS r2, {_STRENGTH} AS strength FROM pairs
 WHERE col1 = 'price_k' OR col2 = 'price_k' ORDER BY abs(r) DESC, col1, col2 LIMIT 15""")
def g29(spark, sf):
    return assoc.correlation_answer(assoc.corr_pairs(mixed(spark, sf), MIXED), "price_k")


_MISSING = "count(*) - count({c}), ' missing (', printf('%.1f', round((count(*) - count({c})) / count(*) * 100, 1)), '%)'"
_SPAN = "'Numbers from ', format('{{:,.2f}}', min({c})), ' to ', format('{{:,.2f}}', max({c})), ', mean ', format('{{:,.2f}}', avg({c})), ', '"


@query("g30_overview", GAPS_SQL + """ SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM gaps UNION ALL SELECT 'columns', '3' UNION ALL
SELECT 'numeric_columns', 'l_quantity, price_k' UNION ALL SELECT 'categorical_columns', 'flag_gap' UNION ALL
SELECT 'completeness', printf('%.2f%%', round((1 - (2 * count(*) - count(price_k) - count(flag_gap)) / (3 * count(*))) * 100, 2)) FROM gaps UNION ALL
SELECT 'column flag_gap', concat('Category of ', count(DISTINCT flag_gap), ' values, most often ',
 (SELECT flag_gap FROM gaps WHERE flag_gap IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), ', ', """ + _MISSING.format(c="flag_gap") + """) FROM gaps UNION ALL
SELECT 'column l_quantity', concat(""" + _SPAN.format(c="l_quantity") + ", " + _MISSING.format(c="l_quantity") + """) FROM gaps UNION ALL
SELECT 'column price_k', concat(""" + _SPAN.format(c="price_k") + ", " + _MISSING.format(c="price_k") + """) FROM gaps""")
def g30(spark, sf):
    return profile.overview(gaps(spark, sf).select("l_quantity", "price_k", "flag_gap"))


@query("w5_rank_values", "SELECT (row_number() OVER (ORDER BY v DESC)) :: INT AS rank, v AS value FROM (SELECT round(l_extendedprice, 4) AS v FROM lineitem ORDER BY 1 DESC LIMIT 25)")
def w5(spark, sf):
    return ask.rank_values(table(spark, sf, "lineitem"), "l_extendedprice", 25)


@query("w5_rank_categories", "SELECT (row_number() OVER (ORDER BY c, v)) :: INT AS rank, v AS value, c AS count FROM (SELECT p_brand AS v, count(*) AS c FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 10)")
def w5_categories(spark, sf):
    return ask.rank_categories(table(spark, sf, "part"), "p_brand", 10, ascending=True)


@query("w5_rank_groups", """SELECT (row_number() OVER (ORDER BY m DESC, g)) :: INT AS rank, g AS "group", round(m, 3) AS value
 FROM (SELECT p_brand AS g, avg(p_size) AS m FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""")
def w5_groups(spark, sf):
    return ask.rank_groups(table(spark, sf, "part"), "p_size", "p_brand", 10)


# ---- question tags ------------------------------------------------------------------------------------------------
def _intent_sql(mode):
    from plumbline.functions.text_rules import AGGREGATION_WORDS, INTENT_RULES
    w = r"[\p{L}\p{N}_]"
    end = rf"($|[^\p{{L}}\p{{N}}_])" if mode == "reference" else ""
    rules = " ".join(f"WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)}){end}') THEN '{name}'" for name, words in INTENT_RULES)
    words = "|".join(a for a, _ in AGGREGATION_WORDS)
    return f"CASE WHEN text IS NULL THEN NULL {rules} WHEN regexp_matches(lower(text), '{words}') THEN 'aggregation' ELSE 'general' END"


def _agg_sql():
    from plumbline.functions.text_rules import AGGREGATION_WORDS
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{n}'" for w, n in AGGREGATION_WORDS) + " END"


for _source, _keys in (("conversations", ("conv_id", "turn")), ("documents", ("doc_id",))):
    _listed = ", ".join(_keys)
    for _mode in ("reference", "stem"):
        query(f"q1_intent_{_mode}_{_source}", f"SELECT {_listed}, {_intent_sql(_mode)} AS intent FROM {_source}")(
            lambda spark, sf, t=_source, k=_keys, m=_mode: ask.tag_questions(table(spark, sf, t), "text", m).select(*k, "intent"))
    query(f"q2_aggregation_word_{_source}", f"SELECT {_listed}, {_agg_sql()} AS aggregation FROM {_source}")(
        lambda spark, sf, t=_source, k=_keys: ask.tag_questions(table(spark, sf, t)).select(*k, "aggregation"))
    query(f"q3_top_n_{_source}", f"SELECT {_listed}, CASE WHEN d = '' THEN 10 ELSE coalesce(try_cast(d AS BIGINT), 9223372036854775807) END AS top_n, a AS ascending "
          f"FROM (SELECT {_listed}, regexp_extract(text, '(^|[^\\p{{L}}\\p{{N}}_])([0-9]+)($|[^\\p{{L}}\\p{{N}}_])', 2) AS d, "
          f"regexp_matches(lower(text), 'bottom|lowest|worst|least|fewest|weakest') AS a FROM {_source})")(
        lambda spark, sf, t=_source, k=_keys: ask.tag_questions(table(spark, sf, t)).select(*k, "top_n", "ascending"))
