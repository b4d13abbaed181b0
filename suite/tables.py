"""Sources, roles, profiles, gates and cleaning (inventory A-D)."""

from pyspark.sql import functions as F

from plumbline.operators import clean, features, gates, profile, roles
from plumbline.functions.store import new_folder
from plumbline.plans.model import join_model, split_dimensions
from plumbline.sources import files, sinks
from plumbline.sources.files import tidy
from plumbline.functions.expr import ratio, rounded

from suite.base import GAPS_SQL, LINE_ORDER, SERIES_SQL, each, gaps, query, series, table

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
GAP_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax",
               "price_k", "disc_gap", "tax_sparse", "flag_gap", "padded", "number_text", "yes_no", "ship_text", "flat")
GAP_TEXTS = ("flag_gap", "padded", "number_text", "yes_no", "ship_text")
GAP_NUMBERS = ("l_quantity", "l_discount", "l_tax", "price_k", "disc_gap", "tax_sparse", "flat")
TABLE_COLUMNS = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                "l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props",
}


@query("a5_structural_tidy", """
SELECT l_returnflag AS flag, count(*) AS rows, round(sum(q), 2) AS quantity
FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS l_returnflag,
             CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS q FROM lineitem)
WHERE l_returnflag IS NOT NULL OR q IS NOT NULL GROUP BY 1""")
def a5(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS ` flag `",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS `quantity `", "CAST(NULL AS STRING) AS `Unnamed: 3`")
    return tidy(raw).groupBy("flag").agg(F.count("*").alias("rows"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("a7_scan_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS label, (SELECT count(*) FROM {t}) AS rows, {TABLE_COLUMNS[t].count(',') + 1} AS columns, "
    f"'{TABLE_COLUMNS[t]}' AS first_columns, true AS needs_choice, true AS star_candidate" for t in ALL_TABLES))
def a7(spark, sf):
    return profile.catalog({t: table(spark, sf, t) for t in ALL_TABLES})


@query("a8_dataset_totals", "SELECT 8 :: BIGINT AS total_tables, sum(n) :: BIGINT AS total_rows FROM (" + " UNION ALL ".join(
    f"SELECT count(*) AS n FROM {t}" for t in ALL_TABLES) + ")")
def a8(spark, sf):
    return profile.catalog_totals(profile.catalog({t: table(spark, sf, t) for t in ALL_TABLES}))


_NULLS = " + ".join(f"count(*) - count({c})" for c in GAP_COLUMNS)


@query("a10_export_summary", GAPS_SQL + f""", n AS (SELECT count(*) AS rows, {_NULLS} AS nulls FROM gaps)
SELECT 0 AS position, 'Total Rows' AS metric, CAST(rows AS VARCHAR) AS value FROM n UNION ALL
SELECT 1, 'Total Columns', '17' UNION ALL SELECT 2, 'Numeric Columns', '11' UNION ALL
SELECT 3, 'Categorical Columns', '5' UNION ALL SELECT 4, 'Missing Values', CAST(nulls AS VARCHAR) FROM n UNION ALL
SELECT 5, 'Completeness %', printf('%.2f', round((1 - nulls / (rows * 17)) * 100, 2)) FROM n UNION ALL
SELECT 6, 'Export Date', '2001-12-31'""")
def a10(spark, sf):
    return profile.export_summary(gaps(spark, sf), "2001-12-31")


@query("a1_header_below_preamble", """
SELECT l_orderkey AS order_key, l_linenumber AS line, l_extendedprice AS price, l_returnflag AS flag FROM lineitem""")
def a1(spark, sf):
    top = spark.createDataFrame([(0, "Sales report"), (1, "2001,7"), (2, "order_key,line,price,flag")], "_line bigint, value string")
    body = table(spark, sf, "lineitem").selectExpr(
        "monotonically_increasing_id() + 10 AS _line", "concat_ws(',', l_orderkey, l_linenumber, l_extendedprice, l_returnflag) AS value")
    return files.table_of_lines(top.union(body))


@query("a6_side_by_side", """
SELECT 'customer_id' AS "table", c_custkey :: BIGINT AS key, c_mktsegment AS name FROM customer UNION ALL
SELECT 'supplier_id', s_suppkey, s_name FROM supplier""")
def a6(spark, sf):
    left = table(spark, sf, "customer").selectExpr("c_custkey AS k", "concat_ws(',', c_custkey, c_mktsegment) AS l")
    right = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "concat_ws(',', s_suppkey, s_name) AS r")
    rows = left.join(right, "k", "full").selectExpr("k + 10 AS _line", "concat(coalesce(l, ','), ',,', coalesce(r, ',')) AS value")
    top = spark.createDataFrame([(0, "customer_id,segment,,supplier_id,supplier")], "_line bigint, value string")
    found = files.tables_of_lines(top.union(rows))
    shape = lambda name, key, text: found[name].select(F.lit(name).alias("table"), F.col(key).alias("key"), F.col(text).alias("name"))
    return shape("customer_id", "customer_id", "segment").union(shape("supplier_id", "supplier_id", "supplier"))


@query("a2_encodings_of_files", r"SELECT doc_id, regexp_replace(text, '[^\x01-\xff]|\r', '?', 'g') AS text FROM documents")
def a2(spark, sf):
    """Half of the documents in UTF-8, half in Latin-1, as quoted CSV whose texts hold line breaks; every file is sniffed on its own."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[^\x01-\xff]|\r", "?").alias("text"))
    folders = []
    for half, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        folders.append(new_folder(spark, "a2"))
        docs.where(F.col("doc_id") % 2 == half).write.option("header", True).option("encoding", encoding).option("quoteAll", True).option("escape", '"').csv(folders[-1])
    return files.read_csv_sniffed(spark, folders, tidy_up=False)


@query("a3_json_records", "SELECT conv_id, turn, role, text FROM conversations")
def a3(spark, sf):
    """Records over several lines each, which many tasks cut apart."""
    folder = new_folder(spark, "a3")
    table(spark, sf, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"pretty": "true"}).alias("value")).write.text(folder)
    return files.read_json(spark, folder).select("conv_id", "turn", "role", "text")


@query("a9_written_table", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def a9(spark, sf):
    """A table written as CSV and read again."""
    folder = new_folder(spark, "a9")
    sinks.write_table(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"), folder, "csv")
    back = files.read_csv_sniffed(spark, folder)
    return back.select(*[F.col(c).cast(t) for c, t in table(spark, sf, "lineitem").select(back.columns).dtypes])


@query("e7_side_by_side_model", """SELECT o_orderkey AS order_no, CAST(o_totalprice AS DOUBLE) AS amount, c_mktsegment AS segment, n_name AS nation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def e7_side_by_side(spark, sf):
    """The dimensions stand next to each other in one file's lines and join the fact on their keys."""
    buyers = table(spark, sf, "customer")
    sales = table(spark, sf, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_no"), F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_id"), F.col("o_totalprice").cast("double").alias("amount"))
    left = buyers.selectExpr("c_custkey AS k", "concat_ws(',', c_custkey, c_mktsegment) AS l")
    right = table(spark, sf, "nation").selectExpr("n_nationkey + 1 AS k", "concat_ws(',', n_nationkey, n_name) AS r")
    rows = left.join(right, "k", "full").selectExpr("k + 10 AS _line", "concat(coalesce(l, ','), ',,', coalesce(r, ',')) AS value")
    top = spark.createDataFrame([(0, "customer_id,segment,,nation_id,nation")], "_line bigint, value string")
    tables = split_dimensions({"sales": sales, "sheet": rows}, "sales", {"sheet": files.tables_of_lines(top.union(rows))})
    return join_model(tables, "sales").df.select("order_no", "amount", "segment", "nation")


@query("a12_raw_extract", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped
FROM lineitem ORDER BY {', '.join(LINE_ORDER)}, l_extendedprice""")
def a12(spark, sf):
    return sinks.raw_extract(table(spark, sf, "lineitem"), LINE_ORDER + ["l_extendedprice"]).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS shipped")


@query("b1_classify_columns", """
SELECT * FROM (VALUES ('value', 'numeric'), ('user_id', 'numeric'), ('event_id', 'index'), ('event_type', 'categorical'),
 ('props', 'categorical'), ('ts', 'date')) t("column", role)
WHERE (role = 'index') = ("column" = 'event_id' AND (SELECT count(DISTINCT event_id) = count(*) AND
 max(event_id) - min(event_id) + 1 = count(*) FROM events))""")
def b1(spark, sf):
    return roles.roles_table(table(spark, sf, "events"))


@query("b2_row_index", each(("o_orderkey", "o_custkey"), """
 false AS by_name, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) + 1 = count(*) AS by_values,
 count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) + 1 = count(*) AS is_index""", "orders")
 + " UNION ALL SELECT 'o_totalprice', false, false, false")
def b2(spark, sf):
    return roles.row_index_table(table(spark, sf, "orders"))


_CODES = """WITH coded AS (SELECT c_custkey, c_name, c_acctbal,
  concat(substr(c_mktsegment, 1, 2), CAST(c_nationkey AS STRING)) AS seg_code,
  CASE WHEN c_acctbal > 0 THEN concat('S', CAST(100000 + c_custkey AS STRING)) ELSE c_name END AS long_code,
  c_mktsegment AS order_id_text FROM customer)"""
_CODE_SHARE = """avg(CASE WHEN regexp_full_match({c}, '[A-Z]{1,3}[0-9]{1,6}') THEN 1.0 ELSE 0 END)"""
_LONG_SHARE = """avg(CASE WHEN regexp_full_match({c}, '[A-Z][0-9]{5,}') THEN 1.0 ELSE 0 END)"""


@query("b3_key_columns", _CODES + " SELECT 'c_custkey' AS \"column\", false AS by_name, "
       "count(DISTINCT c_custkey) = count(*) AND max(c_custkey) - min(c_custkey) + 1 = count(*) AS by_values, "
       "NULL :: DOUBLE AS code_share, NULL :: DOUBLE AS long_code_share, "
       "count(DISTINCT c_custkey) = count(*) AND max(c_custkey) - min(c_custkey) + 1 = count(*) AS is_key FROM coded "
       "UNION ALL SELECT 'c_acctbal', false, false, NULL, NULL, false UNION ALL "
       + each(("c_name", "seg_code", "long_code"), f"false, false, round({_CODE_SHARE}, 4), round({_LONG_SHARE}, 4), "
              f"{_CODE_SHARE} > 0.8 OR {_LONG_SHARE} > 0.5", "coded")
       + f" UNION ALL SELECT 'order_id_text', true, false, round({_CODE_SHARE}, 4), round({_LONG_SHARE}, 4), true FROM coded"
       .replace("{c}", "order_id_text"))
def b3(spark, sf):
    coded = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name", "c_acctbal", "concat(substr(c_mktsegment, 1, 2), CAST(c_nationkey AS STRING)) AS seg_code",
        "CASE WHEN c_acctbal > 0 THEN concat('S', CAST(100000 + c_custkey AS STRING)) ELSE c_name END AS long_code",
        "c_mktsegment AS order_id_text")
    return roles.key_table(coded)


@query("b4_date_promotion", GAPS_SQL + """
SELECT CAST(CAST(try_cast(ship_text AS DATE) AS DATE) AS VARCHAR) AS shipped, count(*) AS rows FROM gaps
WHERE (SELECT count(try_cast(ship_text AS DATE)) > 0.6 * count(*) FROM gaps) GROUP BY 1""")
def b4(spark, sf):
    promoted = roles.promote_dates(gaps(spark, sf).select("flag_gap", "ship_text"))
    return promoted.groupBy(F.to_date("ship_text").cast("string").alias("shipped")).agg(F.count("*").alias("rows"))


_TYPES = {"l_orderkey": ("Numeric", "bigint"), "l_linenumber": ("Numeric", "int"), "l_partkey": ("Numeric", "bigint"),
          "l_suppkey": ("Numeric", "bigint"), "l_shipdate": ("Date/Time", "timestamp_ntz"),
          **{c: ("Numeric", "double") for c in GAP_NUMBERS}, **{c: ("Text", "string") for c in GAP_TEXTS}}


def _profile_sql(extra=""):
    parts = []
    for i, c in enumerate(GAP_COLUMNS):
        kind, dtype = _TYPES[c]
        hint = profile.HINTS[kind]
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, '{dtype}' AS dtype, "
                     f"count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 1) AS null_pct, "
                     f"count(DISTINCT {c}) AS \"unique\", '{hint}' AS agg_hint{extra.replace('{c}', c)} FROM gaps")
    return GAPS_SQL + " " + " UNION ALL ".join(parts)


@query("b5_schema_profile", _profile_sql(", 'lineitem' AS present_in, false AS is_source"))
def b5(spark, sf):
    return profile.schema_profile(gaps(spark, sf), sources=["lineitem"])


@query("b5_schema_samples", SERIES_SQL + """, known AS (
  SELECT 'value' AS "column", ts, printf('%.3f', value) AS v FROM series WHERE value IS NOT NULL UNION ALL
  SELECT 'gappy', ts, printf('%.3f', gappy) FROM series WHERE gappy IS NOT NULL UNION ALL
  SELECT 'event_type', ts, event_type FROM series), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY ts) AS pos FROM known)
SELECT "column", string_agg(v, ', ' ORDER BY pos) AS samples FROM ranked WHERE pos <= 3 GROUP BY 1""")
def b5_samples(spark, sf):
    df = series(spark, sf).select("ts", "value", "gappy", "event_type")
    return profile.schema_profile(df, order_by=["ts"]).where("column <> 'ts'").select("column", "samples")


@query("b7_answer_samples", SERIES_SQL + """, known AS (
  SELECT 0 AS position, 'value' AS "column", ts, printf('%.3f', value) AS v FROM series WHERE value IS NOT NULL UNION ALL
  SELECT 1, 'event_type', ts, event_type FROM series), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY ts) AS pos FROM known)
SELECT "column", CASE WHEN position = 0 THEN 'SUM/AVG' ELSE 'GROUP BY/COUNT' END AS agg_hint, string_agg(v, ', ' ORDER BY pos) AS samples
FROM ranked WHERE pos <= 3 GROUP BY ALL""")
def b7_samples(spark, sf):
    df = series(spark, sf).select("value", "event_type", "ts")
    return profile.schema_answer(df, ["ts"]).where("column <> 'ts'").select("column", "agg_hint", "samples")


@query("b7_schema_answer", "SELECT position, \"column\", type, dtype, null_pct, \"unique\", "
       "CASE WHEN type = 'Numeric' THEN 'SUM/AVG' ELSE 'GROUP BY/COUNT' END AS agg_hint FROM (" + _profile_sql() + ")")
def b7(spark, sf):
    return profile.schema_answer(gaps(spark, sf))


_UNDERSTOOD = ("user_id", "value", "gappy")


@query("b9_understanding", SERIES_SQL + " " + each(_UNDERSTOOD, """
  count({c}) AS present, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  round(min({c}) :: DOUBLE, 4) AS lo, round(max({c}) :: DOUBLE, 4) AS hi, round(avg({c}), 4) AS mean,
  NULL :: BIGINT AS "distinct", NULL :: VARCHAR AS top""", "series") + """ UNION ALL
SELECT 'event_type', count(event_type), count(*) - count(event_type), 0.0, NULL, NULL, NULL, count(DISTINCT event_type),
 (SELECT event_type FROM series GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) FROM series""")
def b9(spark, sf):
    df = series(spark, sf).select("user_id", "value", "gappy", "event_type")
    return profile.understanding(df).drop("description")


@query("b9_missing_summary", GAPS_SQL + ' SELECT * FROM (' + each(GAP_COLUMNS, """
  count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS pct""", "gaps") + ") WHERE missing > 0")
def b9_missing(spark, sf):
    return profile.missing_table(gaps(spark, sf))


@query("b9_anomalies", """
WITH a AS (SELECT CASE WHEN l_tax > 0.03 THEN 0 ELSE l_tax END AS half_zero, l_extendedprice - 5000 AS net_amount,
  CASE WHEN l_orderkey % 50 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spiky FROM lineitem),
f AS (SELECT quantile_cont(spiky, 0.25) - 3 * (quantile_cont(spiky, 0.75) - quantile_cont(spiky, 0.25)) AS lo,
  quantile_cont(spiky, 0.75) + 3 * (quantile_cont(spiky, 0.75) - quantile_cont(spiky, 0.25)) AS hi FROM a)
SELECT * FROM (
SELECT 'spiky' AS "column", 'extreme_outliers' AS "check", count(*) AS rows FROM a, f WHERE spiky < lo OR spiky > hi UNION ALL
SELECT 'net_amount', 'negative_values', count(*) FROM a WHERE net_amount < 0 UNION ALL
SELECT 'half_zero', 'mostly_zero', count(*) FROM a WHERE half_zero = 0) WHERE rows > 0""")
def b9_anomalies(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_tax > 0.03 THEN CAST(0 AS DOUBLE) ELSE l_tax END AS half_zero", "l_extendedprice - 5000 AS net_amount",
        "CASE WHEN l_orderkey % 50 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spiky")
    return profile.anomalies(df).drop("detail")


@query("b12_schema_browse", "SELECT \"column\", type, \"unique\" FROM (" + _profile_sql() +
       ") WHERE type = 'Text' AND contains(lower(\"column\"), 'text')")
def b12(spark, sf):
    return profile.browse_schema(profile.schema_profile(gaps(spark, sf)), "Text", "TEXT").select("column", "type", "unique")


@query("b12_schema_counts", "SELECT type, count(*) AS columns FROM (" + _profile_sql() + ") GROUP BY 1")
def b12_counts(spark, sf):
    return profile.schema_class_counts(profile.schema_profile(gaps(spark, sf)))


@query("c1_c3_dataset_gates", GAPS_SQL + f""", n AS (SELECT count(*) AS rows, {_NULLS} AS nulls,
  {' + '.join(f'(CASE WHEN (count(*) - count({c})) / count(*) * 100 <= 20 THEN 1 ELSE 0 END)' for c in GAP_COLUMNS)} AS kept FROM gaps)
SELECT 0 AS position, 'min_rows' AS gate, rows :: DOUBLE AS value, 5.0 :: DOUBLE AS threshold, rows >= 5 AS passed,
  CASE WHEN rows >= 5 THEN 'PASS' ELSE 'BLOCK' END AS status FROM n UNION ALL
SELECT 1, 'dataset_missing', round(nulls / (rows * 17) * 100, 2), 60.0, nulls / (rows * 17) * 100 <= 60,
  CASE WHEN nulls / (rows * 17) * 100 <= 60 THEN 'PASS' ELSE 'BLOCK' END FROM n UNION ALL
SELECT 2, 'columns_left', kept, 1.0, kept > 0, CASE WHEN kept > 0 THEN 'PASS' ELSE 'BLOCK' END FROM n""")
def c1(spark, sf):
    return gates.dataset_gates(gaps(spark, sf)).drop("reason")


@query("c2_missing_gate_blocks", f"""
WITH s AS (SELECT CASE WHEN l_linenumber > 2 THEN NULL ELSE l_tax END AS a, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_tax END AS b
 FROM lineitem), n AS (SELECT count(*) AS rows, (2 * count(*) - count(a) - count(b)) / (2 * count(*)) * 100 AS pct FROM s)
SELECT m AS combined, round(pct, 2) AS value, lim AS threshold, pct <= lim AS passed
FROM n, (VALUES (false, 60.0 :: DOUBLE), (true, 75.0 :: DOUBLE)) t(m, lim)""")
def c2(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber > 2 THEN NULL ELSE l_tax END AS a", "CASE WHEN l_linenumber > 3 THEN NULL ELSE l_tax END AS b",
        "l_orderkey AS _source")
    both = [gates.dataset_gates(df, m).where("gate = 'dataset_missing'").select(
        F.lit(m).alias("combined"), "value", "threshold", "passed") for m in (False, True)]
    return both[0].unionByName(both[1])


def _column_gate_sql():
    parts = []
    for c in GAP_COLUMNS:
        share = (f"round(avg(CASE WHEN try_cast(trim({c}) AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (WHERE {c} IS NOT NULL), 4)"
                 if c in GAP_TEXTS else "NULL :: DOUBLE")
        flat = f"(count(*) - count({c})) / count(*) * 100 <= 20 AND count({c}) >= 2 AND min({c}) = max({c})" if (
            _TYPES[c][0] == "Numeric") else "false"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
                     f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, {share} AS numeric_share, "
                     f"{flat} AS zero_variance, CASE WHEN (count(*) - count({c})) / count(*) * 100 > 20 OR ({flat}) THEN 'BLOCK' "
                     f"ELSE 'PASS' END AS status FROM gaps")
    return GAPS_SQL + " " + " UNION ALL ".join(parts)


@query("c3_column_missing_gate", f"SELECT \"column\", null_count, null_pct, status FROM ({_column_gate_sql()})")
def c3(spark, sf):
    return gates.column_gates(gaps(spark, sf), warn=False).select("column", "null_count", "null_pct", "status")


@query("c4_numeric_as_text", f"SELECT \"column\", numeric_share, null_pct <= 20 AND numeric_share > 0.7 AS warned "
       f"FROM ({_column_gate_sql()}) WHERE numeric_share IS NOT NULL")
def c4(spark, sf):
    return gates.column_gates(gaps(spark, sf)).where("numeric_share IS NOT NULL").select(
        "column", "numeric_share", F.col("warning").isNotNull().alias("warned"))


@query("c5_zero_variance_gate", f"SELECT \"column\", zero_variance FROM ({_column_gate_sql()})")
def c5(spark, sf):
    return gates.column_gates(gaps(spark, sf)).select("column", "zero_variance")


@query("c3_gate_trace", f"SELECT concat('column:', \"column\") AS step, status FROM ({_column_gate_sql()}) UNION ALL "
       "SELECT concat('gate:', g), CASE WHEN ok THEN 'PASS' ELSE 'BLOCK' END FROM (" + GAPS_SQL + f", n AS (SELECT count(*) AS rows, {_NULLS} AS nulls FROM gaps), "
       f"k AS (SELECT count(*) FILTER (WHERE null_pct <= 20) AS kept FROM ({_column_gate_sql()})) "
       "SELECT unnest(['min_rows', 'dataset_missing', 'columns_left']) AS g, unnest([rows >= 5, nulls / (rows * 17) * 100 <= 60, kept > 0]) AS ok FROM n, k)")
def c3_trace(spark, sf):
    return gates.gate_trace(gaps(spark, sf), "lineitem").select("step", "status")


_PRICED = """
WITH priced AS (SELECT l_extendedprice - 5000 AS net_amount, l_quantity AS qty, l_discount * 100 AS discount_pct,
  l_tax * 2000 AS tax_rate, l_shipdate AS shipped, CAST(3 AS DOUBLE) AS fixed FROM lineitem)
"""


def priced(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_extendedprice - 5000 AS net_amount", "l_quantity AS qty", "l_discount * 100 AS discount_pct",
        "l_tax * 2000 AS tax_rate", "l_shipdate AS shipped", "CAST(3 AS DOUBLE) AS fixed")


@query("c7_extreme_outliers", """
WITH a AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spiky, l_tax FROM lineitem),
f AS (SELECT quantile_cont(spiky, 0.25) AS q1, quantile_cont(spiky, 0.75) AS q3 FROM a)
SELECT 'spiky' AS "column", count(*) AS count FROM a, f WHERE spiky < q1 - 3 * (q3 - q1) OR spiky > q3 + 3 * (q3 - q1)""")
def c7(spark, sf):
    from plumbline.operators import stats
    return stats.extreme_outliers(table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 50 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spiky", "l_tax"))


@query("c8_sign_checks", _PRICED + " SELECT *, CASE WHEN rows > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ("
       + each(("net_amount", "qty", "discount_pct", "tax_rate"), "'sign' AS \"check\", count(*) FILTER (WHERE {c} < 0) AS rows", "priced") + ")")
def c8(spark, sf):
    return gates.sign_checks(priced(spark, sf)).drop("detail")


@query("c9_zero_inflation", "WITH z AS (SELECT CASE WHEN l_linenumber > 3 THEN 0 ELSE l_tax END AS often, l_tax AS rarely FROM lineitem) "
       "SELECT \"column\", n, zero_pct FROM (" + each(("often", "rarely"),
       "count({c}) AS n, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END) * 100, 1) AS zero_pct, "
       "avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END) AS share", "z") + ") WHERE share > 0.5")
def c9(spark, sf):
    return gates.zero_inflation(table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber > 3 THEN CAST(0 AS DOUBLE) ELSE l_tax END AS often", "l_tax AS rarely"))


@query("c10_percentage_range", _PRICED + " SELECT *, CASE WHEN rows > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM ("
       + each(("discount_pct", "tax_rate"), "'percentage_range' AS \"check\", count(*) FILTER (WHERE {c} < 0 OR {c} > 100) AS rows", "priced") + ")")
def c10(spark, sf):
    return gates.percentage_checks(priced(spark, sf)).drop("detail")


@query("c11_future_dates", _PRICED + """ SELECT 'future_date' AS "check", 'shipped' AS "column",
 CASE WHEN count(*) FILTER (WHERE shipped > TIMESTAMP '2001-06-30') > 0 THEN 'WARN' ELSE 'PASS' END AS status,
 count(*) FILTER (WHERE shipped > TIMESTAMP '2001-06-30') AS rows FROM priced""")
def c11(spark, sf):
    return gates.future_date_checks(priced(spark, sf), "2001-06-30 00:00:00").drop("detail")


@query("c12_constant_columns", _PRICED + """ SELECT * FROM (""" + each(
    ("net_amount", "qty", "discount_pct", "tax_rate", "fixed"),
    "'constant' AS \"check\", 'WARN' AS status, CASE WHEN count({c}) > 5 AND min({c}) = max({c}) THEN count({c}) END AS rows", "priced")
    + ") WHERE rows IS NOT NULL")
def c12(spark, sf):
    return gates.constant_checks(priced(spark, sf)).drop("detail")


@query("c13_residual_nulls", GAPS_SQL + f""", n AS (SELECT {_NULLS} AS nulls, ({_NULLS}) / (count(*) * 17) * 100 AS pct FROM gaps)
SELECT 'residual_nulls' AS "check", 'ALL' AS "column", nulls AS rows,
 CASE WHEN pct = 0 THEN 'PASS' WHEN pct < 5 THEN 'WARN' ELSE 'FAIL' END AS status FROM n""")
def c13(spark, sf):
    return gates.residual_null_check(gaps(spark, sf)).drop("detail")


@query("c13_overall_verdict", _PRICED + """, r AS (SELECT count(*) FILTER (WHERE net_amount < 0) AS neg,
  count(*) FILTER (WHERE tax_rate > 100) AS over, count(*) FILTER (WHERE shipped > TIMESTAMP '2001-06-30') AS future,
  """ + " + ".join(f"(count({c}) > 5 AND min({c}) = max({c})) :: BIGINT" for c in ("net_amount", "qty", "discount_pct", "tax_rate", "fixed")) + """ AS same FROM priced)
SELECT (neg > 0) :: BIGINT + same AS failures, (over > 0) :: BIGINT + (future > 0) :: BIGINT AS warnings,
  8 - (neg > 0) :: BIGINT - (over > 0) :: BIGINT - (future > 0) :: BIGINT AS passed, CASE WHEN neg > 0 OR same > 0 THEN 'HAS ISSUES' ELSE 'CLEAN' END AS overall FROM r""")
def c13_verdict(spark, sf):
    return gates.overall_verdict(gates.quality_checks(priced(spark, sf), "2001-06-30 00:00:00"))


@query("c14_completeness", GAPS_SQL + f" SELECT round((1 - ({_NULLS}) / (count(*) * 17)) * 100, 2) AS completeness_pct FROM gaps")
def c14(spark, sf):
    return profile.completeness(gaps(spark, sf))


_DOUBLED = "SELECT l_returnflag, l_linestatus, l_quantity, l_tax, CAST(l_shipdate AS DATE) AS d FROM lineitem"


def doubled(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "CAST(l_shipdate AS DATE) AS d")


@query("c15_duplicate_rows", f"SELECT ((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DOUBLED})))) AS duplicates")
def c15(spark, sf):
    return profile.duplicate_rows(doubled(spark, sf))


@query("c16_missing_table", GAPS_SQL + " SELECT * FROM (" + each(GAP_COLUMNS, """
  count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS pct""", "gaps") + ") WHERE missing > 0")
def c16(spark, sf):
    return profile.missing_table(gaps(spark, sf), digits=1)


@query("d1_trim_strings", GAPS_SQL + " SELECT trim(padded) AS padded, count(*) AS rows FROM gaps GROUP BY 1")
def d1(spark, sf):
    return clean.trim_strings(gaps(spark, sf)).groupBy("padded").agg(F.count("*").alias("rows"))


@query("d1_trim_report", GAPS_SQL + " SELECT * FROM (" + each(GAP_TEXTS, "count(*) FILTER (WHERE {c} <> trim({c})) AS changed", "gaps")
       + ") WHERE changed > 0")
def d1_report(spark, sf):
    return clean.trim_report(gaps(spark, sf))


@query("d2_drop_empty_rows", GAPS_SQL + """ SELECT flag_gap, count(*) AS rows FROM gaps
WHERE flag_gap IS NOT NULL OR price_k IS NOT NULL OR disc_gap IS NOT NULL GROUP BY 1""")
def d2(spark, sf):
    return clean.drop_empty_rows(gaps(spark, sf).select("flag_gap", "price_k", "disc_gap")).groupBy("flag_gap").agg(
        F.count("*").alias("rows"))


@query("d3_drop_duplicates", f"SELECT l_returnflag, count(*) AS rows FROM (SELECT DISTINCT * FROM ({_DOUBLED})) GROUP BY 1")
def d3(spark, sf):
    return clean.dedupe(doubled(spark, sf)).groupBy("l_returnflag").agg(F.count("*").alias("rows"))


@query("d3_duplicate_report", f"SELECT n AS rows_before, d AS rows_after, n - d AS removed FROM (SELECT (SELECT count(*) FROM lineitem) AS n, "
       f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DOUBLED}))) AS d)")
def d3_report(spark, sf):
    return clean.dedupe_report(doubled(spark, sf))


@query("d4_median_impute", GAPS_SQL + """ SELECT l_linenumber,
 round(sum(coalesce(price_k, (SELECT quantile_cont(price_k, 0.5) FROM gaps))), 3) AS price_k,
 round(sum(coalesce(disc_gap, (SELECT quantile_cont(disc_gap, 0.5) FROM gaps))), 3) AS disc_gap FROM gaps GROUP BY 1""")
def d4(spark, sf):
    filled = clean.impute(gaps(spark, sf).select("l_linenumber", "price_k", "disc_gap"))
    return filled.groupBy("l_linenumber").agg(*[F.round(F.sum(c), 3).alias(c) for c in ("price_k", "disc_gap")])


_WIDE = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN NULL ELSE 9007199254740992 + l_orderkey * 2 + 1 END AS wide_key,
 CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(20, 2)) + 90071992547409.93 END AS price FROM lineitem"""


@query("d4_exact_values", f"""WITH w AS ({_WIDE}) SELECT l_orderkey, l_linenumber, CAST(wide_key AS VARCHAR) AS wide_key, CAST(price AS VARCHAR) AS price
FROM w WHERE wide_key IS NOT NULL AND price IS NOT NULL""")
def d4_exact(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("d4_lineitem")
    filled = clean.impute(spark.sql(_WIDE.replace("FROM lineitem", "FROM d4_lineitem")), ["wide_key", "price"])
    kept = filled.where("l_linenumber NOT IN (5, 6)")
    return kept.select("l_orderkey", "l_linenumber", F.regexp_replace(F.col("wide_key").cast("string"), r"\.0+$", "").alias("wide_key"),
                       F.col("price").cast("decimal(20,2)").cast("string").alias("price"))


@query("d4_impute_report", GAPS_SQL + """ SELECT 'price_k' AS "column", 'median' AS method,
 printf('%.4f', quantile_cont(price_k, 0.5)) AS value, count(*) - count(price_k) AS filled,
 round((count(*) - count(price_k)) / count(*) * 100, 2) AS missing_pct FROM gaps UNION ALL
SELECT 'flag_gap', 'mode', (SELECT flag_gap FROM gaps WHERE flag_gap IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 count(*) - count(flag_gap), round((count(*) - count(flag_gap)) / count(*) * 100, 2) FROM gaps""")
def d4_report(spark, sf):
    return clean.impute_report(gaps(spark, sf).select("l_linenumber", "price_k", "flag_gap", "tax_sparse"), limit_pct=30.0)


@query("d5_mode_impute", GAPS_SQL + """ SELECT coalesce(flag_gap, (SELECT flag_gap FROM gaps WHERE flag_gap IS NOT NULL
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag_gap, count(*) AS rows FROM gaps GROUP BY 1""")
def d5(spark, sf):
    return clean.impute(gaps(spark, sf).select("flag_gap", "l_tax")).groupBy("flag_gap").agg(F.count("*").alias("rows"))


@query("d6_high_missing", GAPS_SQL + " SELECT \"column\", null_count, missing_pct FROM (" + each(GAP_COLUMNS, """
 count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
 (count(*) - count({c})) / count(*) * 100 AS raw""", "gaps") + ") WHERE raw > 30")
def d6(spark, sf):
    return clean.high_missing(gaps(spark, sf))


@query("d7_booleans", GAPS_SQL + """ SELECT CASE WHEN lower(yes_no) IN ('yes', 'true') THEN 1 WHEN lower(yes_no) = 'no' THEN 0 END AS yes_no,
 flag_gap, count(*) AS rows FROM gaps GROUP BY 1, 2""")
def d7(spark, sf):
    return clean.standardise_booleans(gaps(spark, sf).select("yes_no", "flag_gap")).groupBy("yes_no", "flag_gap").agg(
        F.count("*").alias("rows"))


@query("d8_numeric_coercion", GAPS_SQL + " SELECT try_cast(number_text AS DOUBLE) AS number_text, count(*) AS rows FROM gaps GROUP BY 1")
def d8(spark, sf):
    return clean.coerce_numbers(gaps(spark, sf), ["number_text"]).groupBy("number_text").agg(F.count("*").alias("rows"))


@query("d9_complete_rows", GAPS_SQL + """ SELECT l_linenumber, count(*) AS rows FROM gaps
WHERE price_k IS NOT NULL AND disc_gap IS NOT NULL GROUP BY 1""")
def d9(spark, sf):
    return clean.complete_rows(gaps(spark, sf), ["price_k", "disc_gap"]).groupBy("l_linenumber").agg(F.count("*").alias("rows"))


@query("d10_measures", """
SELECT p_type, round(sum(cost), 2) AS cost, round(sum(amount - cost), 2) AS profit,
 round(avg(CASE WHEN amount > 0 THEN (amount - cost) / amount * 100 END), 4) AS profit_pct
FROM (SELECT p_type, p_retailprice * l_quantity AS cost,
      CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS amount
      FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def d10(spark, sf):
    from plumbline.operators.star import Dim, star_join
    fact = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "l_quantity AS Boxes", "CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS Amount")
    part = table(spark, sf, "part").selectExpr("p_partkey", "p_type", "p_retailprice AS Cost_per_box")
    sold = features.add_measures(star_join(fact, [Dim(part, "l_partkey", "p_partkey", "part")], prune=False))
    return sold.groupBy("p_type").agg(
        F.round(F.sum("Cost"), 2).alias("cost"), F.round(F.sum("Profit"), 2).alias("profit"),
        F.round(F.avg("Profit_Pct"), 4).alias("profit_pct"))


@query("d11_sanitise", """
SELECT l_linenumber, count(*) AS rows, count(v) AS finite, round(sum(v), 3) AS total, round(sum(share), 3) AS share
FROM (SELECT l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE l_tax END AS v,
      CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS share FROM lineitem) GROUP BY 1""")
def d11(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        "l_linenumber", "l_tax", "l_discount", "CASE l_linenumber WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') "
        "WHEN 3 THEN double('-Infinity') ELSE l_tax END AS v")
    safe = clean.sanitise(raw).withColumn("share", ratio(F.col("l_tax"), F.col("l_discount")))
    return safe.groupBy("l_linenumber").agg(
        F.count("*").alias("rows"), F.count("v").alias("finite"), rounded(F.sum("v"), 3).alias("total"),
        rounded(F.sum("share"), 3).alias("share"))


@query("d12_pair_ratios", """
SELECT l_linenumber, round(sum(l_quantity / l_linenumber), 3) AS quantity_per_line,
 round(sum(l_linenumber / l_quantity), 3) AS line_per_quantity FROM lineitem GROUP BY 1""")
def d12(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_quantity", "CAST(l_linenumber AS DOUBLE) AS line", "l_tax")
    both = features.ratios(df, ["line", "l_quantity", "l_tax"]).withColumn(
        "back", F.col("l_quantity") / F.col("line"))
    return both.groupBy(F.col("line").cast("int").alias("l_linenumber")).agg(
        F.round(F.sum("back"), 3).alias("quantity_per_line"), F.round(F.sum("line_per_l_quantity"), 3).alias("line_per_quantity"))


@query("d13_zscores", GAPS_SQL + """, m AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(price_k) AS pa,
 stddev_samp(price_k) AS ps FROM gaps)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - a) / s, 6) AS l_quantity_zscore,
 round((price_k - pa) / ps, 6) AS price_k_zscore FROM gaps, m""")
def d13(spark, sf):
    scored = features.zscores(gaps(spark, sf), ["l_quantity", "price_k", "flat"])
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[
        F.round(c, 6).alias(c) for c in ("l_quantity_zscore", "price_k_zscore")])


@query("d14_date_parts", """
SELECT year(l_shipdate) :: INT AS l_shipdate_year, month(l_shipdate) :: INT AS l_shipdate_month,
 (isodow(l_shipdate) - 1) :: INT AS l_shipdate_dow, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3""")
def d14(spark, sf):
    return features.date_parts(table(spark, sf, "lineitem")).groupBy(
        "l_shipdate_year", "l_shipdate_month", "l_shipdate_dow").agg(F.count("*").alias("rows"))


@query("d12_feature_table", """SELECT * FROM (VALUES ('value_pct_change', 'Growth Rate'), ('drift_pct_change', 'Growth Rate'),
 ('value_ma5', 'Moving Average'), ('drift_ma5', 'Moving Average'), ('value_per_drift', 'Ratio'), ('value_zscore', 'Z-Score'),
 ('drift_zscore', 'Z-Score'), ('ts_year / _month / _dow', 'Date Decomposition')) t(name, type)
 WHERE (SELECT count(*) FROM events) >= 20""")
def d12_features(spark, sf):
    return features.feature_table(series(spark, sf), ["value", "drift"], ["ts"]).select("name", "type")
