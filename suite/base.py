"""The registry and the inputs that queries and their SQL share."""

QUERIES, SQL = {}, {}

# Gaps, padding, numbers as text and booleans as text, derived from lineitem by the same text on both sides.
GAPS = """
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000 END AS price_k,
  CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE l_discount END AS disc_gap,
  CASE WHEN l_linenumber < 6 THEN NULL ELSE l_tax END AS tax_sparse,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS flag_gap,
  CASE WHEN l_linenumber = 1 THEN concat(' ', l_returnflag) WHEN l_linenumber = 2 THEN concat(l_returnflag, '  ')
       ELSE l_returnflag END AS padded,
  CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_linenumber AS STRING) END AS number_text,
  CASE WHEN l_discount > 0.05 THEN 'Yes' WHEN l_discount > 0.02 THEN 'no' WHEN l_discount > 0.01 THEN NULL
       ELSE 'TRUE' END AS yes_no,
  CASE WHEN l_linenumber = 4 THEN 'unknown' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS ship_text,
  CAST(7.5 AS DOUBLE) AS flat
"""
# Ordered measurements with and without gaps, derived from events; ts is a total order.
SERIES = """
  event_id, ts, event_type, user_id, value, value + CAST(event_id AS DOUBLE) / 100 AS drift,
  CASE WHEN user_id % 10 = 3 THEN NULL ELSE value * 2 END AS gappy,
  CAST(12 AS DOUBLE) - CAST(event_id AS DOUBLE) / 50 + value / 10 AS falling
"""
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
GAPS_SQL = f"WITH gaps AS (SELECT {GAPS} FROM lineitem)"
SERIES_SQL = f"WITH series AS (SELECT {SERIES} FROM events)"
SALES_SQL = """
WITH sales AS (
  SELECT l_orderkey, l_extendedprice AS Amount, l_quantity AS Boxes, l_shipdate AS Shipdate, p_name AS Product,
         p_type AS Category, p_retailprice AS Cost_per_box, s_name AS Sales_person, c_mktsegment AS Team,
         n_name AS Geo, r_name AS Region, o_orderstatus AS Order_Status,
         p_retailprice * l_quantity AS Cost, l_extendedprice - p_retailprice * l_quantity AS Profit,
         CASE WHEN l_extendedprice > 0
              THEN (l_extendedprice - p_retailprice * l_quantity) / l_extendedprice * 100 END AS Profit_Pct
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
"""


def query(name, sql=None):
    """Register a query under its inventory name, with its SQL text if it has one."""
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(GAPS))


def series(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_split(SERIES))


def _split(text):
    """Top-level items of a select list."""
    items, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items.append(text[start:i])
            start = i + 1
    return items + [text[start:]]


def each(columns, select, source, where=None):
    """UNION ALL of one SELECT per column; ``{c}`` in the text stands for the column."""
    tail = f" {where}" if where else ""
    return " UNION ALL ".join(
        "SELECT '" + c + "' AS \"column\", " + select.replace("{c}", c) + (f" FROM {source}" + tail).replace("{c}", c)
        for c in columns)


def money(c, small=".0f"):
    return (f"CASE WHEN {c} >= 1e6 THEN printf('$%.1fM', {c} / 1e6) WHEN {c} <> 0 THEN printf('$%{small}K', {c} / 1e3) "
            f"ELSE '—' END")
