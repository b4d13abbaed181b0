"""Business rollups over the star join (inventory H)."""

from plumbline.operators import business, gates
from plumbline.operators.features import add_measures
from plumbline.operators.star import Dim, star_join
from plumbline.functions.expr import numeric_columns, text_columns

from suite.base import GAPS_SQL, SALES_SQL, gaps, money, query, table


def sales(spark, sf):
    """Line items with product, seller, order and customer attributes and derived profit."""
    nations = star_join(table(spark, sf, "nation"), [Dim(
        table(spark, sf, "region"), "n_regionkey", "r_regionkey", "region")], prune=False)
    customers = star_join(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), [Dim(
        nations.select("n_nationkey", "n_name", "r_name"), "c_nationkey", "n_nationkey", "nation")], prune=False)
    orders = star_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [Dim(
        customers.drop("c_nationkey"), "o_custkey", "c_custkey", "customer")], prune=False)
    fact = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice AS Amount", "l_quantity AS Boxes", "l_shipdate AS Shipdate")
    part = table(spark, sf, "part").selectExpr("p_partkey", "p_name AS Product", "p_type AS Category", "p_retailprice AS Cost_per_box")
    supplier = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name AS Sales_person")
    orders = orders.selectExpr("o_orderkey", "c_mktsegment AS Team", "n_name AS Geo", "r_name AS Region", "o_orderstatus AS Order_Status")
    joined = star_join(fact, [Dim(part, "l_partkey", "p_partkey", "part"), Dim(supplier, "l_suppkey", "s_suppkey", "supplier"),
                              Dim(orders, "l_orderkey", "o_orderkey", "orders")], prune=False)
    return add_measures(joined).drop("l_partkey", "l_suppkey")


_G = "round(sum(Amount), 2) AS total_amount"
_SHOW = money("round(sum(Amount), 2)") + " AS display"
_PCT = "round(avg(Profit_Pct), 2) AS profit_pct"
_SHARE = "round(sum(Amount) / (SELECT sum(Amount) FROM sales) * 100, 2)"


@query("h1_top_products", SALES_SQL + f""" SELECT Product AS name, {_G}, {_SHOW}, round(sum(Boxes), 2) AS total_boxes, {_PCT},
 {_SHARE} AS pct_of_total FROM sales WHERE Product IS NOT NULL GROUP BY 1 ORDER BY total_amount DESC, name LIMIT 12""")
def h1(spark, sf):
    return business.top_products(sales(spark, sf))


@query("h2_leaderboard", SALES_SQL + f""", top AS (SELECT Sales_person AS name, {_G}, {_SHOW}, round(sum(Boxes), 2) AS total_boxes,
 count(Amount) AS shipments, {_PCT} FROM sales WHERE Sales_person IS NOT NULL GROUP BY 1 ORDER BY total_amount DESC, name LIMIT 10)
SELECT *, (row_number() OVER (ORDER BY total_amount DESC, name)) :: INT AS rank FROM top""")
def h2(spark, sf):
    return business.leaderboard(sales(spark, sf))


@query("h3_amount_by_geo", SALES_SQL + f""" SELECT Geo AS name, {_G}, {_SHOW}, {_SHARE} AS pct, arg_min(Region, l_orderkey) AS region, {_PCT}
 FROM sales WHERE Geo IS NOT NULL GROUP BY 1""")
def h3(spark, sf):
    return business.amount_by_geo(sales(spark, sf), order_by=["l_orderkey"])


@query("h4_amount_by_category", SALES_SQL + f""" SELECT Category AS name, {_G}, {_SHOW}, {_SHARE} AS pct, {_PCT}
 FROM sales WHERE Category IS NOT NULL GROUP BY 1""")
def h4(spark, sf):
    return business.amount_by_category(sales(spark, sf))


_MONTHS = f"""months AS (SELECT strftime(Shipdate, '%Y-%m') AS month, {_G}, count(Amount) AS shipments,
 round(sum(Boxes), 2) AS total_boxes, round(sum(Profit), 2) AS total_profit FROM sales GROUP BY 1)"""


@query("h5_monthly_trend", SALES_SQL + ", " + _MONTHS + " SELECT * FROM months")
def h5(spark, sf):
    return business.monthly_trend(sales(spark, sf))


@query("h5_monthly_growth", SALES_SQL + ", " + _MONTHS + """ SELECT count(*) AS months, min(month) AS first_month, max(month) AS last_month,
 arg_min(total_amount, month) AS first_amount, arg_max(total_amount, month) AS last_amount,
 round((arg_max(total_amount, month) - arg_min(total_amount, month)) / abs(arg_min(total_amount, month)) * 100, 2) AS growth_pct FROM months""")
def h5_growth(spark, sf):
    return business.monthly_growth(sales(spark, sf))


_PRODUCT = f"""products AS (SELECT Product AS product, {_G}, {money('round(sum(Amount), 2)', '.1f')} AS display,
 round(sum(Profit), 2) AS total_profit, round(CASE WHEN sum(Amount) > 0 THEN sum(Profit) / sum(Amount) * 100 END, 2) AS profit_pct,
 coalesce(round(CASE WHEN sum(Amount) > 0 THEN sum(Profit) / sum(Amount) * 100 END, 2) > 0, false) AS profitable
 FROM sales WHERE Product IS NOT NULL GROUP BY 1)"""


@query("h6_product_profit", SALES_SQL + ", " + _PRODUCT + " SELECT * FROM products")
def h6(spark, sf):
    return business.product_profit(sales(spark, sf))


@query("h6_most_profitable", SALES_SQL + ", " + _PRODUCT + " SELECT * FROM products ORDER BY profit_pct DESC NULLS LAST, total_amount DESC, product LIMIT 1")
def h6_best(spark, sf):
    return business.most_profitable(sales(spark, sf))


@query("h7_status_breakdown", SALES_SQL + f""" SELECT Order_Status AS name, count(Amount) AS count,
 round(count(Amount) / (SELECT count(*) FROM sales) * 100, 2) AS pct_count, {_G}, {_SHOW}, {_SHARE} AS pct_amount
 FROM sales WHERE Order_Status IS NOT NULL GROUP BY 1""")
def h7(spark, sf):
    return business.status_breakdown(sales(spark, sf))


@query("h8_team_performance", SALES_SQL + f""" SELECT Team AS name, {_G}, {_SHOW}, {_SHARE} AS pct, count(Amount) AS shipments, {_PCT}
 FROM sales WHERE Team IS NOT NULL GROUP BY 1""")
def h8(spark, sf):
    return business.team_performance(sales(spark, sf))


def _big(c):
    return f"CASE WHEN {c} >= 1e6 THEN printf('%.1fM', {c} / 1e6) ELSE format('{{:,.0f}}', {c}) END"


@query("h9_business_kpis", SALES_SQL + f""" SELECT 0 AS position, 'Total Records' AS label, format('{{:,}}', count(*)) AS value, '15 columns' AS sub FROM sales UNION ALL
SELECT 1, 'Total Amount', concat('$', {_big('sum(Amount)')}), concat('avg $', format('{{:,.0f}}', avg(Amount)), '/shipment') FROM sales UNION ALL
SELECT 2, 'Total Boxes', {_big('sum(Boxes)')}, printf('avg %.0f boxes/shipment', avg(Boxes)) FROM sales UNION ALL
SELECT 3, 'Total Shipments', format('{{:,}}', count(*)), 'rows in fact table' FROM sales UNION ALL
SELECT 4, 'Total Profit', concat('$', {_big('sum(Profit)')}), CASE WHEN sum(Profit) > 0 THEN 'Positive overall' ELSE 'Negative overall' END FROM sales UNION ALL
SELECT 5, 'Avg Profit %', printf('%.1f%%', avg(Profit_Pct)), 'mean across all shipments' FROM sales UNION ALL
SELECT 6, 'Data Quality', printf('%.2f%%', round((1 - (count(*) - count(Profit_Pct)) / (count(*) * 15)) * 100, 2)), 'completeness' FROM sales""")
def h9(spark, sf):
    return business.business_kpis(sales(spark, sf))


@query("h10_generic_kpis", GAPS_SQL + """ SELECT 0 AS position, 'Total Records' AS label, format('{:,}', count(*)) AS value, '5 columns' AS sub FROM gaps UNION ALL
SELECT 1, 'Analysis Columns', '4', '1 categorical' UNION ALL
SELECT 2, 'Data Quality', printf('%.2f%%', round((1 - (5 * count(*) - count(l_quantity) - count(price_k) - count(disc_gap) - count(l_tax) - count(flag_gap)) / (count(*) * 5)) * 100, 2)), 'completeness' FROM gaps UNION ALL
SELECT 3, 'Columns Blocked', CAST((""" + " + ".join(f"((count(*) - count({c})) / count(*) * 100 > 20) :: INT" for c in ("l_quantity", "price_k", "disc_gap", "l_tax", "flag_gap")) + """) AS VARCHAR), 'by missing data gate' FROM gaps UNION ALL """ + " UNION ALL ".join(
    f"SELECT {4 + i}, '{c}', format('{{:,.2f}}', avg({c})), printf('σ=%.2f · n=%d', stddev_samp({c}), count({c})) FROM gaps"
    for i, c in enumerate(("l_quantity", "price_k", "disc_gap", "l_tax"))))
def h10(spark, sf):
    df = gaps(spark, sf).select("l_quantity", "price_k", "disc_gap", "l_tax", "flag_gap")
    return business.generic_kpis(df, numeric_columns(df), text_columns(df), blocked=[
        r["column"] for r in gates.column_gates(df, warn=False).where("status = 'BLOCK'").collect()])
