"""Business rollups over a joined table. Columns are found by role; every rollup is one grouped aggregate.

Grand totals are read back from the grouped rows (a scalar subquery over the same shuffle), not from a second
scan of the table.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.expr import col, finite, first_by, grouped_digits, money, ratio, rounded
from plumbline.functions.names import default_roles


def roles_of(df, roles=None):
    """The given roles, completed by name matching on the table's columns."""
    return {**default_roles(df.columns), **(roles or {})}


def _measures(roles, *wanted, order_by=()):
    amount = finite(col(roles["amount"]))
    optional = {
        "total_boxes": lambda: F.sum(finite(col(roles["boxes"]))) if roles.get("boxes") else None,
        "avg_profit_pct": lambda: F.avg(finite(col(roles["profit_pct"]))) if roles.get("profit_pct") else None,
        "total_profit": lambda: F.coalesce(F.sum(finite(col(roles["profit"]))), F.lit(0.0)) if roles.get("profit") else None,
        "shipments": lambda: F.count(amount),
        "region": lambda: first_by(col(roles["region"]), order_by) if roles.get("region") and order_by else (
            F.min(col(roles["region"])) if roles.get("region") else None),
    }
    out = [F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount")]
    for name in wanted:
        made = optional[name]()
        out.append((F.lit(None).cast("double") if made is None else made).alias(name))
    return out


def _grouped(df, roles, role, *wanted, order_by=(), keep_null=False):
    """One aggregate per value of a role. ``known`` tells the null group apart from the others."""
    key = col(roles[role]).cast("string")
    source = df if keep_null else df.where(key.isNotNull())
    return source.groupBy(key.alias("name")).agg(
        *_measures(roles, *wanted, order_by=order_by), F.max(key.isNotNull()).alias("known"))


def _totals(grouped):
    """Grand totals of the grouped rows as a one-row subquery.

    It mentions every grouped column, so that its aggregate and the query's are the same and share one shuffle.
    """
    numbers = [c for c in grouped.columns if c in ("amount", "shipments")]
    others = [c for c in grouped.columns if c not in numbers]
    return grouped.agg(F.struct(*[F.sum(c).alias(c) for c in numbers], *[F.count(c).alias(c) for c in others]).alias("t")).scalar()


def _amount():
    return rounded(F.col("amount"), 2)


def _profit_pct():
    return rounded(F.col("avg_profit_pct"), 2).alias("profit_pct")


def top_products(df, roles=None, k=12):
    """H1: share is of the whole table's amount, rows without a product included."""
    roles = roles_of(df, roles)
    grouped = _grouped(df, roles, "product", "total_boxes", "avg_profit_pct", keep_null=True)
    return grouped.withColumn("all", _totals(grouped)).where("known").select(
        "name", _amount().alias("total_amount"), money(_amount()).alias("display"),
        rounded(F.col("total_boxes"), 2).alias("total_boxes"), _profit_pct(),
        rounded(ratio(_amount(), F.round(F.col("all.amount"), 2)) * 100, 2).alias("pct_of_total"),
    ).orderBy(F.desc("total_amount"), "name").limit(k)


def leaderboard(df, roles=None, k=10):
    """H2: the rank is given after the limit, over k rows."""
    roles = roles_of(df, roles)
    top = _grouped(df, roles, "person", "shipments", "total_boxes", "avg_profit_pct").select(
        "name", _amount().alias("total_amount"), money(_amount()).alias("display"),
        rounded(F.col("total_boxes"), 2).alias("total_boxes"), "shipments", _profit_pct(),
    ).orderBy(F.desc("total_amount"), "name").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_amount"), "name")))


def _shares(grouped, *extra):
    return grouped.withColumn("all", _totals(grouped)).select(
        "name", _amount().alias("total_amount"), money(_amount()).alias("display"),
        rounded(ratio(_amount(), F.col("all.amount")) * 100, 2).alias("pct"), *extra,
    ).orderBy(F.desc("total_amount"), "name")


def amount_by_geo(df, roles=None, order_by=()):
    """H3: region is the first one in row order (the smallest without an order)."""
    roles = roles_of(df, roles)
    return _shares(_grouped(df, roles, "geo", "region", "avg_profit_pct", order_by=order_by), "region", _profit_pct())


def amount_by_category(df, roles=None):
    """H4."""
    return _shares(_grouped(df, roles_of(df, roles), "category", "avg_profit_pct"), _profit_pct())


def team_performance(df, roles=None):
    """H8."""
    return _shares(_grouped(df, roles_of(df, roles), "team", "shipments", "avg_profit_pct"), "shipments", _profit_pct())


def _by_month(df, roles):
    month = F.date_format(col(roles["date"]).cast("timestamp_ntz"), "yyyy-MM")
    return df.where(month.isNotNull()).groupBy(month.alias("month")).agg(
        *_measures(roles, "shipments", "total_boxes", "total_profit"))


def monthly_trend(df, roles=None):
    """H5: one row per month."""
    roles = roles_of(df, roles)
    return _by_month(df, roles).select(
        "month", _amount().alias("total_amount"), "shipments", rounded(F.col("total_boxes"), 2).alias("total_boxes"),
        rounded(F.col("total_profit"), 2).alias("total_profit")).orderBy("month")


def monthly_growth(df, roles=None):
    """H5's caption: change from the first to the last month, for at least two months."""
    months = monthly_trend(df, roles).agg(
        F.count(F.lit(1)).alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.min_by("total_amount", "month").alias("first_amount"), F.max_by("total_amount", "month").alias("last_amount"))
    base = F.when(F.coalesce("first_amount", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("first_amount"))
    return months.where("months > 1").withColumn(
        "growth_pct", rounded((F.col("last_amount") - base) / F.abs(base) * 100, 2))


def product_profit(df, roles=None):
    """H6: every product with profit, profit percent and whether it earns."""
    roles = roles_of(df, roles)
    pct = F.when(F.col("amount") > 0, ratio(F.col("total_profit"), F.col("amount")) * 100)
    return _grouped(df, roles, "product", "total_profit").select(
        F.col("name").alias("product"), _amount().alias("total_amount"), money(_amount(), "%.1f").alias("display"),
        rounded(F.col("total_profit"), 2).alias("total_profit"), rounded(pct, 2).alias("profit_pct"),
        F.coalesce(rounded(pct, 2) > 0, F.lit(False)).alias("profitable"),
    ).orderBy(F.desc("total_amount"), "product")


def most_profitable(df, roles=None):
    """H6's caption."""
    return product_profit(df, roles).orderBy(
        F.coalesce("profit_pct", F.lit(-999.0)).desc(), F.desc("total_amount"), "product").limit(1)


def status_breakdown(df, roles=None):
    """H7."""
    roles = roles_of(df, roles)
    grouped = _grouped(df, roles, "status", "shipments")
    return grouped.withColumn("all", _totals(grouped)).select(
        "name", F.col("shipments").alias("count"),
        rounded(ratio(F.col("shipments"), F.col("all.shipments")) * 100, 2).alias("pct_count"),
        _amount().alias("total_amount"), money(_amount()).alias("display"),
        rounded(ratio(_amount(), F.col("all.amount")) * 100, 2).alias("pct_amount"),
    ).orderBy(F.desc("count"), "name")


def _big(c):
    return F.when(c >= 1e6, F.concat(F.format_string("%.1f", c / 1e6), F.lit("M"))).otherwise(grouped_digits(c))


def business_kpis(df, roles=None):
    """H9: up to eight cards from one pass over the table."""
    roles = roles_of(df, roles)
    columns = len(df.columns)
    rows = F.count(F.lit(1))
    nulls = sum((rows - F.count(col(c)) for c in df.columns), F.lit(0))

    def total(role):
        return F.sum(finite(col(roles[role]))) if roles.get(role) else F.lit(None).cast("double")

    def mean(role):
        return F.avg(finite(col(roles[role]))) if roles.get(role) else F.lit(None).cast("double")

    wide = df.agg(
        rows.alias("rows"), total("amount").alias("amount"), mean("amount").alias("amount_avg"),
        total("boxes").alias("boxes"), mean("boxes").alias("boxes_avg"), total("profit").alias("profit"),
        mean("profit_pct").alias("profit_pct"),
        F.coalesce(F.round((1 - nulls / F.nullif(rows * columns, F.lit(0))) * 100, 2), F.lit(100.0)).alias("full"))
    dollars = lambda c: F.concat(F.lit("$"), _big(c))
    cards = [
        (None, "Total Records", grouped_digits(F.col("rows")), F.lit(f"{columns} columns")),
        ("amount", "Total Amount", dollars(F.col("amount")),
         F.concat(F.lit("avg $"), grouped_digits(F.col("amount_avg")), F.lit("/shipment"))),
        ("boxes", "Total Boxes", _big(F.col("boxes")), F.format_string("avg %.0f boxes/shipment", "boxes_avg")),
        (None, "Total Shipments", grouped_digits(F.col("rows")), F.lit("rows in fact table")),
        ("profit", "Total Profit", dollars(F.col("profit")),
         F.when(F.col("profit") > 0, "Positive overall").otherwise("Negative overall")),
        ("profit_pct", "Avg Profit %", F.format_string("%.1f%%", "profit_pct"), F.lit("mean across all shipments")),
        (None, "Data Quality", F.format_string("%.2f%%", "full"), F.lit("completeness")),
    ]
    kept = [c for c in cards if c[0] is None or roles.get(c[0])][:8]
    return _cards(wide, [c[1:] for c in kept])


def _cards(wide, cards):
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value"), sub.alias("sub"))
        for i, (label, value, sub) in enumerate(cards)])).alias("c")).select("c.*")


def generic_kpis(df, numeric, categorical, blocked=(), duplicates=None, max_cards=None):
    """Records, analysed columns, completeness and blocked columns, then a card per column (the first ``max_cards``).

    With ``duplicates`` (a one-row duplicate count) the fourth card is the older report's duplicate card.
    """
    rows = F.count(F.lit(1))
    nulls = sum((rows - F.count(col(c)) for c in df.columns), F.lit(0))
    facts = [
        F.struct(F.count(finite(col(c))).alias("n"), F.avg(finite(col(c))).alias("mean"),
                 F.stddev_samp(finite(col(c))).alias("std"), F.min(finite(col(c))).alias("lo"),
                 F.max(finite(col(c))).alias("hi")).alias(f"s{i}") for i, c in enumerate(numeric[:max_cards])]
    wide = df.agg(
        rows.alias("rows"), F.coalesce(F.round(
            (1 - nulls / F.nullif(rows * len(df.columns), F.lit(0))) * 100, 2), F.lit(100.0)).alias("full"), *facts)
    if duplicates is None:
        fourth = ("Columns Blocked", F.lit(str(len(blocked))), F.lit("by missing data gate"))
    else:
        fourth = ("Duplicates Removed", grouped_digits(duplicates.scalar()), F.lit("after cleaning"))
    cards = [
        ("Total Records", grouped_digits(F.col("rows")), F.lit(f"{len(df.columns)} columns")),
        ("Analysis Columns", F.lit(str(len(numeric))), F.lit(f"{len(categorical)} categorical")),
        ("Data Quality", F.format_string("%.2f%%", "full"), F.lit("completeness")),
        fourth,
    ]
    for i, c in enumerate(numeric[:max_cards]):
        s = f"s{i}"
        sub = (F.format_string("σ=%.2f · n=%d", f"{s}.std", f"{s}.n") if duplicates is None else
               F.format_string("σ=%.2f · [%.2f, %.2f]", f"{s}.std", f"{s}.lo", f"{s}.hi"))
        cards.append((c, grouped_digits(F.col(f"{s}.mean"), 2), sub))
    return _cards(wide, cards).where("value IS NOT NULL")
