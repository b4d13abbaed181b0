"""Order-dependent operators, trends, insights and charts (inventory W, R, I, K)."""

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.store import new_folder
from plumbline.operators import assoc, charts, features, gates, insights, order, stats, trend
from plumbline.plans import analysis
from plumbline.sources import sinks
from plumbline.streaming.accumulate import Accumulated

from suite.aggregates import MIXED, _FENCED, _MIXED, fenced, mixed
from suite.base import GAPS_SQL, LINE_ORDER, SERIES, SERIES_SQL, each, gaps, query, series, table

_ORDER = ", ".join(LINE_ORDER + ["l_extendedprice"])
LINE_KEYS = LINE_ORDER + ["l_extendedprice"]
VALUES = ("value", "drift", "gappy", "falling")


# ---- row order ----------------------------------------------------------------------------------------------------
@query("w1_row_index", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY {_ORDER}) - 1 AS _rn FROM lineitem")
def w1(spark, sf):
    indexed = order.with_row_index(table(spark, sf, "lineitem"), LINE_KEYS, ranges=6)
    return indexed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "_rn")


@query("w1_row_index_over_values", SERIES_SQL + """ SELECT event_id, CASE WHEN gappy IS NOT NULL THEN
 count(gappy) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 END AS x FROM series""")
def w1_valid(spark, sf):
    return order.with_row_index(series(spark, sf), ["ts"], valid={"x": "gappy"}, ranges=5).select("event_id", "x")


@query("w2_percent_change", SERIES_SQL + """, s AS (SELECT event_id, ts, value, drift, gappy, lag(value) OVER (ORDER BY ts) AS v, lag(drift) OVER (ORDER BY ts) AS d,
 max(CASE WHEN gappy IS NOT NULL THEN ts END) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM series)
SELECT a.event_id, round((a.value - a.v) / nullif(a.v, 0) * 100, 4) AS value_pct_change, round((a.drift - a.d) / nullif(a.d, 0) * 100, 4) AS drift_pct_change,
 CASE WHEN a.before IS NULL THEN NULL WHEN a.gappy IS NULL THEN 0 ELSE round((a.gappy - b.gappy) / nullif(b.gappy, 0) * 100, 4) END AS gappy_pct_change
FROM s a LEFT JOIN s b ON a.before = b.ts""")
def w2(spark, sf):
    changed = features.pct_change(series(spark, sf), ["value", "drift", "gappy"], ["ts"])
    return changed.select("event_id", *[F.round(f"{c}_pct_change", 4).alias(f"{c}_pct_change") for c in ("value", "drift", "gappy")])


@query("w3_moving_average", SERIES_SQL + """ SELECT event_id, round(avg(value) OVER w, 6) AS value_ma5, round(avg(gappy) OVER w, 6) AS gappy_ma5
FROM series WINDOW w AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w3(spark, sf):
    smooth = features.moving_average(series(spark, sf), ["value", "gappy"], ["ts"])
    return smooth.select("event_id", F.round("value_ma5", 6).alias("value_ma5"), F.round("gappy_ma5", 6).alias("gappy_ma5"))


@query("w4_first_last", SERIES_SQL + " " + each(VALUES, """ count({c}) AS n, round(arg_min({c}, ts) FILTER (WHERE {c} IS NOT NULL), 4) AS first_value,
 round(arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL), 4) AS last_value,
 round((arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL) - arg_min({c}, ts) FILTER (WHERE {c} IS NOT NULL))
   / abs(arg_min({c}, ts) FILTER (WHERE {c} IS NOT NULL)) * 100, 2) AS pct_change""", "series"))
def w4(spark, sf):
    return trend.first_last(series(spark, sf), VALUES, ["ts"])


@query("w6_systematic_sample", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS _rn FROM lineitem)
SELECT _rn, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE _rn % greatest(1, (SELECT count(*) FROM lineitem) // 80) = 0""")
def w6(spark, sf):
    return order.every_kth(table(spark, sf, "lineitem"), LINE_KEYS).select("_rn", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("w7_first_rows", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY {_ORDER} LIMIT 500")
def w7(spark, sf):
    return order.first_k(table(spark, sf, "lineitem"), LINE_KEYS, 500).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# ---- trend --------------------------------------------------------------------------------------------------------
_LINES = SERIES_SQL + ", lines AS (" + each(VALUES, """ count(y) AS n, any_value(rows) AS rows, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
 coalesce(corr(y, x), 0) AS r, sqrt((1 - corr(y, x) * corr(y, x)) * regr_syy(y, x) / (regr_sxx(y, x) * (count(y) - 2))) AS se, regr_sxx(y, x) AS sxx,
 avg(y) AS mean, stddev_samp(y) AS std, arg_min(y, x) AS first_value, arg_max(y, x) AS last_value""",
 "(SELECT {c} AS y, row_number() OVER (ORDER BY ts) - 1 AS x, (SELECT count(*) FROM series) AS rows FROM series WHERE {c} IS NOT NULL)") + ")"
_DIRECTION = "CASE WHEN slope > 0 THEN '↗ Increasing' WHEN slope < 0 THEN '↘ Decreasing' ELSE '→ Flat' END"


@query("r1_trend_fit", _LINES + f""" SELECT "column", n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r, 4) AS r, round(r * r, 4) AS r2,
 round(coalesce(se, 0), 6) AS se, {_DIRECTION} AS trend FROM lines""")
def r1(spark, sf):
    return trend.trend_fit(series(spark, sf), VALUES, ["ts"], with_p=False)


def _significance(source, key):
    """SQL of a table `sig`: two-sided p of every row's (n, r), by Simpson's rule over the angle whose sine is r."""
    return f""", sig AS (SELECT {key}, greatest(0, 1 - 2 * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt(pi()) * asin(least(1, abs(r))) / 6000
 * sum(CASE WHEN cut IN (0, 2000) THEN 1 WHEN cut % 2 = 1 THEN 4 ELSE 2 END * pow(cos(asin(least(1, abs(r))) * cut / 2000), n - 3))) AS p
 FROM {source}, (SELECT range AS cut FROM range(0, 2001)) GROUP BY {key}, n, r)"""


@query("r1_trend_significance", _LINES + _significance("lines", '"column"') + """ SELECT "column", round(r, 4) AS r, n, round(p, 6) AS p_value, p < 0.05 AS significant
 FROM lines JOIN sig USING ("column")""")
def r1_p(spark, sf):
    return trend.trend_fit(series(spark, sf), VALUES, ["ts"]).select("column", "r", "n", "p_value", "significant")


_FORECAST = _LINES + """, f AS (SELECT "column", i AS ahead, n + i AS step, round(intercept + slope * (n + i - 1), 4) AS value,
 round(intercept + slope * (n + i - 1) - 1.96 * se * sqrt(1 + 1 / n + pow(n + i - 1 - (n - 1) / 2, 2) / sxx), 4) AS lo,
 round(intercept + slope * (n + i - 1) + 1.96 * se * sqrt(1 + 1 / n + pow(n + i - 1 - (n - 1) / 2, 2) / sxx), 4) AS hi,
 round(intercept + slope * (n - 1), 4) AS last_fitted
 FROM (SELECT "column", n, slope, intercept, coalesce(se, 0) AS se, sxx FROM lines), (SELECT range :: INT AS i FROM range(1, 11)))"""


@query("r2_forecast", _FORECAST + " SELECT * FROM f")
def r2(spark, sf):
    return trend.forecast(series(spark, sf), VALUES, ["ts"])


@query("r3_fitted_values", _LINES + """ SELECT event_id, x, gappy AS value, round(intercept + slope * x, 4) AS fitted FROM
 (SELECT event_id, gappy, row_number() OVER (ORDER BY ts) - 1 AS x FROM series WHERE gappy IS NOT NULL), lines WHERE "column" = 'gappy'""")
def r3(spark, sf):
    return trend.fitted(series(spark, sf), "gappy", ["ts", "event_id"]).drop("ts")


_BEST = _MIXED + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{p}' AS predictor, {i} AS pos, corr({t}, {p}) AS r, regr_count({t}, {p}) AS n, regr_slope({t}, {p}) AS slope, regr_intercept({t}, {p}) AS intercept FROM mixed"
    for t in MIXED for i, p in enumerate(MIXED) if p != t) + "), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, pos) AS k FROM p)"


@query("r4_best_predictor", _BEST + _significance("(SELECT * FROM b WHERE k = 1)", "target") + """ SELECT target, predictor, round(r, 4) AS r, round(r * r, 4) AS r2, round(slope, 4) AS slope, round(intercept, 4) AS intercept,
 printf('%s = %.4f×%s + %.4f', target, slope, predictor, intercept) AS equation, round(p, 6) AS p_value, p < 0.05 AS significant FROM b JOIN sig USING (target) WHERE k = 1""")
def r4(spark, sf):
    return assoc.best_predictor(mixed(spark, sf), MIXED)


@query("r5_trend_answer", _LINES + _significance("lines", '"column"') + """ SELECT "column", CASE WHEN slope > 0 THEN '↗ Increasing' ELSE '↘ Decreasing' END AS trend, round(slope, 6) AS slope,
 round(r * r, 4) AS r2, round(p, 6) AS p_value, p < 0.05 AS significant, n + i AS step, round(intercept + slope * (n + i - 1), 3) AS value
 FROM lines JOIN sig USING ("column"), (SELECT range AS i FROM range(1, 6)) WHERE "column" = 'drift'""")
def r5(spark, sf):
    return trend.trend_answer(series(spark, sf), "drift", ["ts"])


@query("r6_forecast_table", _FORECAST + """ SELECT "column", step, value, lo, hi, round(hi - lo, 3) AS width,
 CASE WHEN value > before THEN '↑' WHEN value < before THEN '↓' ELSE '→' END AS direction
FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY "column" ORDER BY step), last_fitted) AS before FROM f)""")
def r6(spark, sf):
    return trend.forecast_table(trend.forecast(series(spark, sf), VALUES, ["ts"]))


@query("r7_scatter_hint", f"""WITH pts AS (SELECT round(l_quantity, 4) AS x, round(l_extendedprice / 1000 + l_quantity, 4) AS y FROM lineitem)
SELECT count(*) AS points, round(corr(x, y), 3) AS r, CASE WHEN abs(corr(x, y)) >= 0.7 THEN 'Strong' WHEN abs(corr(x, y)) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS hint FROM pts""")
def r7(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("blend", F.expr("l_extendedprice / 1000 + l_quantity"))
    return assoc.scatter_hint(charts.scatter(df, "l_quantity", "blend"))


# ---- insights -----------------------------------------------------------------------------------------------------
def _score(rows, n, mean, std):
    return (f"floor(greatest(0, least(100, {n} / greatest({rows}, 1) * 40 + CASE WHEN {n} >= 5 THEN least(30, log10(greatest({n}, 1)) / log10(300) * 30) ELSE 0 END "
            f"+ CASE WHEN {n} >= 2 AND {std} > 0 AND {mean} <> 0 THEN greatest(0, 30 * (1 - abs({std} / {mean}) / 2)) ELSE 15 END))) :: INT")


@query("i1_confidence", SERIES_SQL + """ SELECT *, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS reliability,
 score < 60 AS low_reliability FROM (""" + each(VALUES, f""" count({{c}}) AS sample_n, {_score('count(*)', 'count({c})', 'avg({c})', 'stddev_samp({c})')} AS score,
 round(count({{c}}) / count(*) * 40, 1) AS completeness_pts, round(least(30, log10(count({{c}})) / log10(300) * 30), 1) AS sample_size_pts,
 round(greatest(0, 30 * (1 - abs(stddev_samp({{c}}) / avg({{c}})) / 2)), 1) AS variance_pts""", "series") + ")")
def i1(spark, sf):
    return stats.confidence(series(spark, sf), VALUES)


# For these row counts the two-sided 5 % point of Student's t is the normal one plus the first expansion term.
_CRITICAL = "(1.959963985 + (pow(1.959963985, 3) + 1.959963985) / (4 * (n - 2)))"
_TRENDS = _LINES + f""", t AS (SELECT *, (last_value - first_value) / abs(first_value) AS change, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t_value,
 {_score('rows', 'n', 'mean', 'std')} AS score FROM lines)"""
_TREND_OK = f"abs(change) >= 0.05 AND (abs(r) >= 1 OR t_value > {_CRITICAL})"


@query("i2_trend_insights", _TRENDS + f""" SELECT "column" AS subject, NOT ({_TREND_OK}) AS blocked, n AS data_points_used,
 CASE WHEN {_TREND_OK} THEN CASE WHEN score >= 75 THEN 'high' ELSE 'medium' END END AS priority, CASE WHEN {_TREND_OK} THEN score END AS confidence,
 CASE WHEN {_TREND_OK} THEN concat('Steady ', CASE WHEN slope > 0 THEN 'Rise' ELSE 'Fall' END, ': ', "column") END AS title,
 CASE WHEN {_TREND_OK} THEN round(slope, 6) END AS slope, CASE WHEN {_TREND_OK} THEN round(change * 100, 2) END AS pct_change FROM t""")
def i2(spark, sf):
    found = insights.trend_insights(trend.line_facts(series(spark, sf), VALUES, ["ts"]))
    return found.select("subject", F.col("blocked_reason").isNotNull().alias("blocked"), "data_points_used", "priority", "confidence", "title",
                        F.col("values")["slope"].alias("slope"), F.col("values")["pct_change"].alias("pct_change"))


_CORR = _MIXED + ", s AS (" + each(MIXED, f"{_score('count(*)', 'count({c})', 'avg({c})', 'stddev_samp({c})')} AS score", "mixed") + "), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM mixed"
    for i, a in enumerate(MIXED) for b in MIXED[i + 1:]) + """), j AS (SELECT p.*, (a.score + b.score) // 2 AS conf FROM p
 JOIN s a ON c1 = a."column" JOIN s b ON c2 = b."column")"""


@query("i3_correlation_insights", _CORR + """ SELECT concat(c1, ',', c2) AS subject, n AS data_points_used, abs(r) < 0.6 AS blocked,
 CASE WHEN abs(r) >= 0.6 THEN CASE WHEN abs(r) >= 0.75 THEN 'high' ELSE 'medium' END END AS priority, CASE WHEN abs(r) >= 0.6 THEN conf :: INT END AS confidence,
 CASE WHEN abs(r) >= 0.6 THEN round(r, 4) END AS r, CASE WHEN abs(r) >= 0.6 THEN concat(CASE WHEN abs(r) >= 0.9 THEN 'Very close' WHEN abs(r) >= 0.75 THEN 'Close'
 ELSE 'Clear' END, CASE WHEN r > 0 THEN ', rising' ELSE ', opposite' END, ' link: ', c1, ' and ', c2) END AS title FROM j""")
def i3(spark, sf):
    df = mixed(spark, sf)
    pairs = assoc.pair_facts(df, [(a, b) for i, a in enumerate(MIXED) for b in MIXED[i + 1:]])
    found = insights.correlation_insights(pairs, stats.confidence(df, MIXED))
    return found.select("subject", "data_points_used", F.col("blocked_reason").isNotNull().alias("blocked"), "priority", "confidence",
                        F.col("values")["r"].alias("r"), "title")


_ANOMALIES = _FENCED + """, m AS (""" + each(("value", "wild", "mild", "even"), " avg({c}) AS mean, stddev_samp({c}) AS std, count({c}) AS n, count(*) AS rows", "a") + """), z AS ("""\
    + " UNION ALL ".join(f"SELECT '{c}' AS k, ts, {c} :: DOUBLE AS v, abs(({c} - mean) / std) AS z FROM a, m WHERE m.\"column\" = '{c}'" for c in ("value", "wild", "mild", "even"))\
    + f"""), g AS (SELECT k, count(*) FILTER (WHERE z >= 3) AS hits, max(z) AS max_z FROM z GROUP BY 1)
SELECT k AS subject, CASE WHEN max_z >= 4 THEN 'high' ELSE 'medium' END AS priority, {_score('rows', 'n', 'mean', 'std')} AS confidence, n AS data_points_used,
 hits :: DOUBLE AS anomaly_count, round(hits / n * 100, 2) AS anomaly_pct, round(max_z, 4) AS max_z, (SELECT concat('[', string_agg(printf('%.3f', v), ', ' ORDER BY ts), ']')
 FROM (SELECT v, ts FROM z WHERE z.k = g.k AND z >= 3 ORDER BY ts LIMIT 5)) AS first_values FROM g JOIN m ON k = m."column" WHERE hits > 0"""


@query("i4_anomaly_insights", _ANOMALIES)
def i4(spark, sf):
    found = insights.anomaly_facts(fenced(spark, sf), ["value", "wild", "mild", "even"], ["ts"])
    shown = insights.anomaly_insights(found).select(
        "subject", "priority", "confidence", "data_points_used", F.col("values")["anomaly_count"].alias("anomaly_count"),
        F.col("values")["anomaly_pct"].alias("anomaly_pct"), F.col("values")["max_z_score"].alias("max_z"))
    return shown.join(found.select(F.col("column").alias("subject"), "first_values"), "subject")


@query("i5_distribution_insights", _FENCED + """, d AS (""" + each(("value", "wild", "mild", "even"), """ skewness({c}) AS s, kurtosis_pop({c}) AS kp, count({c}) :: BIGINT AS n,
 avg({c}) AS mean, quantile_cont({c} :: DOUBLE, 0.5) AS median""", "a") + """), t AS (SELECT *, exp(-n / 12 * (pow(s * (n - 2) / sqrt(n * (n - 1)), 2) + pow(kp, 2) / 4)) > 0.05 AS normal FROM d)
SELECT "column" AS subject, CASE WHEN abs(s) > 1 AND NOT (abs(s) < 0.3 AND normal) THEN 'medium' ELSE 'low' END AS priority, n AS data_points_used,
 CASE WHEN abs(s) < 0.3 AND normal THEN concat('Bell-shaped: ', "column") ELSE concat(CASE WHEN abs(s) > 1 THEN 'Very ' ELSE '' END, 'Lopsided: ', "column") END AS title,
 round(s, 4) AS skewness, round(mean, 4) AS mean, round(median, 4) AS median FROM t WHERE (abs(s) < 0.3 AND normal) OR abs(s) >= 0.5""")
def i5(spark, sf):
    found = insights.distribution_insights(fenced(spark, sf), ["value", "wild", "mild", "even"], ["ts"], test="moments")
    return found.select("subject", "priority", "data_points_used", "title", F.col("values")["skewness"].alias("skewness"),
                        F.col("values")["mean"].alias("mean"), F.col("values")["median"].alias("median"))


@query("i6_blocked_insights", _TRENDS + f""" SELECT 'trend' AS type, "column" AS subject FROM t WHERE NOT ({_TREND_OK})""")
def i6(spark, sf):
    found = insights.trend_insights(trend.line_facts(series(spark, sf), VALUES, ["ts"]))
    return insights.blocked_insights(found).drop("reason")


_RANKED = _TRENDS + f""", k AS (SELECT 'trend' AS type, "column" AS subject, CASE WHEN score >= 75 THEN 'high' ELSE 'medium' END AS priority, score AS confidence FROM t WHERE {_TREND_OK})"""


@query("i7_ranked_insights", _RANKED + """ SELECT row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, confidence DESC, type, subject) :: INT AS number,
 upper(type) AS type, upper(priority) AS priority, concat('Steady ', CASE WHEN slope > 0 THEN 'Rise' ELSE 'Fall' END, ': ', subject) AS title
FROM k JOIN lines ON subject = "column" """)
def i7(spark, sf):
    found = insights.trend_insights(trend.line_facts(series(spark, sf), VALUES, ["ts"]))
    return sinks.insight_sheet(insights.ranked_insights(found)).drop("description")


@query("i9_priority_tally", _RANKED + " SELECT priority, count(*) AS insights FROM k GROUP BY 1")
def i9(spark, sf):
    found = insights.trend_insights(trend.line_facts(series(spark, sf), VALUES, ["ts"]))
    return insights.priority_tally(insights.ranked_insights(found))


_PLAIN = ("value", "wild", "mild")


def _classic_statistics(df, columns):
    return stats.moments(df, columns, signed_cv=True).join(stats.quantile_table(df, columns), "column")


@query("i8_plain_insights", _FENCED + ", s AS (" + each(_PLAIN, """ skewness({c}) AS skew, kurtosis({c}) AS kurt, stddev_samp({c}) / avg({c}) * 100 AS cv, count({c}) AS n,
 quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3""", "a") + """), o AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS k, avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0 END) AS share FROM a, s WHERE s.\"column\" = '{c}'" for c in _PLAIN)
    + """), c AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS c1, '{y}' AS c2, round(corr({x}, {y}), 4) AS r FROM a" for x, y in (("value", "wild"), ("value", "mild"), ("wild", "mild")))
    + """), f AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS k, corr({c}, x) AS r, count(*) AS n FROM (SELECT {c}, row_number() OVER (ORDER BY ts) - 1 AS x FROM a)" for c in _PLAIN)
    + f"""), b AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 'distribution' AS type, 'medium' AS priority, concat('Lopsided: ', "column") AS title FROM s WHERE abs(round(skew, 4)) > 0.8 UNION ALL
SELECT 'variability', 'high', concat('Wide spread: ', "column") FROM s WHERE round(cv, 2) > 30 UNION ALL
SELECT 'distribution', 'low', concat('Long tails: ', "column") FROM s WHERE abs(round(kurt, 4)) > 3 UNION ALL
SELECT 'correlation', CASE WHEN abs(r) >= 0.6 THEN 'high' ELSE 'medium' END, concat(CASE WHEN abs(r) >= 0.9 THEN 'Very Strong' WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END,
 CASE WHEN r > 0 THEN ', positive' ELSE ', negative' END, ': ', c1, ' and ', c2) FROM c WHERE abs(r) >= 0.3 UNION ALL
SELECT 'prediction', CASE WHEN abs(r) * sqrt((n - 2) / (1 - r * r)) > {_CRITICAL} THEN 'high' ELSE 'medium' END, concat('Line over the rows: ', k) FROM f UNION ALL
SELECT 'outlier', 'high', concat('Many far values: ', k) FROM o WHERE share > 0.1 UNION ALL
SELECT 'categorical', 'medium', 'One value leads: event_type' FROM b WHERE n / (SELECT count(*) FROM events) > 0.5""")
def i8(spark, sf):
    df = fenced(spark, sf)
    return insights.plain_insights(
        _classic_statistics(df, _PLAIN), assoc.strong_pairs(assoc.corr_pairs(df, _PLAIN)), trend.trend_fit(df, _PLAIN, ["ts"], min_rows=5),
        stats.iqr_outliers(df, _PLAIN), insights.dominant_values(table(spark, sf, "events"), ["event_type"])).drop("text")


_SHOWN = "format('{:,.2f}', round(CAST(round({e}, 4) AS DECIMAL(18, 4)), 2) :: DOUBLE)"


def _shown(e):
    return _SHOWN.replace("{e}", e)


@query("i10_key_metrics", _FENCED + " " + each(_PLAIN, f""" {_shown('avg({c})')} AS mean, {_shown('quantile_cont({c}, 0.5)')} AS median,
 {_shown('stddev_samp({c})')} AS std, concat('[', {_shown('min({c})')}, ', ', {_shown('max({c})')}, ']') AS range,
 CASE WHEN abs(round(skewness({{c}}), 4)) < 0.5 THEN 'Normal' ELSE 'Skewed' END AS quality""", "a").replace('AS "column"', "AS metric"))
def i10(spark, sf):
    return insights.key_metrics(_classic_statistics(fenced(spark, sf), _PLAIN))


@query("i10_report_counts", _RANKED + """ SELECT 'rows' AS item, (SELECT count(*) FROM series) AS count UNION ALL
SELECT 'features', (SELECT 2 * (count(*) >= 3) :: INT + 2 * (count(*) >= 5) :: INT + (min(drift) > 0 AND abs(avg(value)) / greatest(abs(avg(drift)), 0.001) <= 100) :: INT
 + (stddev_samp(value) > 0) :: INT + (stddev_samp(drift) > 0) :: INT + 1 FROM series) UNION ALL
SELECT 'issues', (SELECT (min(value) = max(value)) :: INT + ((2 * count(*) - count(value) - count(event_type)) / (2 * count(*)) >= 0.05) :: INT FROM series) UNION ALL
SELECT concat('insights_', p), (SELECT count(*) FROM k WHERE subject = 'drift' AND priority = p) FROM (VALUES ('high'), ('medium'), ('low')) v(p)""")
def i10_counts(spark, sf):
    df = series(spark, sf)
    lines = trend.line_facts(df, ["drift"], ["ts"])
    found = insights.ranked_insights(insights.trend_insights(lines))
    return insights.report_counts(df.agg(F.count("*").alias("rows")), features.feature_table(df, ["value", "drift"], ["ts"]),
                                  gates.quality_checks(df.select("value", "event_type"), "2030-01-01 00:00:00"), found)


_CLEAN = SERIES_SQL + """, filled AS (SELECT * REPLACE (coalesce(gappy, (SELECT quantile_cont(gappy, 0.5) FROM series)) AS gappy) FROM series)"""


_STATISTICS = _CLEAN + " " + each(("user_id", "value", "drift", "gappy", "falling"), """ count({c}) AS count, round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, round(quantile_cont({c} :: DOUBLE, 0.5), 4) AS median, round(skewness({c}), 4) AS skewness""", "filled")


@query("i12_full_analysis", _STATISTICS)
def i12(spark, sf):
    report = analysis.analyse(series(spark, sf), "events", ["ts"])
    return report.tables["statistics"].select("column", "count", "mean", "std", "median", "skewness")


@query("a13_accumulated_analysis", _STATISTICS)
def a13(spark, sf):
    """The same table in three batches that arrive out of order, one of them twice; the rows of each are dealt by their id."""
    held, df = Accumulated(spark, new_folder(spark, "a13"), ["ts"]), series(spark, sf)
    for number in (2, 0, 1, 0):
        held.add(df.where(F.col("event_id") % 3 == number), number)
    return held.report("events").tables["statistics"].select("column", "count", "mean", "std", "median", "skewness")


# The sections of one report over lineitem side by side: (section, item, metric, value).
_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_TEXTS = ("l_returnflag", "l_linestatus")


def _metrics(section, item, source, **metrics):
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {item} AS item, '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM {source}" for k, v in metrics.items())


def _sections_sql():
    n = "(SELECT count(*) FROM lines)"
    parts = []
    for c in _LINE_NUMBERS:
        parts.append(_metrics("statistics", f"'{c}'", "lines", count=f"count({c})", mean=f"round(avg({c}), 4)", std=f"round(stddev_samp({c}), 4)",
                              median=f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4)", p95=f"round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4)", skewness=f"round(skewness({c}), 4)"))
        parts.append(_metrics("confidence", f"'{c}'", "lines", score=f"floor(40 + least(30, log10(count({c})) / log10(300) * 30) + greatest(0, 30 * (1 - abs(stddev_samp({c}) / avg({c})) / 2)))"))
        fence = f"(SELECT {c} AS v, q1, q3 FROM lines, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lines))"
        parts.append(_metrics("outliers", f"'{c}'", fence, count="count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))"))
        z = f"(SELECT abs((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_samp({c}) OVER ()) AS z FROM lines)"
        parts.append(_metrics("anomalies", f"'{c}'", z, count="count(*) FILTER (WHERE z >= 3)"))
        line = f"(SELECT CAST({c} AS DOUBLE) AS y, row_number() OVER (ORDER BY {_ORDER}) - 1 AS x FROM lines)"
        parts.append(_metrics("predictions", f"'{c}'", line, slope="round(regr_slope(y, x), 6)", r2="round(round(corr(y, x), 10) * round(corr(y, x), 10), 4)"))
    for a, b in combinations(_LINE_NUMBERS, 2):
        parts.append(_metrics("correlations", f"'{a} {b}'", "lines", r=f"round(corr({a}, {b}), 4)"))
    for c in _LINE_TEXTS:
        parts.append(f"SELECT 'categories', concat('{c} ', {c}), 'count', CAST(count(*) AS DOUBLE) FROM lines GROUP BY {c}")
    parts.append(_metrics("gates", "'min_rows'", "lines", value="count(*)"))
    parts.append(_metrics("completeness", "'all'", "lines", completeness_pct="CASE WHEN count(*) > 0 THEN 100 END"))
    return f"WITH lines AS (SELECT DISTINCT {', '.join(_SECTION_COLUMNS)} FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(parts) + f") t WHERE {n} > 0"


_SECTION_COLUMNS = ("l_shipdate", "l_linenumber", *_LINE_NUMBERS, *_LINE_TEXTS)


@query("i12_all_sections", _sections_sql())
def i12_sections(spark, sf):
    report = analysis.analyse(table(spark, sf, "lineitem").select(*_SECTION_COLUMNS), "lineitem", LINE_KEYS)
    t, known = report.tables, F.col("column").isin(list(_LINE_NUMBERS))

    def told(section, df, item, *metrics):
        """Metrics of a section as rows."""
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return df.select(F.lit(section).alias("section"), item.alias("item"), rows.alias("m")).select("section", "item", "m.*")

    anomalies = insights.anomaly_facts(t["cleaned"], list(_LINE_NUMBERS))
    return stats.union_all([
        told("statistics", t["statistics"].where(known), F.col("column"), "count", "mean", "std", "median", "p95", "skewness"),
        told("confidence", t["confidence"].where(known).withColumn("score", F.col("score")), F.col("column"), "score"),
        told("outliers", t["outliers"].where(known), F.col("column"), "count"), told("anomalies", anomalies, F.col("column"), "count"),
        told("predictions", t["predictions"].where(known), F.col("column"), "slope", "r2"),
        told("correlations", t["correlations"].where(F.col("col1").isin(list(_LINE_NUMBERS)) & F.col("col2").isin(list(_LINE_NUMBERS))), F.concat_ws(" ", "col1", "col2"), "r"),
        told("categories", t["categories"], F.concat_ws(" ", "column", "value"), "count"),
        told("gates", t["gates"].where("gate = 'min_rows'"), F.col("gate"), "value"),
        told("completeness", t["completeness"], F.lit("all"), "completeness_pct")])


# ---- charts -------------------------------------------------------------------------------------------------------
_BARS = GAPS_SQL + ", bars AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", rank, substr(v, 1, 28) AS name, n AS count, round(n / (SELECT count(*) FROM gaps) * 100, 1) AS pct
 FROM (SELECT {c} AS v, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, {c})) :: INT AS rank FROM gaps WHERE {c} IS NOT NULL GROUP BY 1) WHERE rank <= 12"""
    for c in ("flag_gap", "padded", "number_text", "ship_text")) + ")"
_BAR_COLUMNS = ("flag_gap", "padded", "number_text", "ship_text")


@query("k1_bars", _BARS + " SELECT * FROM bars")
def k1(spark, sf):
    return charts.bars(gaps(spark, sf), _BAR_COLUMNS)


@query("k1_visible_bars", _BARS + """ SELECT * FROM bars WHERE NOT regexp_matches("column", '(?i)date|time') AND "column" NOT IN (SELECT "column" FROM bars
 WHERE rank = 1 AND (regexp_matches(name, '^[0-9]{4}') OR regexp_matches(name, '^[A-Z][0-9]{5,}')))""")
def k1_visible(spark, sf):
    return charts.bars(gaps(spark, sf), _BAR_COLUMNS, hide=True)


_MEANS = ("value", "drift", "gappy", "falling", "big", "huge")
_WIDER = f"WITH series AS (SELECT {SERIES}, value * 1000 AS big, value * 123456 AS huge FROM events)"


def _wider(spark, sf):
    return series(spark, sf).selectExpr("*", "value * 1000 AS big", "value * 123456 AS huge")


_GROUPS = """g AS (SELECT *, (row_number() OVER (PARTITION BY scale ORDER BY pos)) :: INT AS rank FROM (""" + " UNION ALL ".join(
    f"SELECT floor(log10(greatest(abs(avg({c})), 0.01) + 1)) :: INT AS scale, '{c}' AS \"column\", {i} AS pos FROM series" for i, c in enumerate(_MEANS)) + "))"


@query("k2_scale_groups", _WIDER + ", " + _GROUPS + " SELECT scale, \"column\", rank FROM g WHERE rank <= 5")
def k2(spark, sf):
    return charts.scale_groups(_wider(spark, sf), _MEANS)


@query("k3_trend_points", _WIDER + ", " + _GROUPS + """, r AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS rn, greatest(1, (SELECT count(*) FROM series) // 80) AS step FROM series)
SELECT point, x, p."column", value, scale FROM (""" + " UNION ALL ".join(
    f"SELECT rn // step AS point, strftime(ts, '%Y-%m-%d') AS x, '{c}' AS \"column\", round({c}, 4) AS value FROM r WHERE rn % step = 0" for c in _MEANS) + ") p JOIN g ON p.\"column\" = g.\"column\" AND rank <= 5")
def k3(spark, sf):
    return charts.trend_points(_wider(spark, sf), _MEANS, ["ts"], "ts")


@query("k4_scatter", SERIES_SQL + " SELECT round(value, 4) AS x, round(gappy, 4) AS y FROM series WHERE gappy IS NOT NULL AND value IS NOT NULL")
def k4(spark, sf):
    return charts.scatter(series(spark, sf), "value", "gappy")


@query("k5_pie", GAPS_SQL + """ SELECT 'number_text' AS "column", substr(number_text, 1, 24) AS name, count(*) AS count, round(count(*) / (SELECT count(*) FROM gaps) * 100, 1) AS pct
 FROM gaps GROUP BY 2""")
def k5(spark, sf):
    return charts.pie(gaps(spark, sf), ["ship_text", "number_text", "flag_gap"])


@query("k6_boxes", _FENCED + " " + each(("value", "wild", "mild"), """ round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
 round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max, CASE WHEN avg({c}) > quantile_cont({c}, 0.5) THEN 'right' ELSE 'left' END AS skew""", "a"))
def k6(spark, sf):
    return charts.boxes(fenced(spark, sf), ["value", "wild", "mild"])


@query("k7_bar_captions", _BARS + """ SELECT "column", arg_min(name, rank) AS top, max(count) AS top_count, arg_max(name, rank) AS bottom, min(count) AS bottom_count,
 round(max(count) / sum(count) * 100, 1) AS top_pct, count(*) AS categories FROM bars GROUP BY 1""")
def k7(spark, sf):
    return charts.bar_captions(charts.bars(gaps(spark, sf), _BAR_COLUMNS))


@query("k10_sorted_statistics", _FENCED + """ SELECT *, row_number() OVER (ORDER BY coalesce(cv, 0) DESC, "column") :: INT AS place FROM (""" + each(("value", "wild", "mild", "even"), """
 round(stddev_samp({c}) / abs(avg({c})) * 100, 2) AS cv""", "a") + ")")
def k10(spark, sf):
    ordered = stats.sort_statistics(stats.moments(fenced(spark, sf), ["value", "wild", "mild", "even"]), "cv").select("column", "cv")
    place = F.row_number().over(Window.orderBy(F.coalesce("cv", F.lit(0.0)).desc(), "column"))  # a row per column of the table
    return ordered.select("column", "cv", place.alias("place"))
