"""Whole analyses composed from the operators."""

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.functions.expr import date_columns
from plumbline.operators import assoc, business, charts, clean, features, gates, insights, profile, roles, stats, trend
from plumbline.functions.store import local, materialised, stored
from plumbline.operators.merge import tagged_union
from plumbline.operators.quantiles import quantiles
from plumbline.operators.stats import union_all

LOCAL_ROWS = 5_000


class Sections(Mapping):
    """Named tables, each planned when it is first asked for, so that unused sections cost no jobs."""

    def __init__(self, **builders):
        self.builders, self.built = builders, {}

    def add(self, **builders):
        self.builders.update(builders)

    def __getitem__(self, name):
        if name not in self.built:
            self.built[name] = self.builders[name]()
        return self.built[name]

    def __contains__(self, name):
        return name in self.builders

    def __iter__(self):
        return iter(self.builders)

    def __len__(self):
        return len(self.builders)


@dataclass
class Report:
    """The outcome of one analysis and its sections, each a DataFrame."""

    label: str
    status: str
    stop_reason: str = None
    roles: object = None
    blocked: list = field(default_factory=list)
    tables: Sections = field(default_factory=Sections)


class Known:
    """What several sections of one analysis read, each found once: facts and lines (one row per column), quantiles, pairs.

    Facts, lines, and pairs up to LOCAL_ROWS are small by their number of columns and are carried in the plans of the sections as rows,
    so that a section that needs nothing else runs no job over the table.
    """

    def __init__(self, df, numeric, order_by, mode="auto", given=None):
        self.df, self.numeric, self.order_by, self.mode, self.given = df, list(numeric), order_by, mode, dict(given or {})

    def _once(self, name, build):
        if name not in self.given:
            self.given[name] = build()
        return self.given[name]

    def lines(self):
        return self._once("lines", lambda: local(trend.line_facts(self.df, self.numeric, self.order_by)))

    def facts(self):
        """Lines hold the facts too."""
        return self.given["lines"] if "lines" in self.given else self._once("facts", lambda: local(stats.facts(self.df, self.numeric)))

    def quantiles(self, *shares):
        """{column: values at the shares}, all from one narrowing."""
        every = list(stats.QUANTILE_NAMES.values())
        found = self._once("quantiles", lambda: quantiles(self.df, self.numeric, every, self.mode))
        return {c: [v[every.index(s)] for s in shares] for c, v in found.items()}

    def quantile_table(self):
        return self._once("quantile_table", lambda: stats.quantile_table(self.df, self.numeric, found=self.quantiles(*stats.QUANTILE_NAMES.values())))

    def modes(self):
        return self._once("modes", lambda: local(stats.mode_table(self.df, self.numeric)))

    def pairs(self):
        k = len(self.numeric)
        keep = local if k * (k - 1) // 2 <= LOCAL_ROWS else materialised
        return self._once("pairs", lambda: keep(assoc.pair_facts(self.df, list(combinations(self.numeric, 2)))))


def _trace(df, step, status, detail):
    return df.sparkSession.createDataFrame([(step, status, detail)], "step string, status string, detail string")


def analyse(df, label="table", order_by=None, combined=False, test="moments", mode="auto"):
    """Validate, clean, classify, analyse, explain, chart. A failed dataset gate stops it with the reason.

    Row order is data: without ``order_by`` all columns in table order define it.
    """
    facts = local(gates.column_facts(df))
    gate_rows, column_rows = gates.dataset_gates(df, combined, facts), gates.column_gates(df, facts=facts)
    trace = gates.gate_trace(df, label, combined, facts).select("step", "status", "detail")
    tables = Sections(gates=lambda: gate_rows, columns=lambda: column_rows, trace=lambda: trace)
    stopped = gate_rows.where("status = 'BLOCK'").orderBy("position").select("reason").first()
    if stopped:
        return Report(label, "BLOCKED", stopped["reason"], tables=tables)
    blocked = [r["column"] for r in column_rows.where("status = 'BLOCK'").select("column").collect()]
    cleaned, log = clean.clean(df, blocked, mode, stored)
    ready = roles.promote_dates(cleaned, [c for c in roles.text_columns(cleaned) if c not in blocked])
    found = roles.classify(ready, blocked)
    order_by = list(order_by or ready.columns)
    numeric, categorical = found.numeric, found.categorical
    note = f"numeric {numeric}, categorical {categorical}, index {found.index}, date {found.date}"
    tables.add(
        cleaned=lambda: ready, cleaning_log=lambda: log, completeness=lambda: profile.completeness(ready),
        duplicates=lambda: profile.duplicate_rows(ready),
        kpis=lambda: business.generic_kpis(ready, numeric, categorical, blocked),
        trace=lambda: union_all([
            trace, log.select("step", F.lit("DONE").alias("status"),
                              F.concat("column", F.lit(": "), F.coalesce("detail", F.lit(""))).alias("detail")),
            _trace(df, "classification", "PASS", note)]),
    )
    if numeric:
        tables.add(**numeric_sections(Known(ready, numeric, order_by, mode), test, (found.date or [None])[0]))
    if categorical:
        tables.add(categories=lambda: stats.category_profile(ready, categorical),
                   chart_bars=lambda: charts.bars(ready, categorical), chart_pie=lambda: charts.pie(ready, categorical))
    return Report(label, "OK", None, found, blocked, tables)


def numeric_sections(known, test="moments", date=None):
    """Builders of the sections about numbers; what they share is found once, when it is first asked for."""
    df, numeric, order_by, mode = known.df, known.numeric, known.order_by, known.mode
    every = cache(lambda: local(insights.gated_insights(
        df, numeric, order_by, test, mode=mode, lines=known.lines(), base=known.facts(), pairs=known.pairs() if len(numeric) > 1 else None,
        medians={c: v[0] for c, v in known.quantiles(0.5).items()})))
    made = dict(
        statistics=lambda: stats.statistics_table(df, numeric, base=known.facts(), found=known.quantiles(*stats.QUANTILE_NAMES.values()), common=known.modes()),
        confidence=lambda: stats.confidence(df, numeric, known.facts()),
        histograms=lambda: stats.histogram(df, numeric),
        normality=lambda: stats.normality(df, numeric, order_by) if test == "shapiro" else stats.jarque_bera(df, numeric, base=known.facts()),
        outliers=lambda: stats.iqr_outliers(df, numeric, order_by, quartiles=known.quantiles(0.25, 0.75)),
        predictions=lambda: trend.trend_fit(df, order_by=order_by, lines=known.lines()),
        forecasts=lambda: trend.forecast(df, order_by=order_by, lines=known.lines()),
        insights=lambda: insights.ranked_insights(every()), blocked_insights=lambda: insights.blocked_insights(every()),
        chart_trends=lambda: charts.trend_points(df, numeric, order_by, date, base=known.facts()),
        chart_boxes=lambda: charts.boxes(df, numeric, found=known.quantiles(0.25, 0.5, 0.75), base=known.facts()),
    )
    if len(numeric) > 1:
        correlations = lambda: assoc.corr_pairs(df, numeric, facts=known.pairs())
        made.update(
            correlations=correlations, strong_pairs=lambda: assoc.strong_pairs(correlations()),
            chart_scatters=lambda: union_all([
                charts.scatter(df, a, b, order_by).select(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), "x", "y")
                for a, b in charts.scatter_pairs(numeric)]))
    return made


def analyse_classic(df, label="table", order_by=None, as_of=None, mode="auto"):
    """I12, the older order: understand, clean by the 30 % limit, check, derive features, explain without gates."""
    cleaned, log = clean.clean_classic(df, mode, stored)
    ready = roles.promote_dates(cleaned)
    found = roles.classify(ready, classic=True)
    order_by = list(order_by or ready.columns)
    numeric, categorical = found.numeric, found.categorical
    checks = gates.quality_checks(ready, as_of)
    feature_rows = cache(lambda: features.feature_table(ready, numeric, found.date or date_columns(ready)))
    tables = Sections(
        cleaned=lambda: ready, cleaning_log=lambda: log, understanding=lambda: profile.understanding(df),
        anomalies=lambda: profile.anomalies(df, mode=mode), missing=lambda: profile.missing_table(df),
        duplicates=lambda: profile.duplicate_rows(df), checks=lambda: checks, verdict=lambda: gates.overall_verdict(checks),
        completeness=lambda: profile.completeness(ready),
        kpis=lambda: business.generic_kpis(ready, numeric, categorical, duplicates=profile.duplicate_rows(ready)),
    )
    if numeric:
        known = Known(ready, numeric, order_by, mode)
        tables.add(
            statistics=lambda: stats.moments(ready, numeric, signed_cv=True, base=known.facts()).join(known.quantile_table(), "column"),
            outliers=lambda: stats.iqr_outliers(ready, numeric, order_by, quartiles=known.quantiles(0.25, 0.75)),
            predictions=lambda: trend.trend_fit(ready, order_by=order_by, min_rows=5, lines=known.lines()),
            forecasts=lambda: trend.forecast(ready, order_by=order_by, min_rows=5, lines=known.lines()),
            features=feature_rows,
            featured=lambda: features.with_features(ready, order_by, numeric, found.date),
            insights=lambda: materialised(_classic_insights(ready, tables, numeric, categorical, found.date)),
            key_metrics=lambda: insights.key_metrics(tables["statistics"]),
            report_counts=lambda: insights.report_counts(
                ready.agg(F.count(F.lit(1)).alias("rows")), feature_rows(), checks, tables["insights"]),
        )
    if len(numeric) > 1:
        tables.add(strong_pairs=lambda: assoc.strong_pairs(assoc.corr_pairs(ready, numeric, facts=known.pairs())),
                   regression=lambda: assoc.best_predictor(ready, numeric))
    if categorical:
        tables.add(categories=lambda: stats.category_profile(ready, categorical))
    return Report(label, "OK", None, found, [], tables)


def _classic_insights(ready, tables, numeric, categorical, dates):
    spark = ready.sparkSession
    pairs = tables["strong_pairs"] if "strong_pairs" in tables else spark.createDataFrame(
        [], "col1 string, col2 string, r double, r2 double, strength string, direction string, p_explained double")
    dominant = insights.dominant_values(ready, categorical) if categorical else spark.createDataFrame(
        [], "column string, value string, count bigint, distinct bigint, pct_of_rows double")
    return insights.plain_insights(
        tables["statistics"], pairs, tables["predictions"], tables["outliers"], dominant,
        insights.feature_facts(tables["featured"], numeric, dates))


def analyse_separately(tables, order_by=None, **options):
    """one report per table."""
    order_by = order_by or {}
    return {label: analyse(df, label, order_by.get(label), **options) for label, df in tables.items()}


def analyse_union(tables, order_by=None, **options):
    """The tagged union, analysed with the wider missing limit."""
    return analyse(tagged_union(tables), "Combined Dataset", order_by, combined=True, **options)
