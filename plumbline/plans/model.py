"""From several tables to one joined, measured business table."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from plumbline.operators import ask, business
from plumbline.operators.features import add_measures
from plumbline.operators.profile import joined_schema_profile
from plumbline.operators.roles import detect_keys
from plumbline.operators.star import Dim, detect_fact, relationships, star_join
from plumbline.plans.analysis import analyse
from plumbline.sources import files
from plumbline.functions.expr import numeric_columns


@dataclass
class Model:
    """A joined table and the tables it came from; its reports are built when asked for."""

    df: DataFrame
    fact: str
    base: DataFrame = None
    dims: list = field(default_factory=list)
    keys: list = field(default_factory=list)

    def relationships(self):
        return relationships(self.base, self.dims, self.fact)

    def measures(self):
        skip = {*self.keys, "Cost", "Profit", "Profit_Pct"}
        return ask.measure_dictionary(self.df, [c for c in numeric_columns(self.df) if c not in skip])

    def schema(self, order_by=None):
        return joined_schema_profile(self.df, self.fact, {d.fact_key: d.name for d in self.dims}, self.keys, order_by)


def read_model(spark, folder, fact=None, sep=","):
    """E7 with A4, A6: (tables of a folder by name, the fact's name). Every CSV file beside the fact's may hold several dimensions next to each
    other, each of which becomes a table named by its key; without a fact the files stay as they are."""
    tables = files.read_tables(spark, folder)
    fact = fact or detect_fact(tables, {name: detect_keys(df) for name, df in tables.items()})
    if fact is None:
        return tables, None
    return split_dimensions(tables, fact, {
        label: files.split_side_by_side(spark, path, sep) for label, path in files.labelled_files(spark, folder).items()
        if label in tables and label != fact and path.lower().endswith(".csv")}), fact


def split_dimensions(tables, fact, parts):
    """The tables with those named in ``parts`` replaced by their parts; a part's name that is taken gets its table's name before it."""
    found = {fact: tables[fact]}
    for name, df in tables.items():
        for key, part in parts.get(name, {name: df}).items() if name != fact else ():
            found[key if key not in found else f"{name}:{key}"] = part
    return found


def join_folder(spark, folder, fact=None):
    """The joined model of a folder of files."""
    tables, fact = read_model(spark, folder, fact)
    return join_model(tables, fact)


def join_model(tables, fact=None):
    """Find the fact table, join every table that shares one of its keys, derive measures.

    A dimension joins on its first key column that the fact has too and brings no other keys, so the keys of
    the joined table are the fact's.
    """
    keys = {name: detect_keys(df) for name, df in tables.items()}
    fact = fact or detect_fact(tables, keys)
    if fact is None:
        name, df = next(iter(tables.items()))
        return Model(df, None)
    base = tables[fact]
    dims = []
    for name, df in tables.items():
        key = next((k for k in keys[name] if k in base.columns), None)
        if name != fact and key:
            dims.append(Dim(df, key, key, name, keys[name]))
    return Model(add_measures(star_join(base, dims)), fact, base, dims, keys[fact])


def business_rollups(df, roles=None, order_by=()):
    """H1-H9 for the roles the table has."""
    found = business.roles_of(df, roles)
    if "amount" not in found:
        return {}
    made = {}
    needs = {
        "top_products": ("product", business.top_products), "leaderboard": ("person", business.leaderboard),
        "amount_by_geo": ("geo", lambda d, r: business.amount_by_geo(d, r, order_by)),
        "amount_by_category": ("category", business.amount_by_category),
        "monthly_trend": ("date", business.monthly_trend), "status_breakdown": ("status", business.status_breakdown),
        "team_performance": ("team", business.team_performance),
    }
    for name, (role, build) in needs.items():
        if role in found:
            made[name] = build(df, found)
    if "product" in found and "profit" in found:
        made["product_profit"] = business.product_profit(df, found)
    made["business_kpis"] = business.business_kpis(df, found)
    return made


def analyse_model(tables, order_by=None, label="model", **options):
    """3.2: join, analyse with the wider missing limit, add the business rollups and KPI cards."""
    model = join_model(tables)
    report = analyse(model.df, label, order_by, combined=True, **options)
    if report.status == "OK":
        rollups = business_rollups(model.df, order_by=order_by or ())
        report.tables.add(**{name: (lambda df=df: df) for name, df in rollups.items()})
        if "business_kpis" in rollups:
            report.tables.add(kpis=lambda: rollups["business_kpis"])
    return model, report
