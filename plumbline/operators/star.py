"""Fact and dimension tables: finding them, joining them, and reporting how well they fit."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import col, numeric_columns
from plumbline.functions.names import DIMENSION_WORDS, FACT_WORDS, has_word
from plumbline.operators.roles import detect_keys
from plumbline.operators.stats import union_all

SPREAD = 64


@dataclass
class Dim:
    """A dimension: its rows, the fact's column, its own column (the same name unless given), its name and its keys."""

    df: DataFrame
    fact_key: str
    dim_key: str = None
    name: str = None
    keys: list = None

    def __post_init__(self):
        self.dim_key = self.dim_key or self.fact_key
        self.name = self.name or self.dim_key


def kept_columns(dim, keys):
    """The dimension's key and its columns that are not keys themselves."""
    return [c for c in dim.df.columns if c == dim.dim_key or c not in keys]


def clash_names(taken, columns, key, name):
    """A non-key name already present gets the first eight characters of the dimension's name."""
    return {c: f"{c}_{name[:8]}" for c in columns if c != key and c in taken}


def star_join(fact, dims, prune=True):
    """Left joins of every dimension whose key the fact had from the start.

    A repeated dimension key fans out. Null keys match nothing; they carry one of ``SPREAD`` numbers into the join,
    so that they do not meet in one task. No dimension is run to size it: Spark broadcasts a side whose size, by
    file statistics or after its own shuffle, is under its limit, and splits skewed keys otherwise.
    """
    out, original = fact, set(fact.columns)
    for dim in dims:
        if dim.fact_key not in original or dim.dim_key not in dim.df.columns:
            continue
        columns = kept_columns(dim, dim.keys if dim.keys is not None else detect_keys(dim.df)) if prune else dim.df.columns
        clash = clash_names(out.columns, columns, dim.dim_key, dim.name)
        renamed = dim.df.select(*[col(c).alias(clash.get(c, c)) for c in columns])
        side = renamed.withColumnRenamed(dim.dim_key, "_dim_key").withColumn(
            "_spread", F.pmod(F.xxhash64("_dim_key"), F.lit(1)))  # always 0, yet no constant that the planner would take out of the keys
        spread = F.when(col(dim.fact_key).isNull(), F.monotonically_increasing_id() % SPREAD + 1).otherwise(F.lit(0))
        spread_out = out.withColumn("_own_spread", spread)
        met = (spread_out[dim.fact_key] == side["_dim_key"]) & (spread_out["_own_spread"] == side["_spread"])
        out = spread_out.join(side, met, "left").drop("_dim_key", "_spread", "_own_spread")
    return out


def relationships(fact, dims, fact_name="fact"):
    """E5: per relation the rows with a key, rows that find it, orphans, and the measured cardinality.

    Keys are counted before they are joined, so a hot key travels as one row.
    """
    frames = []
    for dim in dims:
        fact_keys = fact.groupBy(col(dim.fact_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        dim_keys = dim.df.where(col(dim.dim_key).isNotNull()).groupBy(col(dim.dim_key).alias("k")).agg(
            F.count(F.lit(1)).alias("copies"))
        met = fact_keys.join(dim_keys, "k", "full_outer")
        has_fact = F.col("n").isNotNull() & F.col("k").isNotNull()
        frames.append(met.agg(
            F.coalesce(F.sum(F.when(has_fact, F.col("n"))), F.lit(0)).alias("keyed_rows"),
            F.coalesce(F.sum(F.when(has_fact & F.col("copies").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"),
            F.coalesce(F.sum(F.when(has_fact & F.col("copies").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
            F.coalesce(F.max("copies"), F.lit(0)).alias("most_copies"),
            F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("most_uses"),
        ).select(
            F.lit(fact_name).alias("fact"), F.lit(dim.name).alias("dim"), F.lit(dim.fact_key).alias("key"),
            F.when((F.col("most_copies") <= 1) & (F.col("most_uses") <= 1), "one-to-one")
            .when(F.col("most_copies") <= 1, "many-to-one").when(F.col("most_uses") <= 1, "one-to-many")
            .otherwise("many-to-many").alias("type"),
            "keyed_rows", "matched", "orphans"))
    return union_all(frames)


def fact_candidates(tables, keys=None):
    """Rows and measure columns (numeric and not a key) of every table, in table order."""
    keys = keys or {name: detect_keys(df) for name, df in tables.items()}
    measures = {name: [c for c in numeric_columns(df) if c not in keys[name]] for name, df in tables.items()}
    frames = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("position"), F.lit(name).alias("table"), "rows", F.lit(len(measures[name])).alias("measures"))
        for i, (name, df) in enumerate(tables.items())
    ]
    return union_all(frames)


def detect_fact(tables, keys=None):
    """The table with the most rows among those with a measure; the first one wins ties."""
    best = fact_candidates(tables, keys).where("measures > 0 AND rows > 0").orderBy(F.desc("rows"), "position").first()
    return best["table"] if best else None


def shared_keys(tables, mode="reference"):
    """{key column: [tables]} for key columns that occur in more than one table."""
    where = {}
    for name, df in tables.items():
        for c in detect_keys(df, mode):
            where.setdefault(c, []).append(name)
    return {c: names for c, names in where.items() if len(names) > 1}


def schema_type(tables, mode="reference"):
    """Single, star_schema (by table names), relational (by shared keys) or independent."""
    if len(tables) < 2:
        return "single"
    if any(has_word(n, FACT_WORDS) for n in tables) and any(has_word(n, DIMENSION_WORDS) for n in tables):
        return "star_schema"
    return "relational" if shared_keys(tables, mode) else "independent"


def containment(tables, keys):
    """Per ordered pair of tables sharing a key, the share of the first's distinct values found in the second."""
    frames = []
    for key, names in keys.items():
        distinct = {n: tables[n].where(col(key).isNotNull()).select(col(key).alias("k")).distinct() for n in names}
        for a in names:
            for b in names:
                if a != b:
                    met = distinct[a].join(distinct[b].withColumn("hit", F.lit(1)), "k", "left")
                    frames.append(met.agg(F.count(F.lit(1)).alias("values"), F.count("hit").alias("found")).select(
                        F.lit(key).alias("key"), F.lit(a).alias("from_table"), F.lit(b).alias("to_table"), "values", "found",
                        F.round(F.col("found") / F.nullif(F.col("values"), F.lit(0)), 4).alias("containment")))
    return union_all(frames)
