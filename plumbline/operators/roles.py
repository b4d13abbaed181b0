"""What each column is: number, row index, key, category or date."""

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import functions as F

from plumbline.functions.expr import (
    INTEGRAL, col, columns_of, date_columns, numeric_columns, text_columns,
)
from plumbline.functions.names import (
    KEY_CODE_PATTERN, KEY_LONG_CODE_PATTERN, is_key_name, is_row_index_name,
)
from plumbline.operators.stats import per_column

# The date layouts a text column is tried against, most common first.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd",
    "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yyyy",
    "dd MMM yyyy", "dd-MMM-yyyy", "MMM dd, yyyy", "yyyyMMdd",
)


@dataclass
class Roles:
    """Column names by role, in table order."""

    numeric: list = field(default_factory=list)
    index: list = field(default_factory=list)
    categorical: list = field(default_factory=list)
    date: list = field(default_factory=list)


def contiguous_integers(df, columns=None, min_rows=5):
    """{column: True} for null-free integer columns holding n distinct consecutive values.

    The range test rules out almost every column in one aggregate; only the rest pay for a distinct count.
    """
    columns = columns_of(df, INTEGRAL) if columns is None else columns
    if not columns:
        return {}
    ranges = per_column(df, columns, lambda c: [
        F.count(col(c)).alias("n"), F.min(col(c)).cast("bigint").alias("lo"), F.max(col(c)).cast("bigint").alias("hi")])
    found = {c: False for c in columns}
    for r in ranges.collect():
        n = r["n"]
        if r["rows"] > min_rows and n == r["rows"] and n >= 2 and r["hi"] - r["lo"] + 1 == n:
            found[r["column"]] = df.select(col(r["column"])).distinct().count() == n
    return found


def row_index_table(df, classic=False):
    """B2: one row per numeric column with the name test and the value test."""
    numeric = numeric_columns(df)
    counting = contiguous_integers(df)
    rows = [(c, is_row_index_name(c, classic), counting.get(c, False)) for c in numeric]
    table = df.sparkSession.createDataFrame(rows, "column string, by_name boolean, by_values boolean")
    return table.withColumn("is_index", F.col("by_name") | F.col("by_values"))


def detect_ids(df, classic=False):
    counting = contiguous_integers(df)
    return [c for c in numeric_columns(df) if is_row_index_name(c, classic) or counting.get(c, False)]


def code_shares(df, columns=None):
    """Per text column: the share of non-null values shaped like short or long codes."""
    columns = columns or text_columns(df)
    return per_column(df, columns, lambda c: [
        F.count(col(c)).alias("n"),
        F.avg(col(c).rlike(KEY_CODE_PATTERN).cast("int")).alias("code_share"),
        F.avg(col(c).rlike(KEY_LONG_CODE_PATTERN).cast("int")).alias("long_code_share")])


def _key_facts(df, mode="reference"):
    """[(column, by name, by values, code share, long code share, verdict)]: two aggregates for all columns."""
    counting = contiguous_integers(df)
    texts = text_columns(df)
    shapes = {r["column"]: r for r in code_shares(df, texts).collect()} if texts else {}
    found = []
    for c in df.columns:
        short, long = (shapes[c]["code_share"], shapes[c]["long_code_share"]) if c in shapes else (None, None)
        by_name, by_values = is_key_name(c, mode), counting.get(c, False)
        found.append((c, by_name, by_values, short, long, by_name or by_values or (short or 0) > 0.8 or (long or 0) > 0.5))
    return found


def key_table(df, mode="reference"):
    """One row per column with the three key tests and the verdict."""
    schema = ("column string, by_name boolean, by_values boolean, code_share double, long_code_share double, is_key boolean")
    table = df.sparkSession.createDataFrame(_key_facts(df, mode), schema)
    return table.withColumns({c: F.round(c, 4) for c in ("code_share", "long_code_share")})


def detect_keys(df, mode="reference"):
    return [c for c, *_, is_key in _key_facts(df, mode) if is_key]


# Digits and letters, and what stands for them in a shape.
_MARKED = "0123456789" + "".join(chr(65 + i) + chr(97 + i) for i in range(26))
_MARKS = "9" * 10 + "a" * 52
_WIDTHS = {"yyyy": ["9999"], "MMM": ["aaa"], "MM": ["99"], "M": ["9", "99"], "dd": ["99"], "d": ["9", "99"], "HH": ["99"], "mm": ["99"], "ss": ["99"]}


def layout_shapes(layout):
    """The shapes (digits as 9, letters as a) that a text in the layout can have."""
    parts = [m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", layout)]
    marked = lambda p: ["".join("a" if c.isalpha() else c for c in p.strip("'"))]
    return ["".join(p) for p in product(*[_WIDTHS.get(p) or marked(p) for p in parts])]


def shape(text):
    return F.translate(text, _MARKED, _MARKS)


def _parsed(text, shaped, layout):
    """A text as a timestamp; texts of other shapes are kept away from the parser."""
    return F.when(shaped.isin(layout_shapes(layout)), F.try_to_timestamp(text, F.lit(layout)))


def parsed_date(c, layout):
    text = F.trim(col(c))
    return _parsed(text, shape(text), layout)


def date_votes(df, columns=None, formats=DATE_FORMATS):
    """Per text column and layout: the share of all rows that parse. One scan: texts are lined up under their column's name, and
    only those with the shape of a layout are tried against it, so that the plan has each layout once, however many columns there are."""
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, format string, at int, share double")
    lengths = [len(s) for f in formats for s in layout_shapes(f)]
    lined = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(col(c)).alias("text")) for c in columns])).alias("t")).select("t.*")
    shaped = lined.withColumn("shape", F.when(F.length("text").between(min(lengths), max(lengths)), shape(F.col("text"))))
    votes = shaped.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(_parsed(F.col("text"), F.col("shape"), f)).alias(f"v{j}") for j, f in enumerate(formats)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(j).alias("at"), (F.col(f"v{j}") / F.col("rows")).alias("share")) for j, f in enumerate(formats)]))
    return votes.select("column", each.alias("v")).select("column", "v.*")


def date_formats(df, columns=None, formats=DATE_FORMATS, least=0.6):
    """{column: layout} for text columns where one layout parses more than ``least`` of all rows."""
    best = F.max(F.struct("share", (-F.col("at")).alias("first"), "format"))
    found = date_votes(df, columns, formats).groupBy("column").agg(best.alias("b")).where(F.col("b.share") > least)
    return {r["column"]: r["b"]["format"] for r in found.collect()}


def promote_dates(df, columns=None, formats=DATE_FORMATS, least=0.6):
    """Text columns that are mostly dates in one layout become timestamps; other values become null."""
    chosen = date_formats(df, columns, formats, least)
    return df.withColumns({c: parsed_date(c, f) for c, f in chosen.items()})


def classify(df, blocked=(), classic=False):
    """B1: roles of the columns. Dates stay dates even when blocked; keys never count as numbers."""
    index = detect_ids(df, classic)
    return Roles(
        numeric=[c for c in numeric_columns(df) if c not in index and c not in blocked],
        index=index,
        categorical=[c for c in text_columns(df) if c not in blocked],
        date=date_columns(df),
    )


def roles_table(df, blocked=(), classic=False):
    """B1 as a table."""
    roles = classify(df, blocked, classic)
    rows = [(c, r) for r in ("numeric", "index", "categorical", "date") for c in getattr(roles, r)]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


