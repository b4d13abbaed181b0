"""Column expressions shared by the operators; all of them stay inside the JVM."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name):
    """A column by its literal name, so that dots and spaces in file headers stay usable."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df, kinds, skip=()):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def numeric_columns(df, skip=()):
    return columns_of(df, NUMERIC, skip)


def text_columns(df, skip=()):
    return columns_of(df, T.StringType, skip)


def date_columns(df, skip=()):
    return columns_of(df, TEMPORAL, skip)


def type_of(df, name):
    return next(f.dataType for f in df.schema.fields if f.name == name)


def class_of(data_type):
    if isinstance(data_type, NUMERIC):
        return "Numeric"
    return "Date/Time" if isinstance(data_type, TEMPORAL) else "Text"


def finite(c):
    """NaN and the infinities become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def numbers(df, columns, keep=()):
    """The columns as doubles without NaN or infinities (under their names), next to the ``keep`` columns.

    Aggregates read these plain attributes, which keeps their compiled code small.
    """
    def value(name):
        whole = isinstance(type_of(df, name), INTEGRAL + (T.DecimalType,))
        return (col(name).cast("double") if whole else finite(col(name))).alias(name)

    return df.select(*[col(k) for k in keep if k not in columns], *[value(c) for c in columns])


def rounded(c, digits=4):
    return F.round(finite(c), digits)


def ratio(a, b):
    """a / b, null where b is 0 or the result is not finite."""
    a, b = a.cast("double"), b.cast("double")
    return finite(F.when(b != 0, a / b))


# What a plain decimal number looks like. Testing the shape first keeps other texts away from the parser,
# whose failures are far dearer than a pattern that fails on the first character.
NUMBER_SHAPE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text):
    """Text to number; what does not parse becomes null."""
    return finite(F.when(text.rlike(NUMBER_SHAPE), F.trim(text).try_cast("double")))


def as_number(df, name):
    """A column as a double, whether it holds numbers or their texts."""
    return number(col(name)) if isinstance(type_of(df, name), T.StringType) else finite(col(name))


def strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def money(c, small="%.0f"):
    """Short money text: $1.2M, $35K; an em dash for nothing or zero."""
    return (
        F.when(c >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", c / 1e6), F.lit("M")))
        .when(c.isNotNull() & (c != 0), F.concat(F.lit("$"), F.format_string(small, c / 1e3), F.lit("K")))
        .otherwise(F.lit("—"))
    )


def grouped_digits(c, digits=0):
    return F.format_string(f"%,.{digits}f", c.cast("double"))


def first_by(value, order_by):
    """Value on the first row of an order (an aggregate)."""
    return F.min_by(value, F.struct(*[col(k) for k in order_by]))


def last_by(value, order_by):
    return F.max_by(value, F.struct(*[col(k) for k in order_by]))


def one_row_to_many(one_row, structs):
    """Turn a one-row aggregate into one output row per struct: k metrics x m columns in one pass."""
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def chunks(items, size):
    return [items[i:i + size] for i in range(0, len(items), size)]
