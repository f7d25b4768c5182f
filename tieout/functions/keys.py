"""Key projection: normalisation and null-safe composite keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.strip() removes every char for which isspace() is true; Java's
# (?U)\s covers the Unicode White_Space set but not the four separators
# U+001C..U+001F that Python also treats as space, so they are added.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def normalize_key(col: Column) -> Column:
    """strip().lower() of a string column (whole Unicode whitespace set)."""
    return F.lower(F.regexp_replace(col, _EDGE_SPACE, ""))


def key_columns(df: DataFrame, key_fields: list[str], normalize: bool) -> list[Column]:
    """One column per key part, in ``key_fields`` order.

    A field absent from the schema reads as the empty string, as a missing
    dict key does in the reference; string parts are normalised when asked.
    """
    names = set(df.columns)
    out = []
    for f in key_fields:
        if f not in names:
            out.append(F.lit(""))
            continue
        dt = df.schema[f].dataType
        c = F.col(f"`{f}`")
        if normalize and isinstance(dt, T.StringType):
            c = normalize_key(c)
        out.append(c)
    return out


def key_type(df: DataFrame, field: str) -> T.DataType:
    if field not in df.columns:
        return T.StringType()
    return df.schema[field].dataType


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest type that holds both: keys are compared in it, never cut to one side's type."""
    if not isinstance(a, T.NumericType):
        return a
    if isinstance(a, T.FractionalType) and isinstance(b, T.FractionalType) and not (
            isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType)):
        return T.DoubleType()
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
    if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (whole[type(t)], 0)
                  for t in (a, b)]
        scale = max(d[1] for d in digits)
        return T.DecimalType(min(38, max(d[0] for d in digits) + scale), scale)
    return a if whole[type(a)] >= whole[type(b)] else b


def check_key_types(left: DataFrame, right: DataFrame, key_fields: list[str]) -> list[T.DataType]:
    """Keys of different kinds never compare equal in the reference (``1`` vs
    ``"1"``); Spark would cast silently, so reject it up front. Numeric
    widening is allowed."""
    out = []
    for f in key_fields:
        lt, rt = key_type(left, f), key_type(right, f)
        ln, rn = isinstance(lt, T.NumericType), isinstance(rt, T.NumericType)
        if type(lt) is not type(rt) and not (ln and rn):
            raise ValueError(f"key field {f!r} has type {lt.simpleString()} on one side "
                             f"and {rt.simpleString()} on the other")
        out.append(lt if type(lt) is type(rt) and lt == rt else wider(lt, rt))
    return out


def null_default(dt: T.DataType) -> Column:
    """A non-null value of the type, which stands for NULL in key parts."""
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dt)
    if isinstance(dt, T.BinaryType):
        return F.lit("").cast(dt)
    if isinstance(dt, T.DayTimeIntervalType):
        return F.make_dt_interval().cast(dt)
    raise ValueError(f"a key of type {dt.simpleString()} cannot be matched")


def null_safe_parts(col: Column, dt: T.DataType, name: str) -> list[Column]:
    """(value-with-default, is-null) pair so plain equality behaves like
    ``<=>``; grouping and hash partitioning then stay on the same columns.
    Every type has a non-null default: an equi-join never loses a NULL key."""
    return [F.coalesce(col.cast(dt), null_default(dt)).alias(f"{name}_v"), col.isNull().alias(f"{name}_n")]
