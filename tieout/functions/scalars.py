"""Scalar column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _inf() -> Column:
    return F.lit(float("inf"))


def pct_diff(diff: Column, base: Column, other: Column) -> Column:
    """|diff| / |base|; base 0 -> 0 if other is 0 else +inf. Guarded: ANSI
    division by zero raises."""
    return F.when(base == 0, F.when(other == 0, F.lit(0.0)).otherwise(_inf())) \
        .otherwise(F.abs(diff) / F.abs(base))


def pct_text(p: Column, decimals: int) -> Column:
    """Python ``{p:.Nf%}``: value x 100 with N decimals and a percent sign;
    infinity renders as ``inf%``."""
    return F.when(F.isnull(p), F.lit(None)) \
        .when(p == _inf(), F.lit("inf%")) \
        .otherwise(F.format_string(f"%.{decimals}f%%", p * 100))


def seq_id(prefix: str, n: Column, width: int) -> Column:
    """``PREFIX-%0Nd``; grows past the width instead of truncating."""
    return F.format_string(f"{prefix}-%0{width}d", n)


def deviation_pct(value: Column, rounded_mean: Column) -> Column:
    """Deviation from the (2-decimal) baseline mean in percent."""
    return F.when(rounded_mean == 0, F.when(value != 0, _inf()).otherwise(F.lit(0.0))) \
        .otherwise(F.abs(value - rounded_mean) / F.abs(rounded_mean) * 100)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_preview(h: Column) -> Column:
    return F.concat(F.substring(h, 1, 16), F.lit("..."))


def canonical_set(arr: Column) -> Column:
    """A set-valued array in canonical form (distinct, sorted), so hashing
    does not depend on insertion order."""
    return F.array_sort(F.array_distinct(arr))


def require_columns(df: DataFrame, columns, what: str) -> None:
    """Raise a ``ValueError`` that names the absent columns, before any job. Names are compared as Spark
    does by default, without case; of a nested field the column counts."""
    there = {c.lower() for c in df.columns}
    absent = [c for c in columns if c is not None and not {c.lower(), c.lower().split(".")[0]} & there]
    if absent:
        raise ValueError(f"{what} has no column {', '.join(map(repr, absent))}")
