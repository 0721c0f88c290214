"""Coercion, clipping and scaling that let bad values become null instead of failing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def to_double(c: Column | str) -> Column:
    """A number, or null for text that is none; the column is named once, so expressions stay small."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c.cast("string"), _NUMBER, 1).try_cast("double")


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double with null for NaN; only text is parsed."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    return to_double(name)


def bounded(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``c`` held within bounds; for columns without nulls, which would become ``lo``."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def clip(c: Column, lo: float | None = 0.0, hi: float | None = 1.0) -> Column:
    """``c`` held within bounds; null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def usable(df: DataFrame, name: str, default: float) -> Column:
    """Column ``name`` as a number within 0 and 1; ``default`` where it is missing or null."""
    if name not in df.columns:
        return F.lit(float(default))
    return bounded(F.coalesce(number(df, name), F.lit(float(default))))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def weighted(weights: dict[str, float], value) -> Column:
    return total([F.lit(float(w)) * value(n) for n, w in weights.items()])


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def minmax_of(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(is_close(hi, lo), 0.0).otherwise((value - lo) / (hi - lo))


def log_value(x: Column, log_scale: bool) -> Column:
    """Null as 0; with ``log_scale`` the logarithm of one more, negatives as 0."""
    x = F.coalesce(x, F.lit(0.0))
    return F.log1p(F.greatest(x, F.lit(0.0))) if log_scale else x


def clean_text(c: Column | str) -> Column:
    """White space made single and trimmed; '', 'nan' and 'None' become null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return F.when(t.isin("", "nan", "None"), None).otherwise(t)


def first_existing(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    return next((a for a in aliases if a in columns), None)


def gap_percent(a: Column, b: Column) -> Column:
    """By how many percent ``a`` exceeds ``b``; null when ``b`` is next to 0."""
    return F.when(F.abs(b) <= 1e-9, F.when(F.abs(a) <= 1e-9, 0.0)).otherwise(F.try_divide(a - b, b) * 100)
