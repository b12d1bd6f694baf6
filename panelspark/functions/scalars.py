"""Scalar expressions with the null rules that the panel operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-10


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null out NaN and infinities of the double and float columns, once, where data come in."""
    chosen = [c for c, t in df.dtypes if t in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: finite(F.col(c)) for c in chosen})


def safe_div(a: Column, b: Column, eps: float = EPSILON) -> Column:
    """a / (|b| + eps)."""
    return a / (F.abs(b) + eps)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL engines without ANSI errors have it: infinite, or NaN for 0 / 0, where b is zero."""
    unit = F.when(b.cast("string") == "-0.0", float("-inf")).otherwise(float("inf"))
    return F.when(b == 0, a * unit).otherwise(F.try_divide(a, b))


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_square(x: Column) -> Column:
    return F.signum(x) * x * x


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def positive(x: Column) -> Column:
    """The value where it is above zero, else null: prices that are no prices."""
    return F.when(x > 0, x)


def table_name(x: Column) -> Column:
    """Characters outside letters, digits, dot, dash and underscore replaced by underscores."""
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_")


def venue_symbol(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias if there is one; a leading ``k`` of a thousand-lot listing taken off."""
    out = F.regexp_replace(x, "^k(?=[A-Z])", "")
    for a, b in (aliases or {}).items():
        out = F.when(x == a, F.lit(b)).otherwise(out)
    return out
