"""Null and ANSI contract: column helpers that give pandas-like results
under Spark 4's ANSI mode without leaving the JVM.

Every helper returns a ``Column``; none of them is a UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, default=None) -> Column:
    """``num / den`` that yields NULL (or ``default``) instead of a
    DIVIDE_BY_ZERO error when the denominator is zero or NULL."""
    q = F.try_divide(col_(num), col_(den))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def eps_div(num, den, eps: float) -> Column:
    """``num / (den + eps)``: the epsilon form kept for parity; still NULL-safe."""
    return F.try_divide(col_(num), col_(den) + F.lit(eps))


def not_in(c, values: Iterable) -> Column:
    """Anti-membership that keeps NULL rows (``~isin`` semantics of pandas)."""
    return ~F.coalesce(col_(c).isin(list(values)), F.lit(False))


def ne_safe(c, value) -> Column:
    """``c != value`` that keeps NULL rows."""
    return ~col_(c).eqNullSafe(F.lit(value))


def finite_or_null(c) -> Column:
    """NaN and +/-inf become NULL so aggregates skip them like pandas does."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def finite_all(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """One projection that applies ``finite_or_null`` to every floating column."""
    skip = set(exclude)
    cols = {f.name: finite_or_null(f.name).cast(f.dataType)
            for f in df.schema.fields
            if f.name not in skip and f.dataType.typeName() in ("double", "float")}
    return df.withColumns(cols) if cols else df


def try_number(c, to: str = "double") -> Column:
    """Coerce text to a number; bad input becomes NULL, never an error.
    ``NaN``/``inf`` spellings become NULL as well (they are missing values)."""
    v = F.trim(col_(c).cast("string")).try_cast(to)
    if to in ("double", "float"):
        v = finite_or_null(v)
    return v


def sum_or_zero(c) -> Column:
    """pandas ``groupby().sum()``: an all-missing group sums to 0."""
    return F.coalesce(F.sum(col_(c)), F.lit(0.0))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in skip]


def existing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in wanted if c in have]


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def add_missing_columns(df: DataFrame, cols: Iterable[str], value=None, dtype: str = "double") -> DataFrame:
    """Columns a later step expects but the input lacks become a constant."""
    missing = {c: F.lit(value).cast(dtype) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def out_round(c, digits: int = 6) -> Column:
    """Presentation rounding used by registered queries: fixed digits, half
    away from zero, no -0.0.  Plain arithmetic (``round`` on doubles goes
    through BigDecimal and costs ~10x the whole query on wide outputs).  Same
    arithmetic as SQL engines that compute round(x * 10^d) / 10^d: at
    magnitudes where x * 10^d is already an integer it is returned as is."""
    x = col_(c)
    m = float(10 ** digits)
    scaled = F.abs(x) * F.lit(m)
    fast = F.signum(x) * F.floor(scaled + F.lit(0.5)) / F.lit(m)
    return F.when(scaled < F.lit(2.0 ** 52), fast).otherwise(x * F.lit(m) / F.lit(m)) + F.lit(0.0)
