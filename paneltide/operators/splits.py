"""Temporal splits.  A split needs only the last few period values: they are read from
the period column alone and become a literal filter, so partitions of a
period-partitioned table are pruned and no row is written or joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_n_periods(df: DataFrame, period: str, n: int) -> list:
    """The last ``n`` distinct periods (``sorted(unique())[-n:]``), newest first."""
    rows = df.select(period).where(F.col(period).isNotNull()).distinct().orderBy(F.col(period).desc()).limit(n).collect()
    return [r[0] for r in rows]


def in_last_n(df: DataFrame, period: str, n: int) -> Column:
    """True for rows of the last ``n`` periods; a NULL period is never one of them."""
    last = last_n_periods(df, period, n)
    return F.coalesce(F.col(period).isin(*last), F.lit(False)) if last else F.lit(False)


def flag_last_n(df: DataFrame, period: str, n: int, out: str = "is_holdout") -> DataFrame:
    """Flag rows of the last ``n`` periods."""
    return df.withColumn(out, in_last_n(df, period, n))


def split_last_n(df: DataFrame, period: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): holdout = rows in the last ``n`` periods."""
    hold = in_last_n(df, period, n)
    return df.where(~hold), df.where(hold)


def split_threshold(df: DataFrame, period: str, last_train: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(period) <= last_train), df.where(F.col(period) > last_train)


def recent_mask(df: DataFrame, period: str, k: int = 3, out: str = "is_recent") -> DataFrame:
    """Rows in the last ``k`` calendar periods up to the frame's maximum."""
    mx = df.agg(F.max(period)).scalar()      # scalar subquery, one row
    return df.withColumn(out, F.col(period) > mx - k)


def enough_periods(df: DataFrame, period: str, minimum: int) -> int:
    """Guard: raise when fewer than ``minimum`` distinct periods exist."""
    n = df.select(period).distinct().count()
    if n < minimum:
        raise RuntimeError(f"need at least {minimum} periods, found {n}")
    return n
