"""Per-entity time-series features over an entity-period panel.

All windows of one call share one ``partitionBy(entity).orderBy(period)``
spec, so Spark plans a single exchange + sort for them.  A rolled-up panel
has one row per entity and period, so a window partition holds one entity's
series: its size is bounded by the number of periods, not by the data.

Options
-------
frame="inclusive"  rolling means end at the current row (reproduces the
                   published numbers; the target leaks into its features)
frame="lagged"     rolling means use strictly earlier rows only
gap="row"          previous = previous row of the entity (pandas ``shift``)
gap="calendar"     previous = the row of period - 1, NULL if that period is
                   missing (RANGE frame; no self-join, no extra shuffle)
split_col          rolling means and the trend window inside each split as well
                   (train and holdout are featurised separately, as the search
                   script does); the previous value is taken on the whole panel
                   before the split, so a holdout row sees its last training period
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAMES = ("inclusive", "lagged")
GAPS = ("row", "calendar")


def _spec(entity, period, split_col=None):
    keys = ([split_col] if split_col else []) + ([entity] if isinstance(entity, str) else list(entity))
    return Window.partitionBy(*keys).orderBy(F.col(period).asc())


def _bounds(n: int, frame: str) -> tuple[int, int]:
    if frame == "inclusive":
        return -(n - 1), 0
    if frame == "lagged":
        return -n, -1
    raise ValueError(f"frame must be one of {FRAMES}")


def rolling_mean(value, n: int, w, frame: str = "inclusive", gap: str = "row"):
    lo, hi = _bounds(n, frame)
    if gap == "row":
        return F.avg(value).over(w.rowsBetween(lo, hi))
    if gap == "calendar":
        return F.avg(value).over(w.rangeBetween(lo, hi))
    raise ValueError(f"gap must be one of {GAPS}")


def previous(value, w, gap: str = "row"):
    if gap == "row":
        return F.lag(value, 1).over(w)
    # calendar: the value exactly one period earlier (range frame of width 0)
    return F.avg(value).over(w.rangeBetween(-1, -1))


def trend_features(df: DataFrame, entity="team", period: str = "season_end_year",
                   value: str = "win_pct", prefix: str | None = None, frame: str = "inclusive",
                   gap: str = "row", split_col: str | None = None) -> DataFrame:
    """Adds ``prev_<v>``, ``<v>_3y``, ``<v>_5y`` and ``<v>_trend``."""
    p = prefix or value
    w = _spec(entity, period, split_col)
    df = df.withColumns({
        f"prev_{p}": previous(F.col(value), _spec(entity, period), gap),
        f"{p}_3y": rolling_mean(F.col(value), 3, w, frame, gap),
        f"{p}_5y": rolling_mean(F.col(value), 5, w, frame, gap),
    })
    # trend = change of the 3-period mean; same window spec -> same exchange
    return df.withColumn(f"{p}_trend", F.col(f"{p}_3y") - previous(F.col(f"{p}_3y"), w, gap))


def rolling_box(df: DataFrame, measures=("pts", "ast", "trb", "stl", "blk"), entity="team",
                period: str = "season_end_year", n: int = 3, frame: str = "inclusive",
                gap: str = "row", split_col: str | None = None) -> DataFrame:
    """``<m>_3y`` rolling means of several measures in one projection."""
    w = _spec(entity, period, split_col)
    return df.withColumns({f"{m}_{n}y": rolling_mean(F.col(m), n, w, frame, gap) for m in measures})


def lag_calendar(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Row lag and calendar lag side by side (they differ where a series has gaps)."""
    w = _spec(entity, period)
    return df.withColumns({
        f"prev_{value}_row": previous(F.col(value), w, "row"),
        f"prev_{value}_cal": previous(F.col(value), w, "calendar"),
        f"prev_{period}_row": F.lag(F.col(period), 1).over(w),
    })
