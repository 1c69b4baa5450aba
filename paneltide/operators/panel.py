"""Entity-period rollups, curves and the team-season panel builder.

Aggregations are plain ``groupBy().agg()``: Spark plans a partial (map-side)
hash aggregate before the shuffle, so a hot entity holding a third of the
rows contributes one partial row per task, not a third of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import player_pcts, season_label, shooting_pcts, win_pct
from ..functions.nulls import ne_safe, not_in, sum_or_zero

# Combined multi-team row codes and the rollup measure lists.
COMBINED_CODES = ("2TM", "3TM", "4TM", "5TM")
TOTAL_CODE = "TOT"
TEAM_SUM_MEASURES = ("fg", "fga", "p3", "p3a", "p2", "p2a", "ft", "fta", "orb", "drb", "trb",
                     "ast", "stl", "blk", "tov", "pf", "pts", "trp_dbl")
PLAYER_SUM_MEASURES = ("g", "gs", "mp", "fg", "fga", "p3", "p3a", "p2", "p2a", "ft", "fta",
                       "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts", "trp_dbl")
PANEL_KEYS = ("season", "season_end_year", "team")
GROUP_KEYS = ("season_end_year", "team")   # the season label is a function of the end year


def drop_combined(df: DataFrame, policy: str = "drop", team: str = "team") -> DataFrame:
    """Combined rows policy: ``drop`` (keep NULL teams), ``only`` or ``keep``."""
    if policy == "keep":
        return df
    if policy == "drop":
        return df.where(not_in(team, COMBINED_CODES))
    if policy == "only":
        return df.where(F.col(team).isin(*COMBINED_CODES))
    raise ValueError("policy must be drop, only or keep")


def rollup_sum(df: DataFrame, keys=PANEL_KEYS, measures=TEAM_SUM_MEASURES) -> DataFrame:
    """Sum of measures per key; NULL keys are dropped and all-NULL groups
    sum to 0 (pandas ``groupby().sum()``)."""
    keys = list(keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(*[sum_or_zero(m).alias(m) for m in measures])


def rollup_mixed(df: DataFrame, keys=PANEL_KEYS, measures=PLAYER_SUM_MEASURES,
                 mean_cols=("age",)) -> DataFrame:
    keys = list(keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    aggs = [sum_or_zero(m).alias(m) for m in measures] + [F.avg(c).alias(c) for c in mean_cols]
    return df.where(cond).groupBy(*keys).agg(*aggs)


def with_season_label(df: DataFrame) -> DataFrame:
    """Add the ``YYYY-YYYY`` label once per output row (not per fact row)."""
    t = df.withColumn("season", season_label("season_end_year"))
    return t.select(*PANEL_KEYS, *[c for c in t.columns if c not in PANEL_KEYS])


def team_totals(perf: DataFrame) -> DataFrame:
    """Team-season totals without combined rows, plus shooting percentages.
    Grouped on (period, team); the season label is derived after the aggregate."""
    return with_season_label(rollup_sum(drop_combined(perf), keys=GROUP_KEYS)).withColumns(shooting_pcts())


def join_outcome(totals: DataFrame, outcome: DataFrame) -> DataFrame:
    """Left join of outcomes on (season, team): unmatched teams keep NULL W/L.
    Both sides are keyed aggregates of the facts; a shuffle join on the key
    (AQE turns it into a broadcast when the outcome side is small)."""
    o = outcome.select("season_end_year", "team", "wins", "losses")
    return totals.join(o, ["season_end_year", "team"], "left")


def team_season(perf: DataFrame, outcome: DataFrame) -> DataFrame:
    """The team-season summary: keys first, then totals, pcts and W/L."""
    t = join_outcome(team_totals(perf), outcome)
    rest = [c for c in t.columns if c not in PANEL_KEYS]
    return t.select(*PANEL_KEYS, *rest)


def player_team_panel(perf: DataFrame, min_minutes: float = 200.0) -> DataFrame:
    """Player rows -> team-season rows (TOT dropped null-safely, minutes
    floor, sums + mean age, epsilon ratios)."""
    p = perf.where(ne_safe("team", TOTAL_CODE)).where(F.col("mp") >= min_minutes)
    return with_season_label(rollup_mixed(p, keys=GROUP_KEYS)).withColumns(player_pcts())


def with_win_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("win_pct", win_pct("wins", "losses"))


def curve(df: DataFrame, by: str, measure: str = "pts", how: str = "sum",
          out: str | None = None, rate_den: str | None = None) -> DataFrame:
    """Measure by attribute (ageing / experience curves); rows with a missing
    key or measure are skipped first (pandas ``dropna``)."""
    d = df.where(F.col(by).isNotNull() & F.col(measure).isNotNull())
    if how == "sum":
        agg = F.sum(measure)
    elif how == "avg":
        agg = F.avg(measure)
    elif how == "rate":
        agg = F.avg(F.try_divide(F.col(measure), F.col(rate_den)))
    else:
        raise ValueError(how)
    return d.groupBy(by).agg(agg.alias(out or f"{measure}_{how}"))


def with_experience(df: DataFrame, who: str = "player", period: str = "season",
                    out: str = "seasons_played") -> DataFrame:
    """Total distinct periods per player, joined back onto every row.
    The distinct count is a two-level aggregate (distinct pairs, then count),
    so no player's rows are gathered in one task."""
    pairs = df.select(who, period).where(F.col(period).isNotNull()).distinct()
    exp = pairs.groupBy(who).agg(F.count(F.lit(1)).cast("int").alias(out))
    return df.join(exp, who, "left")


def experience_totals(df: DataFrame, who: str = "player", period: str = "season",
                      measure: str = "pts") -> DataFrame:
    """Per player: distinct periods played and the measure's sum / count of
    non-missing values (one pass, no join back onto the rows)."""
    return df.groupBy(who).agg(
        F.count_distinct(period).cast("int").alias("seasons_played"),
        F.sum(measure).alias(measure),
        F.count(measure).alias(f"n_{measure}"))


def dedup_first(df: DataFrame, key, order) -> DataFrame:
    """Keep the first row per key under an explicit ascending order
    (``drop_duplicates(keep="first")``).  ``min_by`` is a partial aggregate:
    a key repeated millions of times is reduced map-side, never sorted in
    one task."""
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())   # over <= #classes rows
    return counts.withColumn("share", F.col("n") / total)
