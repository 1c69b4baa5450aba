"""Panel build and per-entity window queries (rollup, outcome join, trend
windows, per-period rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import season_end, season_label, season_start, win_pct
from ..functions.nulls import out_round
from ..operators import panel, windows
from ..operators.rank import rank_desc
from ..sources import driver_tables as dt
from .oracle_sql import OUTCOME, PERF, PERF_AGE, TEAM_SEASON, TEAM_SUMS, TOTALS, r6, with_ctes
from .registry import register


def _rounded(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: out_round(c) for c in cols})


def outcome_trends(spark: SparkSession, sf_dir: str, frame: str = "inclusive") -> DataFrame:
    o = dt.outcome(spark, sf_dir).withColumn("win_pct", win_pct())
    return windows.trend_features(o, "team", "season_end_year", "win_pct", frame=frame)


TREND_COLS = ["win_pct", "prev_win_pct", "win_pct_3y", "win_pct_5y", "win_pct_trend"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entities beat their own trend: outcome rollup -> win share ->
    trend windows -> per-period rank."""
    t = outcome_trends(spark, sf_dir)
    t = rank_desc(t, "win_pct", by="season_end_year", out="win_rank")
    t = t.withColumn("above_trend", F.col("win_pct") > F.col("win_pct_3y"))
    return _rounded(t.select("team", "season_end_year", "wins", "losses", *TREND_COLS,
                             "win_rank", "above_trend"), TREND_COLS)


_TREND_SQL = """
w AS (SELECT *, CAST(wins AS DOUBLE) / NULLIF(wins + losses, 0) AS win_pct FROM outcome),
t1 AS (SELECT *,
  lag(win_pct) OVER (PARTITION BY team ORDER BY season_end_year) AS prev_win_pct,
  avg(win_pct) OVER (PARTITION BY team ORDER BY season_end_year ROWS BETWEEN {a3} AND {b}) AS win_pct_3y,
  avg(win_pct) OVER (PARTITION BY team ORDER BY season_end_year ROWS BETWEEN {a5} AND {b}) AS win_pct_5y
  FROM w),
t AS (SELECT *, win_pct_3y - lag(win_pct_3y) OVER (PARTITION BY team ORDER BY season_end_year) AS win_pct_trend
  FROM t1)"""

TREND_INCL = _TREND_SQL.format(a3="2 PRECEDING", a5="4 PRECEDING", b="CURRENT ROW")
TREND_LAG = _TREND_SQL.format(a3="3 PRECEDING", a5="5 PRECEDING", b="1 PRECEDING")


def _trend_select(extra: str = "") -> str:
    return ("SELECT team, season_end_year, wins, losses, "
            + ", ".join(r6(c, c) for c in TREND_COLS) + extra + " FROM t")


FLAGSHIP_SQL = with_ctes(OUTCOME, TREND_INCL) + _trend_select(
    ", CAST(rank() OVER (PARTITION BY season_end_year ORDER BY win_pct DESC) AS INTEGER) AS win_rank"
    ", win_pct > win_pct_3y AS above_trend")

register("flagship", FLAGSHIP_SQL)(flagship)


@register("trend_features", with_ctes(OUTCOME, TREND_INCL) + _trend_select())
def q_trend_features(spark, sf_dir):
    """Previous win share, 3/5-period rolling means (current row included) and trend per team."""
    t = outcome_trends(spark, sf_dir, "inclusive")
    return _rounded(t.select("team", "season_end_year", "wins", "losses", *TREND_COLS), TREND_COLS)


@register("trend_features_lagged", with_ctes(OUTCOME, TREND_LAG) + _trend_select())
def q_trend_features_lagged(spark, sf_dir):
    """The same features from strictly earlier periods only (no target leakage)."""
    t = outcome_trends(spark, sf_dir, "lagged")
    return _rounded(t.select("team", "season_end_year", "wins", "losses", *TREND_COLS), TREND_COLS)


# --- panel rollup and outcome join -------------------------------------------------

@register("panel_rollup", with_ctes(PERF, TOTALS) + "SELECT season, season_end_year, team, "
          + ", ".join(r6(m, m) for m in TEAM_SUMS) + " FROM totals")
def q_panel_rollup(spark, sf_dir):
    """Team-season totals of the 18 counting measures, combined rows dropped (partial aggregation)."""
    t = panel.with_season_label(panel.rollup_sum(panel.drop_combined(dt.perf(spark, sf_dir)), keys=panel.GROUP_KEYS))
    return _rounded(t, panel.TEAM_SUM_MEASURES)


PCTS = ["fg_pct", "p3_pct", "p2_pct", "ft_pct", "efg_pct"]


@register("shooting_pcts", with_ctes(PERF, OUTCOME, TEAM_SEASON)
          + "SELECT season_end_year, team, " + ", ".join(r6(c, c) for c in PCTS) + " FROM team_season")
def q_shooting_pcts(spark, sf_dir):
    """Team-season FG%, 3P%, 2P%, FT% and eFG% from summed totals (0 when undefined)."""
    t = panel.team_totals(dt.perf(spark, sf_dir))
    return _rounded(t.select("season_end_year", "team", *PCTS), PCTS)


@register("join_left_outcome", with_ctes(PERF, OUTCOME, TEAM_SEASON)
          + "SELECT season, season_end_year, team, " + r6("pts", "pts") + ", " + r6("fga", "fga")
          + ", " + ", ".join(r6(c, c) for c in PCTS) + ", wins, losses FROM team_season")
def q_join_left_outcome(spark, sf_dir):
    """Team-season totals left-joined to outcomes; unmatched team codes keep NULL wins/losses."""
    t = panel.team_season(dt.perf(spark, sf_dir), dt.outcome(spark, sf_dir))
    return _rounded(t.select("season", "season_end_year", "team", "pts", "fga", *PCTS, "wins", "losses"),
                    ["pts", "fga", *PCTS])


MIXED = ("g", "gs", "mp", "fg", "fga", "p3", "p3a", "p2", "p2a", "ft", "fta", "orb", "drb", "trb",
         "ast", "stl", "blk", "tov", "pf", "pts", "trp_dbl")
PLAYER_PCTS = ("fg_pct_p", "tp_pct_p", "tp2_pct_p", "ft_pct_p", "ts_pct_p", "efg_pct_p", "ast_to_ratio_p")

_MIXED_SQL = with_ctes(PERF_AGE, """mixed AS (
  SELECT season, season_end_year, team, """ + ", ".join(f"coalesce(sum({m}), 0.0) AS {m}" for m in MIXED) + """,
    avg(age) AS age
  FROM perf_age
  WHERE (team IS DISTINCT FROM 'TOT') AND mp >= 200
    AND season IS NOT NULL AND season_end_year IS NOT NULL AND team IS NOT NULL
  GROUP BY season, season_end_year, team)""", """p AS (
  SELECT *,
    fg / (fga + 1e-8) AS fg_pct_p, p3 / (p3a + 1e-8) AS tp_pct_p, p2 / (p2a + 1e-8) AS tp2_pct_p,
    ft / (fta + 1e-8) AS ft_pct_p, pts / (2 * (fga + 0.44 * fta + 1e-8)) AS ts_pct_p,
    (fg + 0.5 * p3) / (fga + 1e-8) AS efg_pct_p, ast / (tov + 1e-8) AS ast_to_ratio_p
  FROM mixed)""") + "SELECT season, season_end_year, team, " + ", ".join(
    r6(c, c) for c in (*MIXED, "age", *PLAYER_PCTS)) + " FROM p"


@register("panel_rollup_mixed", _MIXED_SQL)
def q_panel_rollup_mixed(spark, sf_dir):
    """Player rows to team-season rows: TOT dropped null-safely, minutes floor, sums + mean age, epsilon ratios."""
    t = panel.player_team_panel(dt.perf(spark, sf_dir, with_age=True))
    return _rounded(t.select("season", "season_end_year", "team", *MIXED, "age", *PLAYER_PCTS),
                    (*MIXED, "age", *PLAYER_PCTS))


# --- windows over other panels ----------------------------------------------------------

_GAPPY = """g AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
  sum(o_totalprice) AS measure FROM orders GROUP BY o_custkey, year(o_orderdate))"""


@register("lag_calendar", with_ctes(_GAPPY) + """SELECT entity, period, """ + r6("measure", "measure") + """,
  """ + r6("lag(measure) OVER (PARTITION BY entity ORDER BY period)", "prev_measure_row") + """,
  """ + r6("avg(measure) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)",
           "prev_measure_cal") + """,
  lag(period) OVER (PARTITION BY entity ORDER BY period) AS prev_period_row FROM g""")
def q_lag_calendar(spark, sf_dir):
    """Row lag and calendar lag side by side on a panel with gaps."""
    g = windows.lag_calendar(dt.gappy_panel(spark, sf_dir), "entity", "period", "measure")
    return _rounded(g, ["measure", "prev_measure_row", "prev_measure_cal"])


BOX = ("pts", "ast", "trb", "stl", "blk")


@register("rolling_box", with_ctes(PERF, OUTCOME, TEAM_SEASON) + "SELECT season_end_year, team, " + ", ".join(
    r6(f"avg({m}) OVER (PARTITION BY team ORDER BY season_end_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
       f"{m}_3y") for m in BOX) + " FROM team_season")
def q_rolling_box(spark, sf_dir):
    """3-period rolling means of five box measures in one window projection."""
    t = windows.rolling_box(panel.team_totals(dt.perf(spark, sf_dir)), BOX)
    return _rounded(t.select("season_end_year", "team", *[f"{m}_3y" for m in BOX]), [f"{m}_3y" for m in BOX])


_SPLIT_TREND = OUTCOME + """,
yrs AS (SELECT season_end_year, dense_rank() OVER (ORDER BY season_end_year DESC) AS rk
        FROM (SELECT DISTINCT season_end_year FROM outcome)),
w AS (SELECT o.*, CAST(wins AS DOUBLE) / NULLIF(wins + losses, 0) AS win_pct, (y.rk <= 2) AS is_holdout
      FROM outcome o JOIN yrs y USING (season_end_year)),
t1 AS (SELECT *,
  lag(win_pct) OVER (PARTITION BY team ORDER BY season_end_year) AS prev_win_pct,
  avg(win_pct) OVER (PARTITION BY is_holdout, team ORDER BY season_end_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS win_pct_3y,
  avg(win_pct) OVER (PARTITION BY is_holdout, team ORDER BY season_end_year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS win_pct_5y
  FROM w),
t AS (SELECT *, win_pct_3y - lag(win_pct_3y) OVER (PARTITION BY is_holdout, team ORDER BY season_end_year) AS win_pct_trend
  FROM t1)"""


@register("trend_features_split", "WITH " + _SPLIT_TREND + "\n" + _trend_select(", is_holdout"))
def q_trend_features_split(spark, sf_dir):
    """Rolling means and trend inside each split (train / last-two-period holdout), the
    previous value on the whole panel."""
    from ..operators.splits import flag_last_n
    o = flag_last_n(dt.outcome(spark, sf_dir), "season_end_year", 2).withColumn("win_pct", win_pct())
    t = windows.trend_features(o, "team", "season_end_year", "win_pct", split_col="is_holdout")
    return _rounded(t.select("team", "season_end_year", "wins", "losses", *TREND_COLS, "is_holdout"), TREND_COLS)


# --- period labels, unions, curves ----------------------------------------------------

@register("season_label", with_ctes(OUTCOME) + """SELECT team, season,
  CAST(split_part(season, '-', 1) AS INTEGER) AS start_year,
  CAST(split_part(season, '-', -1) AS INTEGER) AS end_year,
  CAST(split_part(season, '-', 1) AS INTEGER) + 1 = season_end_year AS consistent
  FROM outcome""")
def q_season_label(spark, sf_dir):
    """Season label from the end year and back (start and end years)."""
    o = dt.outcome(spark, sf_dir)
    return o.select("team", season_label("season_end_year").alias("season"),
                    season_start("season").alias("start_year"), season_end("season").alias("end_year"),
                    (season_start("season") + 1 == F.col("season_end_year")).alias("consistent"))


@register("union_periods", with_ctes(OUTCOME) + """SELECT team, season_end_year, wins, losses, NULL::DOUBLE AS win_pct
  FROM outcome WHERE season_end_year <= 1998
  UNION ALL
  SELECT team, season_end_year, wins, losses, """ + r6("CAST(wins AS DOUBLE) / NULLIF(wins + losses, 0)", "win_pct")
          + " FROM outcome WHERE season_end_year > 1998")
def q_union_periods(spark, sf_dir):
    """Season frames with drifting columns concatenated by name: the later
    frames carry win_pct, the earlier ones do not (NULL after the union)."""
    o = dt.outcome(spark, sf_dir).select("team", "season_end_year", "wins", "losses")
    early = o.where(F.col("season_end_year") <= 1998)
    late = o.where(F.col("season_end_year") > 1998).withColumn("win_pct", out_round(win_pct()))
    return early.unionByName(late, allowMissingColumns=True)


@register("win_pct", with_ctes(OUTCOME) + "SELECT team, season_end_year, "
          + r6("CAST(wins AS DOUBLE) / NULLIF(wins + losses, 0)", "win_pct") + " FROM outcome")
def q_win_pct(spark, sf_dir):
    """Win share W / (W + L), NULL without games."""
    o = dt.outcome(spark, sf_dir)
    return o.select("team", "season_end_year", out_round(win_pct()).alias("win_pct"))


@register("trend_features_calendar", with_ctes(_GAPPY) + """, c1 AS (SELECT *,
  avg(measure) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_measure,
  avg(measure) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS measure_3y,
  avg(measure) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS measure_5y
  FROM g),
c2 AS (SELECT *, measure_3y - avg(measure_3y) OVER (PARTITION BY entity ORDER BY period
  RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS measure_trend FROM c1)
SELECT entity, period, """ + ", ".join(r6(c, c) for c in ("measure", "prev_measure", "measure_3y", "measure_5y",
                                                            "measure_trend")) + " FROM c2")
def q_trend_features_calendar(spark, sf_dir):
    """Trend features with calendar semantics on a panel with gaps: the
    3/5-period means cover calendar periods (RANGE frames), previous values
    exist only for period - 1."""
    g = dt.gappy_panel(spark, sf_dir)
    t = windows.trend_features(g, "entity", "period", "measure", gap="calendar")
    cols = ["measure", "prev_measure", "measure_3y", "measure_5y", "measure_trend"]
    return _rounded(t.select("entity", "period", *cols), cols)
