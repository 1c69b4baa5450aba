from pyspark.sql import functions as F

from paneltide.operators import windows


def _panel(spark, rows):
    return spark.createDataFrame(rows, "team string, season_end_year int, win_pct double")


def test_inclusive_and_lagged_frames(spark):
    df = _panel(spark, [("A", 2000, 0.2), ("A", 2001, 0.4), ("A", 2002, 0.9), ("B", 2000, 0.5)])
    inc = {(r.team, r.season_end_year): r for r in windows.trend_features(df, frame="inclusive").collect()}
    lag = {(r.team, r.season_end_year): r for r in windows.trend_features(df, frame="lagged").collect()}
    assert inc[("A", 2002)].win_pct_3y == (0.2 + 0.4 + 0.9) / 3
    assert lag[("A", 2002)].win_pct_3y == (0.2 + 0.4) / 2
    assert inc[("A", 2000)].prev_win_pct is None and inc[("A", 2000)].win_pct_trend is None
    # one-row entity: lag and trend are null, the inclusive mean is the value itself
    assert inc[("B", 2000)].win_pct_3y == 0.5 and inc[("B", 2000)].win_pct_trend is None
    assert lag[("B", 2000)].win_pct_3y is None
    assert abs(inc[("A", 2001)].win_pct_trend - ((0.2 + 0.4) / 2 - 0.2)) < 1e-12


def test_lagged_features_do_not_leak_the_target(spark):
    base = [("A", 2000, 0.2), ("A", 2001, 0.4), ("A", 2002, 0.9)]
    changed = [("A", 2000, 0.2), ("A", 2001, 0.4), ("A", 2002, 0.1)]
    cols = ["prev_win_pct", "win_pct_3y", "win_pct_5y", "win_pct_trend"]
    a = windows.trend_features(_panel(spark, base), frame="lagged").where("season_end_year = 2002").first()
    b = windows.trend_features(_panel(spark, changed), frame="lagged").where("season_end_year = 2002").first()
    assert all(a[c] == b[c] for c in cols)
    ai = windows.trend_features(_panel(spark, base), frame="inclusive").where("season_end_year = 2002").first()
    bi = windows.trend_features(_panel(spark, changed), frame="inclusive").where("season_end_year = 2002").first()
    assert ai.win_pct_3y != bi.win_pct_3y


def test_row_gap_vs_calendar_gap(spark):
    df = _panel(spark, [("C", 2001, 0.3), ("C", 2014, 0.6), ("C", 2015, 0.7)])
    r = {x.season_end_year: x for x in windows.lag_calendar(df, "team", "season_end_year", "win_pct").collect()}
    assert r[2014].prev_win_pct_row == 0.3 and r[2014].prev_win_pct_cal is None
    assert r[2015].prev_win_pct_row == 0.6 and r[2015].prev_win_pct_cal == 0.6
    cal = {x.season_end_year: x for x in windows.trend_features(df, gap="calendar").collect()}
    assert cal[2014].win_pct_3y == 0.6          # 2012..2014 holds only 2014


def test_split_windows(spark):
    df = _panel(spark, [("A", 2000, 0.2), ("A", 2001, 0.4), ("A", 2002, 0.9)]) \
        .withColumn("is_holdout", F.col("season_end_year") == 2002)
    r = {x.season_end_year: x for x in windows.trend_features(df, split_col="is_holdout").collect()}
    # the previous value is taken before the split, rolling means inside it
    assert r[2002].prev_win_pct == 0.4 and r[2002].win_pct_3y == 0.9 and r[2002].win_pct_trend is None
