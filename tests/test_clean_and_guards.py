import pytest
from pyspark.sql import functions as F

from paneltide.functions.nulls import add_missing_columns, existing_columns, numeric_columns, require_columns
from paneltide.operators import clean, splits


def test_drop_repeated_headers_and_coerce(spark):
    rows = [("1", "A. Player", " 7 ", "PG"), ("Rk", "Player", "Age", "Pos"), ("2", None, "", "SF"), (None, "X", "30", None)]
    df = spark.createDataFrame(rows, "Rk string, Player string, Age string, Pos string")
    d = clean.drop_repeated_headers(df, "Rk")
    assert d.count() == 3                     # the NULL row is kept
    c = clean.coerce_numeric(d, keep_text=("Player", "Pos"), int_cols=("Rk",)).collect()
    assert [r.Rk for r in c] == [1, 2, None]
    assert [r.Age for r in c] == [7.0, None, 30.0]
    s = spark.createDataFrame([("Boston Celtics* ",)], "n string").select(clean.strip_marker("n").alias("x")).first()
    assert s.x == "Boston Celtics"


def test_column_guards(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "wins int, team string, pts double")
    require_columns(df, ["wins", "team"])
    with pytest.raises(ValueError):
        require_columns(df, ["wins", "losses"])
    assert existing_columns(df, ["pts", "ast", "wins"]) == ["pts", "wins"]
    assert numeric_columns(df, exclude={"wins"}) == ["pts"]
    out = add_missing_columns(df, ["ast", "pts"], 0.0)
    assert out.first().ast == 0.0 and out.first().pts == 2.0


def test_enough_periods_guard(spark):
    df = spark.createDataFrame([(y,) for y in (2001, 2002, 2003)], "y int")
    assert splits.enough_periods(df, "y", 3) == 3
    with pytest.raises(RuntimeError):
        splits.enough_periods(df, "y", 4)


def test_split_helpers(spark):
    df = spark.createDataFrame([(y, i) for y in (2001, 2002, 2003, 2004) for i in range(2)], "y int, i int")
    train, hold = splits.split_last_n(df, "y", 2)
    assert sorted({r.y for r in hold.collect()}) == [2003, 2004] and train.count() == 4
    rec = splits.recent_mask(train, "y", 1).where("is_recent")
    assert {r.y for r in rec.collect()} == {2002}
    flag = splits.flag_last_n(df, "y", 1)
    assert flag.where(F.col("is_holdout")).count() == 2


def test_audited_filter_counts_each_step(spark):
    df = spark.createDataFrame([("TOT", 300.0), ("A", 100.0), ("A", 250.0), (None, 400.0)], "team string, mp double")
    from paneltide.functions.nulls import ne_safe
    out, obs = clean.audited_filter(df, [("tot", ne_safe("team", "TOT")), ("minutes", F.col("mp") >= 200)])
    assert out.count() == 2
    m = obs.get
    assert m["rows_in"] == 4 and m["dropped_tot"] == 1 and m["dropped_minutes"] == 1
