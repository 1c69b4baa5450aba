"""Atomic publishing, and the incremental panel against the batch computation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paneltide.functions.formulas import win_pct
from paneltide.operators import windows
from paneltide.sinks.versioned import VersionedTables
from paneltide.sources.driver_tables import outcome_of
from paneltide.streaming import refresh as R

SCHEMA = "l_suppkey long, l_returnflag string, l_shipdate timestamp_ntz"
KEEP = ["team", "season_end_year", "wins", "losses", "win_pct", "prev_win_pct", "win_pct_3y", "win_pct_5y", "win_pct_trend"]


def key(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


def batch_result(df):
    made = windows.trend_features(outcome_of(df).withColumn("win_pct", win_pct()), "team", "season_end_year", "win_pct")
    return sorted((key(r) for r in made.select(*KEEP).collect()), key=str)


def drops(seed=1):
    """Three drops; the second brings early seasons late, the third adds to known ones."""
    rng = random.Random(seed)
    row = lambda y: (rng.choice([1, 2, 3, 13]), rng.choice("NRA"), dt.datetime(y, rng.randrange(1, 13), 1))
    return [[row(y) for y in (1998, 1999, 2000, 2001) for _ in range(12)], [row(y) for y in (1995, 1996, 1997) for _ in range(9)],
            [row(y) for y in (1996, 2001, 2002) for _ in range(5)]]


def test_panel_and_trends_follow_late_seasons(spark, tmpdir_path):
    src, path, ckpt = f"{tmpdir_path}/src", f"{tmpdir_path}/tables", f"{tmpdir_path}/ckpt"
    schema, so_far = spark.createDataFrame([], SCHEMA).schema, []
    for drop in drops():
        so_far += drop
        spark.createDataFrame(drop, SCHEMA).repartition(2).write.mode("append").parquet(src)
        tables = R.refresh_panel(spark, src, schema, path, ckpt, max_files=1)
        got = sorted((key(r) for r in tables.read("trend").select(*KEEP).collect()), key=str)
        assert got == batch_result(spark.createDataFrame(so_far, SCHEMA))
        panel = {(r.team, r.season_end_year): (r.wins, r.losses) for r in tables.read("panel").collect()}
        assert panel == {(r.team, r.season_end_year): (r.wins, r.losses) for r in outcome_of(spark.createDataFrame(so_far, SCHEMA)).collect()}
    version = tables.current().number
    R.refresh_panel(spark, src, schema, path, ckpt)                 # nothing new
    assert tables.current().number == version
    tables.vacuum()
    assert sorted((key(r) for r in tables.read("trend").select(*KEEP).collect()), key=str) == got


def test_a_replayed_batch_changes_nothing(spark, tmpdir_path):
    path = f"{tmpdir_path}/tables"
    first, second, _ = drops(2)
    run = R.refresh_batch(path)
    run(spark.createDataFrame(first, SCHEMA), 0)
    run(spark.createDataFrame(second, SCHEMA), 1)
    run(spark.createDataFrame(second, SCHEMA), 1)
    run(spark.createDataFrame(first, SCHEMA), 0)
    run(spark.createDataFrame([], SCHEMA), 2)
    got = sorted((key(r) for r in VersionedTables(spark, path).read("trend").select(*KEEP).collect()), key=str)
    assert got == batch_result(spark.createDataFrame(first + second, SCHEMA))


def test_a_write_that_fails_between_periods_leaves_the_old_table(spark, tmpdir_path):
    tables = VersionedTables(spark, f"{tmpdir_path}/tables")
    assert tables.read("t") is None
    tables.publish({"t": spark.createDataFrame([(1, 2000), (2, 2001)], "v int, year int")}, "year", {"s": 4})
    spoilt = spark.createDataFrame([(10, 2000), (20, 2001)], "v int, year int").repartition(2).withColumn(
        "v", F.when(F.col("year") == 2001, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        tables.publish({"t": spoilt}, "year", {"s": 5})
    assert sorted(tuple(r) for r in tables.read("t").select("v", "year").collect()) == [(1, 2000), (2, 2001)]
    assert tables.current().marks == {"s": 4}
    tables.publish({"t": spark.createDataFrame([(20, 2001), (30, 2002)], "v int, year int")}, "year")
    assert sorted(tuple(r) for r in tables.read("t").select("v", "year").collect()) == [(1, 2000), (20, 2001), (30, 2002)]


def test_two_writers_do_not_overwrite_each_other(spark, tmpdir_path):
    tables = VersionedTables(spark, f"{tmpdir_path}/tables")
    df = spark.createDataFrame([(1, 2000)], "v int, year int")
    tables.publish({"t": df}, "year")
    stale = VersionedTables(spark, f"{tmpdir_path}/tables")
    old = stale.current()
    tables.publish({"t": df}, "year")
    stale.current = lambda: old
    with pytest.raises(RuntimeError, match="another writer"):
        stale.publish({"t": df}, "year")
