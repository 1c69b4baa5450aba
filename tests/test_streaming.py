import datetime as dt
import os

from pyspark.sql import functions as F

from paneltide.streaming.ingest import ingest_outcomes

SCHEMA = "l_suppkey long, l_returnflag string, l_shipdate timestamp_ntz"


def _write(spark, path, rows):
    # new files land directly in the watched folder
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_incremental_ingest_matches_batch_and_replays(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    d = dt.datetime
    b1 = [(1, "N", d(1999, 3, 1)), (1, "R", d(1999, 4, 1)), (2, "A", d(2000, 1, 1))]
    b2 = [(1, "R", d(1999, 5, 1)), (2, "N", d(2001, 1, 1))]
    _write(spark, src, b1)
    target = os.path.join(tmpdir_path, "table")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    ingest_outcomes(spark, src, schema, target=target, checkpoint=ckpt)
    _write(spark, src, b2)
    # a second run with the same checkpoint picks up only the new file
    ingest_outcomes(spark, src, schema, target=target, checkpoint=ckpt)
    # a third run has nothing new: the table must not change
    ingest_outcomes(spark, src, schema, target=target, checkpoint=ckpt)
    assert spark.read.parquet(target).columns[:2] == ["team", "season"]
    got = {(r.team, r.season_end_year): (r.wins, r.losses) for r in spark.read.parquet(target).collect()}
    assert got == {("S1", 1999): (1, 2), ("S2", 2000): (1, 0), ("S2", 2001): (1, 0)}


def test_a_target_that_cannot_be_read_fails_the_batch(spark, tmpdir_path):
    import pytest
    src = os.path.join(tmpdir_path, "src")
    _write(spark, src, [(1, "N", dt.datetime(1999, 3, 1))])
    target = os.path.join(tmpdir_path, "table")
    os.makedirs(target)
    with open(os.path.join(target, "part-0.parquet"), "w") as f:
        f.write("not a table")
    schema = spark.createDataFrame([], SCHEMA).schema
    with pytest.raises(Exception):
        ingest_outcomes(spark, src, schema, target=target, checkpoint=os.path.join(tmpdir_path, "ckpt"))
    assert os.path.exists(os.path.join(target, "part-0.parquet"))


def test_renamed_codes_as_in_the_batch_table(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    _write(spark, src, [(3, "N", dt.datetime(1997, 3, 1)), (3, "N", dt.datetime(1998, 3, 1))])
    target = os.path.join(tmpdir_path, "table")
    ingest_outcomes(spark, src, spark.createDataFrame([], SCHEMA).schema, target=target, checkpoint=os.path.join(tmpdir_path, "ckpt"))
    assert {r.team for r in spark.read.parquet(target).collect()} == {"X3", "S3"}
