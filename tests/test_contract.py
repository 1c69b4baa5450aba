from pyspark.sql import functions as F

from paneltide.functions.nulls import finite_or_null, ne_safe, not_in, safe_div, sum_or_zero, try_number
from paneltide.operators import panel


def test_not_in_keeps_null_team(spark):
    df = spark.createDataFrame([("A",), ("2TM",), ("TOT",), (None,)], "team string")
    kept = sorted((r.team or "") for r in df.where(not_in("team", ["2TM", "3TM"])).collect())
    assert kept == ["", "A", "TOT"]
    assert df.where(ne_safe("team", "TOT")).count() == 3


def test_all_null_group_sums_to_zero_mean_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k string, v double")
    r = {x.k: (x.s, x.m) for x in df.groupBy("k").agg(sum_or_zero("v").alias("s"), F.avg("v").alias("m")).collect()}
    assert r["a"] == (0.0, None)
    assert r["b"] == (1.0, 1.0)


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0, 0), (1.0, 2.0, 3, 1)], "fg double, fga double, w int, l int")
    from paneltide.functions.formulas import win_pct
    r = df.select(safe_div("fg", "fga").alias("q"), safe_div("fg", "fga", 0).alias("q0"),
                  win_pct("w", "l").alias("wp")).collect()
    assert r[0].q is None and r[0].q0 == 0.0 and r[0].wp is None
    assert r[1].q == 0.5 and r[1].wp == 0.75


def test_numeric_text_coercion(spark):
    vals = ["Rk", "", " 7 ", "1e3", "NaN", "inf", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(try_number("s").alias("x")).collect()]
    assert got == [None, None, 7.0, 1000.0, None, None, None]
    ints = [r.x for r in df.select(try_number("s", "int").alias("x")).collect()]
    assert ints[2] == 7 and ints[0] is None


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,)], "v double")
    assert [r.x for r in df.select(finite_or_null("v").alias("x")).collect()] == [None, None, None, 2.0]


def test_rollup_conserves_sums(spark):
    rows = [("2000-2001", 2001, "A", 1.0), ("2000-2001", 2001, "A", 2.0), ("2000-2001", 2001, "2TM", 5.0),
            ("2000-2001", 2001, None, 7.0), ("2001-2002", 2002, "B", 4.0)]
    df = spark.createDataFrame(rows, "season string, season_end_year int, team string, pts double")
    base = panel.drop_combined(df)
    out = panel.rollup_sum(base, measures=("pts",))
    # null team dropped by the group-by, combined row dropped by the policy
    assert sorted((r.team, r.pts) for r in out.collect()) == [("A", 3.0), ("B", 4.0)]
    assert panel.drop_combined(df, "only").count() == 1
    assert panel.drop_combined(df, "keep").count() == 5


def test_dedup_first_explicit_order(spark):
    df = spark.createDataFrame([("X", 2, 1, 10), ("X", 1, 5, 20), ("X", 1, 3, 30), ("Y", 0, 0, 40)],
                               "code string, table_no int, row_no int, wins int")
    out = {r.code: r.wins for r in panel.dedup_first(df, "code", ["table_no", "row_no"]).collect()}
    assert out == {"X": 30, "Y": 40}


def test_scale_conf_sizes_partitions():
    from paneltide.session import scale_conf
    c = scale_conf(100 * (1 << 40), executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20)   # 409600
    small = scale_conf(1 << 30, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80                             # two waves of 40 slots


def test_out_round_matches_duckdb_round(spark):
    import duckdb
    from paneltide.functions.nulls import out_round
    vals = [0.0078125, -0.0078125, 2.5e-7, -2.5e-7, 1.0000005, 0.1 + 0.2, -0.0, 123456789.1234565,
            4.5e9 + 0.123, 9.9e15, -3.3e17, 1e-12, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.r for r in df.select(out_round("v").alias("r")).collect()]
    con = duckdb.connect()
    exp = [con.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0.0", [v]).fetchone()[0] if v is not None else None
           for v in vals]
    assert got == exp


def test_lookup_of_a_key_with_several_values_takes_the_smallest(spark):
    from paneltide.operators.joins import dim_lookup
    facts = spark.createDataFrame([("x",), ("y",), (None,)], "name string")
    for order in (["B", "A"], ["A", "B"]):
        dim = spark.createDataFrame([("x", c) for c in order], "name string, code string")
        assert {r.name: r.code for r in dim_lookup(facts, dim, "name", "name", "code").collect()} == {"x": "A", "y": None, None: None}


def test_out_round_matches_duckdb_on_random_values(spark):
    import duckdb
    import numpy as np

    from paneltide.functions.nulls import out_round
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=1000), rng.normal(size=1000) * 1e6, rng.normal(size=500) * 1e11,
                           np.round(rng.normal(size=500), 7), rng.integers(0, 1000, 500) / 128.0])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double")
    got = {r.i: r.r for r in df.select("i", out_round("v").alias("r")).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    exp = dict(con.execute("SELECT i, round(v, 6) + 0.0 FROM t").fetchall())
    assert got == exp


def test_materialize_modes_cut_lineage(spark):
    import contextlib
    import io

    from pyspark.sql import functions as F

    from paneltide.session import ensure_checkpoint_dir, materialize

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()

    src = spark.range(50).withColumn("g", F.col("id") % 3).groupBy("g").agg(F.sum("id").alias("s"))
    t = materialize(src)
    c = materialize(src, how="checkpoint")
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, c.collect())) == sorted(map(tuple, src.collect()))
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    assert "Scan parquet" in plan(t) and root in plan(t) and "Range" not in plan(t)
    assert "ExistingRDD" in plan(c) and "Range" not in plan(c)
