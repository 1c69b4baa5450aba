import random

import pandas as pd
import pytest

from paneltide.operators.rank import quantiles, rank_desc


def _expected(pdf, by):
    g = pdf.groupby(by)["v"] if by else pdf["v"]
    mn = g.rank(method="min", ascending=False)
    avg = g.rank(method="average", ascending=False)
    return mn, avg


def test_min_and_average_rank_with_ties_and_nulls(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, 3]), i, rnd.choice([None, 0.1, 0.2, 0.2, 0.3, 0.5, 0.5, 0.9]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id int, v double")
    out = rank_desc(df, "v", by="g", out="r", avg_out="ra", n_buckets=4).toPandas()
    out = out.sort_values("id").reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["g", "id", "v"]).sort_values("id").reset_index(drop=True)
    mn, avg = _expected(pdf, "g")
    assert (out["r"].isna() == pdf["v"].isna()).all()
    m = pdf["v"].notna()
    assert (out.loc[m, "r"].astype(int).values == mn[m].astype(int).values).all()
    assert ((out.loc[m, "ra"].values - avg[m].values) ** 2).max() < 1e-18


@pytest.mark.parametrize("kind", ["bigint", "decimal(30,2)", "double"])
def test_rank_equals_sql_rank_with_null_keys_large_values_and_a_hot_value(spark, kind):
    rnd = random.Random(3)
    big = 2 ** 53
    values = [big, big + 1, big + 2, 5, 5, None] if kind != "double" else [0.1, 0.2, 5.0, 5.0, None]
    rows = [(rnd.choice(["a", "b", None]), i, None if (v := rnd.choice(values)) is None else str(v)) for i in range(200)]
    rows += [("a", 1000 + i, "5") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, s string").selectExpr("g", "id", f"cast(s as {kind}) v")
    df.createOrReplaceTempView("rank_input")
    exp = {r.id: r.r for r in spark.sql(
        "select id, case when v is not null then rank() over (partition by g order by v desc nulls last) end r from rank_input").collect()}
    got = {r.id: r.r for r in rank_desc(df, "v", by="g", out="r", n_buckets=5).collect()}
    assert got == exp


def test_pooled_rank_equals_sql_rank(spark):
    rows = [(i, float(i % 17)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = {r.id: r.r for r in rank_desc(df, "v", out="r", n_buckets=5).collect()}
    assert got == {i: 1 + sum(w > v for _, w in rows) for i, v in rows}


def test_all_predictions_equal(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(10)], "id int, v double")
    assert {r.r for r in rank_desc(df, "v", out="r").collect()} == {1}


def test_exact_quantiles(spark):
    import numpy as np
    rnd = random.Random(5)
    a = [rnd.choice([None, 1.0, 2.0, 2.0, rnd.random()]) for _ in range(101)]
    df = spark.createDataFrame([(x, 3.0, None) for x in a], "a double, b double, c double")
    q = quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75])
    assert np.allclose(q["a"], np.quantile([x for x in a if x is not None], [0.25, 0.5, 0.75]))
    assert q["b"] == [3.0, 3.0, 3.0] and q["c"] is None


def test_ranks_and_quantiles_are_the_same_by_window_and_by_slices(spark, monkeypatch):
    from paneltide.operators import rank as R
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 1.5, rnd.random(), rnd.random()]), rnd.randrange(40)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id int, v double, w int")
    specs = [("v", "r", "ra"), ("w", "s", None)]
    key = lambda d: sorted(tuple(r) for r in d.select("id", "r", "ra", "s").collect())
    small = {by: key(R.rank_many(df, specs, by=by)) for by in ("g", ())}
    few = R.quantiles(df, ["v", "w"], [0.1, 0.5, 0.9])
    written = []
    real = R.materialize
    monkeypatch.setattr(R, "SLICE_ROWS", 25)
    monkeypatch.setattr(R, "materialize", lambda d: written.append(1) or real(d))
    assert {by: key(R.rank_many(df, specs, by=by)) for by in ("g", ())} == small
    assert len(written) > 4                                 # slices were written
    many = R.quantiles(df, ["v", "w"], [0.1, 0.5, 0.9])
    assert many["v"] == pytest.approx(few["v"]) and many["w"] == pytest.approx(few["w"])
