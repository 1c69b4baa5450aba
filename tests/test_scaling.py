import numpy as np

from paneltide.operators import scaling


def test_scalers_fit_on_train_only(spark):
    rows = [(1.0, 5.0, None, False), (2.0, 5.0, 1.0, False), (4.0, 5.0, 3.0, False), (100.0, 7.0, 9.0, True)]
    df = spark.createDataFrame(rows, "x double, c double, n double, hold boolean")
    train = df.where("not hold")
    means = scaling.fit_means(train, ["x", "n"])
    assert means["n"] == 2.0
    filled = scaling.apply_fill(df, means)
    assert filled.where("x = 1.0").first().n == 2.0
    xs = np.array([1.0, 2.0, 4.0])
    std = scaling.fit_scaler(train, ["x", "c"], "standard")
    assert abs(std["x"][1] - xs.std()) < 1e-12       # population std
    assert std["c"] == (5.0, 1.0)                      # constant column: divide by 1
    mm = scaling.apply_scaler(df, scaling.fit_scaler(train, ["x", "c"], "minmax")).collect()
    assert [r.c for r in mm][:3] == [0.0, 0.0, 0.0]    # constant -> 0, not 0.5
    rb = scaling.fit_scaler(train, ["x"], "robust")
    q = np.percentile(xs, [25, 50, 75])
    assert rb["x"] == (q[1], q[2] - q[0])              # interpolated quartiles
    # the holdout row does not move any parameter
    std2 = scaling.fit_scaler(train.union(train.limit(0)), ["x"], "standard")
    assert std2["x"] == std["x"]
