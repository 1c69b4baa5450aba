"""Boosted trees on one-hot groups against Spark's ``GBTClassifier`` on the vectors of the same columns."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from paneltide.ml import boosting, models, onehot, onehot_boosting
from paneltide.session import materialize


def frames(spark, n, teams, seed=1):
    """(training rows, rows to score), with slots; some teams and positions are only in the latter."""
    rng = np.random.default_rng(seed)
    a, b, c = np.round(rng.normal(size=n), 2), rng.integers(0, 4, n).astype(float), rng.normal(size=n)
    team, pos = rng.integers(0, teams, n), rng.integers(0, 3, n)
    y = (a + (team % 5 == 2) * 1.5 + (pos == 1) * (c > 0) + rng.normal(size=n) * 0.3 > 0.8).astype(float)
    rows = [(float(p), float(q), float(r), 7.0, f"T{t:05d}", "XYZ"[k], float(v)) for p, q, r, t, k, v in zip(a, b, c, team, pos, y)]
    kind = "a double, b double, c double, same double, team string, pos string, label double"
    train = materialize(spark.createDataFrame(rows, kind).coalesce(2))
    test = spark.createDataFrame([*rows[:200], (0.1, 9.0, None, 7.0, "new", "W", 0.0), (2.0, -1.0, 0.0, 7.0, "T00002", "Y", 1.0)], kind)
    slots, width = onehot.dictionary(train, "team")
    train, test = (onehot.index(onehot.encode(f, "team", slots, "slot"), "slot", width) for f in (train, test))
    return materialize(train), materialize(test)


def fitted(train, rounds=8, **more):
    return models.classifier_pipeline(train, ["a", "b", "c", "same"], ["pos"], "gbt", {"n_estimators": rounds, "learning_rate": 0.2, "max_depth": 3, **more},
                                      slot_cols=["slot"]).fit(train)


def scores(model, df):
    out = model.transform(df).orderBy("a", "c", "team", "pos").select(vector_to_array("rawPrediction").alias("m"), vector_to_array("probability").alias("p"), "prediction")
    return [np.array(v) for v in zip(*[(r.m, r.p, [r.prediction]) for r in out.collect()])]


@pytest.mark.parametrize("n,rounds", [(500, 8), (12000, 3)])       # beyond 10000 rows Spark draws those for thresholds
def test_equals_spark_on_vectors(spark, n, rounds):
    train, test = frames(spark, n, 40)
    for got, exp in zip(scores(fitted(train, rounds), test), scores(fitted(train, rounds, subsample=1.0), test)):
        assert np.allclose(got, exp, atol=1e-9)


def test_passes_over_many_tasks_equal_one_task(spark, monkeypatch):
    train, test = frames(spark, 900, 60)
    one = scores(fitted(train), test)[0]
    for module, name, value in ((onehot_boosting, "TASK_CELLS", 0), (boosting, "STAGE_TREES", 3), (boosting, "BLOCK_ROWS", 128)):
        monkeypatch.setattr(module, name, value)
    assert np.allclose(scores(fitted(train), test)[0], one)
    monkeypatch.setattr(boosting, "GATHER_BYTES", 0)                # tasks add the sums first
    monkeypatch.setattr(onehot_boosting, "PIECE", 100)
    assert np.allclose(scores(fitted(train, 4), test)[0], scores(fitted(train, 4, subsample=1.0), test)[0])


def test_a_row_costs_no_value_for_each_category(spark, monkeypatch):
    monkeypatch.setattr(models, "GBTClassifier", None)             # its rows are as wide as all categories
    train, test = frames(spark, 4000, 3000)
    model = fitted(train).stages[-1].booster
    assert model.shape.widths[1] > 2000
    rows = onehot_boosting.Block.of(np.zeros((10, 4)), np.zeros((10, 2)), np.ones(10), model.edges)
    assert sum(v.nbytes for v in (rows.pairs, rows.places, rows.y, rows.score)) <= 10 * (4 + 8 + 1 + 8)
    assert len(scores(fitted(train), test)[0]) == 202


def test_numbers_alone(spark):
    train, test = frames(spark, 300, 10)
    fit = lambda **more: models.classifier_pipeline(train, ["a", "c"], kind="gbt", params={"n_estimators": 4, **more}).fit(train)
    assert np.allclose(scores(fit(), test)[0], scores(fit(subsample=1.0), test)[0])


def test_nan_goes_right_and_no_rows_raise(spark):
    train, test = frames(spark, 300, 10)
    m = fitted(train)
    nan = test.limit(1).withColumn("a", onehot_boosting.F.lit(float("nan")))
    top = test.limit(1).withColumn("a", onehot_boosting.F.lit(1e9))
    assert np.array_equal(scores(m, nan)[0], scores(m, top)[0])
    with pytest.raises(ValueError):
        onehot_boosting.fit(train.limit(0), ["a"], ["slot"], "label", onehot_boosting.Rules())
    with pytest.raises(ValueError):
        onehot_boosting.fit(train.withColumn("label", onehot_boosting.F.lit(None).cast("double")), ["a"], ["slot"], "label", onehot_boosting.Rules())
