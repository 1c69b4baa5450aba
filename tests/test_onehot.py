"""The distributed one-hot dictionary: exact slots, unseen values and nulls set none."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paneltide.ml import onehot
from paneltide.operators import rank


@pytest.mark.parametrize("slice_rows", [1 << 20, 3])
def test_slots_are_dense_ranks(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(rank, "SLICE_ROWS", slice_rows)
    names = ["b", "a", "é", "Z", "", "a", "b", "c10", "c9", None, "d"]
    train = spark.createDataFrame([(n,) for n in names], "team string")
    slots, width = onehot.dictionary(train, "team")
    ordered = sorted({n for n in names if n is not None}, key=lambda s: s.encode())
    assert width == len(ordered)
    assert {r.value: r.slot for r in slots.collect()} == {n: i for i, n in enumerate(ordered)}


def test_vectors_of_seen_unseen_and_null_values(spark):
    train = spark.createDataFrame([(n,) for n in ("x", "y", "z", "y")], "team string")
    test = spark.createDataFrame([("y",), ("new",), (None,), ("z",)], "team string")
    slots, width = onehot.dictionary(train, "team")
    made = [onehot.index(onehot.encode(f, "team", slots, "s"), "s", width) for f in (train, test)]
    model = Pipeline(stages=[onehot.vector_stage("s", "v")]).fit(made[0])
    got = {r.team: r.v for r in model.transform(made[1]).select("team", vector_to_array(F.col("v")).alias("v")).collect()}
    assert got == {"y": [0.0, 1.0, 0.0], "new": [0.0] * 3, None: [0.0] * 3, "z": [0.0, 0.0, 1.0]}


def test_empty_training_rows(spark):
    empty = spark.createDataFrame([], "team string")
    slots, width = onehot.dictionary(empty, "team")
    assert width == 0 and slots.count() == 0
    assert onehot.encode(spark.createDataFrame([("x",)], "team string"), "team", slots, "s").collect()[0].s is None
