"""Exact one-hot encoding of a category with any number of values.

The dictionary is a table: distinct training values in ascending order, their slot the number
of smaller values (the distributed rank, so no list of values reaches the driver or a model).
Rows meet their slot by a join; a value that training did not have, or a NULL, sets none.
Spark's encoder then needs one number, the width, to make sparse vectors.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import rank_many
from ..session import materialize


def dictionary(train: DataFrame, col: str) -> tuple[DataFrame, int]:
    """(value, slot from 0 in ascending order; the number of slots)."""
    values = materialize(train.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct())
    width = values.count()
    ranked = rank_many(values, [("value", "_rank", None)], materialize_input=False)      # descending
    return materialize(ranked.select("value", (F.lit(width) - F.col("_rank")).cast("long").alias("slot"))), width


def encode(df: DataFrame, col: str, slots: DataFrame, out: str) -> DataFrame:
    """``df`` with the slot of each row's value (NULL for none)."""
    slots = slots.select(F.col("value").alias("_value"), F.col("slot").alias(out))
    return df.join(slots, F.col(col) == F.col("_value"), "left").drop("_value")


def vector_stage(slot: str, out: str) -> OneHotEncoder:
    """The stage that turns indices (see :func:`index`) into sparse vectors, as wide as the
    indices of the frame it is fitted on; the place behind the last slot is dropped, so rows
    without a slot are all zeros."""
    return OneHotEncoder(inputCols=[slot], outputCols=[out], handleInvalid="keep", dropLast=True)


def index(df: DataFrame, slot: str, width: int) -> DataFrame:
    """Slots as the indices that the encoder reads: no slot is the place behind the last."""
    return df.withColumn(slot, F.coalesce(F.col(slot), F.lit(width)).cast("double"))
