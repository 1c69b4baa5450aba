"""Mergeable distinct counts: one sketch per period, stored once and merged for any span.

A period that arrives adds its own sketch; counts over several periods come from the union of
theirs, so nothing that was counted before is read again.  With ``lg_k`` = 12 the relative
standard error is 1.04 / sqrt(2**12) = 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12


def period_sketches(df: DataFrame, period: str, key: str, lg_k: int = LG_K) -> DataFrame:
    """(period, sketch) of the distinct values of ``key``; a period without a value is absent."""
    return df.where(F.col(key).isNotNull()).groupBy(period).agg(F.hll_sketch_agg(key, F.lit(lg_k)).alias("sketch"))


def merge_sketches(*parts: DataFrame, period: str) -> DataFrame:
    """Sketches of several arrivals as one per period."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(period).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_so_far(sketches: DataFrame, period: str) -> DataFrame:
    """(period, n_period, n_so_far): estimates for each period and for all up to it.  Each sketch
    goes to the periods from its own on; periods are few, so are the sketches' copies."""
    periods = sorted(r[0] for r in sketches.select(period).where(F.col(period).isNotNull()).distinct().collect())
    later = F.filter(F.array(*map(F.lit, periods)), lambda p: p >= F.col(period)) if periods else F.array(F.col(period))
    spread = sketches.where(F.col(period).isNotNull()).withColumn("_to", F.explode(later))
    own = F.max(F.when(F.col("_to") == F.col(period), F.hll_sketch_estimate("sketch")))
    return spread.groupBy(F.col("_to").alias(period)).agg(
        own.alias("n_period"), F.greatest(own, F.hll_sketch_estimate(F.hll_union_agg("sketch"))).alias("n_so_far"))
