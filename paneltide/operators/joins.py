"""Join helpers: dimension lookups, unknown-key reports and prefixed joins.  No join is
forced to broadcast: the planner and AQE know the sizes in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_lookup(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, value: str) -> DataFrame:
    """Left lookup of ``value`` by key; unmatched keys give NULL.  A key listed with several
    values takes the smallest one, whatever the row order."""
    d = dim.groupBy(dim_key).agg(F.min(value).alias(value))
    if fact_key == dim_key:
        return facts.join(d, fact_key, "left")
    return facts.join(d, facts[fact_key] == d[dim_key], "left").drop(d[dim_key])


def unknown_keys(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Distinct, sorted fact keys missing from the dictionary (anti join)."""
    keys = facts.select(F.col(fact_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    d = dim.select(F.col(dim_key).alias("_k")).distinct()
    return keys.join(d, "_k", "left_anti").select(F.col("_k").alias(fact_key)).orderBy(fact_key)


def join_prefixed(left: DataFrame, right: DataFrame, keys: list[str], prefix: str,
                  keep=(), how: str = "inner") -> DataFrame:
    """Join with every right-side non-key column renamed ``prefix + name``
    except those listed in ``keep``."""
    ren = {c: f"{prefix}{c}" for c in right.columns if c not in keys and c not in keep}
    return left.join(right.withColumnsRenamed(ren), keys, how)
