"""Descending min-rank (pandas ``rank(method="min", ascending=False)``) and
average rank (for Spearman), per group or pooled, for one or several value
columns at once.

Up to ``SLICE_ROWS`` rows (counted, not guessed) a group fits one task, and the ranks are window
functions.  Beyond that no task ever holds a group:

1. count rows per (group, value): duplicates collapse in partial sums, so a hot value
   is one row from here on;
2. range-partition those rows by (group, value descending) into slices of about
   ``SLICE_ROWS`` distinct values and write them with their slice number (Spark samples
   the cuts, a hot group spans many slices);
3. running counts inside each slice of a group, plus the counts of the group's earlier
   slices (at most one row per group and slice);
4. min-rank = 1 + rows of the group with a strictly larger value; join back on
   (group, value), null-safe in the group keys.

Values keep their type: bigints and decimals are compared exactly.  A NULL value gets a
NULL rank; NULL group keys form a group of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: rows that one task ranks: the size up to which whole groups are ranked by a window, and
#: the distinct values of a slice beyond it
SLICE_ROWS = 1 << 20


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def rank_many(df: DataFrame, specs, by=(), n_buckets: int | None = None, materialize_input: bool = True) -> DataFrame:
    """``specs``: list of (value column, min-rank output, average-rank output or None).
    The input is counted and ranked, so a computed one is written once first (set
    ``materialize_input`` to False for a staged one).  ``n_buckets`` asks for that many slices
    instead of a number from the size."""
    by = [by] if isinstance(by, str) else list(by)
    if materialize_input:
        df = materialize(df)
    if n_buckets is None and df.count() <= SLICE_ROWS:
        return _by_window(df, specs, by)
    base = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    by_type: dict[str, list[int]] = {}
    for i, (value, _, _) in enumerate(specs):
        by_type.setdefault(df.schema[value].dataType.simpleString(), []).append(i)
    out = base
    for columns in by_type.values():     # columns of one type share one pass
        ranked = _ranked_values(base, [(i, specs[i][0]) for i in columns], keys, n_buckets)
        for i in columns:
            value, name, avg_name = specs[i]
            r = ranked.where(F.col("_w") == i)
            sel = [*keys, F.col("_v").alias("_k"), F.col("_r").alias(name)]
            if avg_name:
                sel.append((F.col("_r") + (F.col("_ties") - 1) / F.lit(2.0)).alias(avg_name))
            out = _null_safe(out.withColumn("_k", F.col(value)), r.select(*sel), [*keys, "_k"], "left").drop("_k")
    return out.drop("_all") if not by else out


def _by_window(df: DataFrame, specs, by: list[str]) -> DataFrame:
    made = {}
    for value, name, avg_name in specs:
        v = F.col(value)
        rank = F.rank().over(Window.partitionBy(*by).orderBy(v.desc_nulls_last()))
        made[name] = F.when(v.isNotNull(), rank)
        if avg_name:
            ties = F.count(F.lit(1)).over(Window.partitionBy(*by, v))
            made[avg_name] = F.when(v.isNotNull(), rank + (ties - 1) / F.lit(2.0))
    return df.withColumns(made)


def _ranked_values(base: DataFrame, values: list[tuple[int, str]], keys: list[str], n: int | None) -> DataFrame:
    """(_w, group keys, _v, _r, _ties): the rank of each distinct value."""
    long = reduce(lambda a, b: a.unionByName(b), [
        base.where(F.col(v).isNotNull()).select(F.lit(i).alias("_w"), *keys, F.col(v).alias("_v")) for i, v in values])
    gk = ["_w", *keys]
    counts = long.groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_ties"))
    if n is None:
        counts = materialize(counts)
        n = -(-counts.count() // SLICE_ROWS) or 1
    cut = materialize(counts.repartitionByRange(n, *gk, F.col("_v").desc()).withColumn("_b", F.spark_partition_id()))
    earlier = Window.partitionBy(*gk).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*gk, "_b").agg(F.sum("_ties").alias("_n")) \
        .select(*gk, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    larger = Window.partitionBy(*gk, "_b").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_before", F.coalesce(F.sum("_ties").over(larger), F.lit(0)))
    ranked = _null_safe(inside, offsets, [*gk, "_b"], "inner").select(
        *gk, "_v", (F.lit(1) + F.col("_off") + F.col("_before")).cast("int").alias("_r"), "_ties")
    return materialize(ranked) if len(values) > 1 else ranked     # read once per ranked column


def rank_desc(df: DataFrame, value: str, by=(), out: str = "rank", avg_out: str | None = None,
              n_buckets: int | None = None, materialize_input: bool = True) -> DataFrame:
    return rank_many(df, [(value, out, avg_out)], by, n_buckets, materialize_input)


def quantiles(df: DataFrame, cols: list[str], qs: list[float], n_buckets: int | None = None) -> dict[str, list[float] | None]:
    """Exact interpolated quantiles of several columns (NULLs left out).  Up to
    ``SLICE_ROWS`` rows they are one aggregate; beyond, the ranks of the distinct values say
    which value stands at each wanted place, and at most two values per column and quantile
    come to the driver."""
    base = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).withColumn("_all", F.lit(0)))
    if n_buckets is None and base.count() <= SLICE_ROWS:
        row = base.agg(*[F.percentile(c, list(qs)).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    n = base.agg(*[F.count(c).alias(c) for c in cols]).first()
    ranked = _ranked_values(base, list(enumerate(cols)), ["_all"], n_buckets)
    first = F.col("_r") - 1              # rows with a larger value
    wanted: dict[int, set[int]] = {}
    for i, c in enumerate(cols):
        for q in qs if n[c] else ():
            at = (n[c] - 1) * q
            wanted.setdefault(i, set()).update({n[c] - 1 - int(at), n[c] - 1 - min(int(at) + 1, n[c] - 1)})
    here = F.lit(False)
    for i, places in wanted.items():
        for p in places:
            here = here | ((F.col("_w") == i) & (first <= p) & (F.lit(p) < first + F.col("_ties")))
    rows = ranked.where(here).select("_w", "_v", first.alias("first"), "_ties").collect()

    def value(i: int, place: int) -> float:
        return next(r["_v"] for r in rows if r["_w"] == i and r["first"] <= place < r["first"] + r["_ties"])

    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(cols):
        out[c] = [] if n[c] else None
        for q in qs if n[c] else ():
            at = (n[c] - 1) * q
            low, high = value(i, n[c] - 1 - int(at)), value(i, n[c] - 1 - min(int(at) + 1, n[c] - 1))
            out[c].append(low + (high - low) * (at - int(at)))
    return out


def rank_pooled(df: DataFrame, value: str, out: str = "rank", **kw) -> DataFrame:
    """Rank over the whole frame (no partition), still distributed."""
    return rank_desc(df, value, by=(), out=out, **kw)
