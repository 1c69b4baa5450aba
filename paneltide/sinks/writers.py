"""Sinks: period-partitioned tables with dynamic partition overwrite (a
re-run replaces only the periods it writes), sorted prediction tables and
JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, partition_cols, fmt: str = "parquet",
                      mode: str = "overwrite", **options) -> None:
    """One directory per period value; with ``mode="overwrite"`` only the
    partitions present in ``df`` are replaced (dynamic overwrite), so the
    write is idempotent per period."""
    cols = [partition_cols] if isinstance(partition_cols, str) else list(partition_cols)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*cols).format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


def write_sorted_by_period(df: DataFrame, path: str, period: str, sort_cols, fmt: str = "csv") -> None:
    """One output directory per period, files ordered by (period, sort cols):
    range partitioning keeps a large period split over several tasks."""
    sort_cols = [sort_cols] if isinstance(sort_cols, str) else list(sort_cols)
    df.repartitionByRange(period, *sort_cols).sortWithinPartitions(period, *sort_cols).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(period).format(fmt).save(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def run_stamp() -> F.Column:
    """Run identifier ``YYYYmmdd_HHMMSS`` (evaluated once per query)."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
