"""Parquet table access.  Reads are lazy; selecting columns here lets
Catalyst prune the Parquet ``ReadSchema`` and push filters to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, cols=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def register_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Temp views with the driver's table names (for ``spark.sql`` users)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
