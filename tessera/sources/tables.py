"""Parquet scans of the driver tables.

Scans are plain ``spark.read.parquet`` so Catalyst prunes columns and pushes
filters into the reader; nothing here triggers a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register each table as a temp view (for ``spark.sql`` users)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
