"""File sources and sinks.

Scratch tables go to the shared folder named by ``spark.checkpoint.dir`` (a
local private folder only when a local session has none), never to a
machine-local temporary folder on a cluster.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("no shared folder: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/riskfold-tables/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, name: str, path: str | None = None) -> str:
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def scan_csv(spark: SparkSession, path: str, schema: str, label_col: str | None = None) -> DataFrame:
    """CSV with a declared schema (no inference pass over the data)."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if label_col and label_col in df.columns:
        from ..functions.rules import label_map_on_read
        df = df.withColumn(label_col, label_map_on_read(label_col))
    return df


def scan_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV read with every column as text (for dirty numeric inputs)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)


def write_parquet(df: DataFrame, name: str, path: str | None = None,
                  partition_by: list[str] | None = None) -> str:
    path = path or scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
