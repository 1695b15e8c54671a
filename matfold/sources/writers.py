"""Sinks (S8, S9, S12, S13)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def save_table(df: DataFrame, name: str, if_exists: str = "replace",
               partition_by: list[str] | None = None) -> None:
    """Named catalog table; ``if_exists`` in replace / append / fail."""
    w = df.write.mode(_MODES[if_exists])
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def run_sql(spark: SparkSession, text: str, args: Mapping | None = None) -> DataFrame:
    """SQL text with named parameters bound by Spark (no string pasting)."""
    return spark.sql(text, args=dict(args) if args else None)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet by default; ``fmt='csv'`` writes a header CSV."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_json_record(spark: SparkSession, record: Mapping, path: str, mode: str = "overwrite") -> None:
    """One-row JSON (run metadata) written through Spark."""
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(dict(record), default=str)], 1))
    df.coalesce(1).write.mode(mode).json(path)


def write_rejects(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rejected rows with their reason as JSON lines."""
    df.write.mode(mode).json(path)
