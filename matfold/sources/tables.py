"""Access to the driver's parquet tables.

Tables are read with ``spark.read.parquet`` so that column pruning and
predicate pushdown reach the scan.  SQL text refers to a table through a
``{name}`` placeholder: Spark fills it with a ``parquet.`path``` relation,
the DuckDB oracle with its pre-registered view name.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spark_refs(sf_dir: str) -> dict[str, str]:
    """Placeholder values that make SQL text read the parquet files in Spark."""
    return {t: f"parquet.`{table_path(sf_dir, t)}`" for t in TABLES}


def _view_name(sf_dir: str, table: str) -> str:
    import hashlib
    return f"mf_{table}_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}"


def duck_refs() -> dict[str, str]:
    return {t: t for t in TABLES}


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL text over the tables of ``sf_dir`` (each read via ``read_table``)."""
    refs = {}
    for t in TABLES:
        if "{" + t + "}" in text:
            name = _view_name(sf_dir, t)
            read_table(spark, sf_dir, t).createOrReplaceTempView(name)
            refs[t] = name
        else:
            refs[t] = t
    return spark.sql(text.format(**refs))
