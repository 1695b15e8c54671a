"""Corrosion scoring on a stream of records.

The reference has no streaming operators; this module only shows that the
library's operators are plain Column / DataFrame functions and therefore
run unchanged on a ``readStream`` source.  Per-record scores are stateless;
the per-material summary is a streaming aggregation whose state is one row
per clean name, kept in the checkpoint under the cluster's shared folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matfold.operators.agg import first_nonblank, score_stats
from matfold.plans.corrosion import ORDINAL, score_records
from matfold.session import ensure_checkpoint_dir


def record_stream(spark: SparkSession, source_dir: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def scored_records(stream: DataFrame) -> DataFrame:
    """Stateless per-record scores (append mode)."""
    return score_records(stream)


def material_scores(stream: DataFrame) -> DataFrame:
    """Per-material summary, updated as records arrive (complete/update mode).

    One aggregate, since a stream can have but one outside append mode.
    """
    order = F.struct(*[F.col(c) for c in ORDINAL])
    out = score_records(stream).groupBy("Clean_Name").agg(
        *score_stats("corr_score_row", "corr_score"), F.count("corr_score_row").cast("long").alias("data_points"), first_nonblank("UNS", order).alias("UNS"))
    return out.select("Clean_Name", *[F.round(f"corr_score_{x}", 6).alias(f"corr_score_{x}") for x in ("min", "mean", "var")], "data_points", "UNS")


def start(df: DataFrame, name: str, output_mode: str = "complete", sink: str = "memory",
          checkpoint: str | None = None) -> StreamingQuery:
    spark = df.sparkSession
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink)
    return w.start()
