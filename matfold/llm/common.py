"""Helpers shared by the operators: shared-folder tables, schema of outputs."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the executors and the shared folder known."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


#: Writer's options for rows of hundreds of kB: by default parquet looks at the size of a page and of a
#: row group after 100 rows only, and whoever reads or writes the table holds pages of tens of MB.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.block.size": str(8 << 20)}


def saved(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but with parquet's encoding; every
    executor sees the files, so a lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/matfold-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def filed(df: DataFrame, rows: int, per_file: int = 5000) -> DataFrame:
    """``df`` in no more partitions than make files of ``per_file`` rows, ``rows`` being about what it has.

    For tables that are written right behind a shuffle: of a small one every
    shuffle partition would write a file, and Hadoop starts a process (chmod)
    for each file and its checksum on a file system of local paths.
    """
    return df.coalesce(max(1, math.ceil(rows / per_file)))


class Bitmap:
    """Fixed-size set of 64-bit keys with false positives (1 MiB whatever the number of keys).

    A pre-filter for rows on the way into an exact join: a fuller map lets more
    rows pass, it never loses one.
    """
    BITS = 23

    def __init__(self, spark: SparkSession, keys: DataFrame, col: str) -> None:
        at = keys.select(F.shiftrightunsigned(F.col(col), 64 - self.BITS).alias("at"))
        words = (at.groupBy(F.expr("int(at >> 6)").alias("w"))
                 .agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("b")).collect())
        bits = np.zeros(1 << (self.BITS - 6), np.int64)
        for w, b in words:
            bits[w] = b
        self.held = spark.sparkContext.broadcast(bits.view(np.uint64))

    def match(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.BITS)
        return (self.held.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def column_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()
