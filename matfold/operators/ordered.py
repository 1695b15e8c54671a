"""Running totals and dense codes over a global order, as tables.

A frame is range-partitioned and sorted by its order and written once to the
shared folder, with a number that holds the partition and the place in it.  What
comes before a partition is a running sum over one row per partition, joined
back; no labels, codes or bounds pass through the driver and the input is read
once (and sampled for the ranges).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matfold.session import ensure_checkpoint_dir

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in order with ``_part`` and ``_place``; written, so that a repeated task cannot renumber rows."""
    ensure_checkpoint_dir(df.sparkSession)
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    split = at.select(*df.columns, F.shiftright("_at", _PLACE_BITS).alias("_part"), F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place"))
    return split.checkpoint()


def _before(parts: DataFrame, amount: str) -> DataFrame:
    """(_part, _before): what the partitions in front of each hold together; one row per partition."""
    front = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(amount).over(front), F.lit(0)).alias("_before"))


def dense_codes(distinct: DataFrame, order: Sequence[str], code_col: str = "code") -> DataFrame:
    """The rows of ``distinct`` with codes 0, 1, ... in the given order."""
    placed = _placed(distinct, order)
    parts = placed.groupBy("_part").agg((F.max("_place") + 1).alias("_n"))
    return (placed.join(_before(parts, "_n"), "_part")
            .select(*distinct.columns, (F.col("_before") + F.col("_place")).cast("long").alias(code_col)))


def running_total(df: DataFrame, order: str, amount: str, out: str = "total_before") -> DataFrame:
    """``df`` (one row per value of ``order``) with the sum of ``amount`` over all rows in front."""
    placed = _placed(df, [order])
    parts = placed.groupBy("_part").agg(F.sum(amount).alias("_n"))
    front = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(_before(parts, "_n"), "_part")
            .select(*df.columns, (F.col("_before") + F.coalesce(F.sum(amount).over(front), F.lit(0))).alias(out)))
