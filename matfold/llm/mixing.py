"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1],
``w(t) = weight * (1 + tilt * (2t - 1))``; its integral is the source's weight,
so shares of the whole run follow the weights while the mix shifts from
sources of negative tilt to those of positive tilt.  A source's token stream
is its documents in a fixed hash order, epoch after epoch, up to its target;
a document copy whose middle lies at token u of the stream is read at the time
t where the source's cumulative demand reaches u (the schedule's integral,
inverted).  Documents are range-sorted by that position.  The document at the border
of a target is taken whole if its middle is inside; what the source is then over or
under its target is made up, ``TRIMS`` times, by one copy less or more of the document
whose size comes nearest to it.

The running token sums of a source are built in two levels (hash ranges of a
source, then documents of a range, about sqrt(rows) of each), so no source is
gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matfold.llm.common import prepare, saved

#: Documents by which a source is brought nearer to its target.
TRIMS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), tilts: tuple[float, ...] = (-0.5, 0.0, 0.5),
                   cap: float = 3.0) -> DataFrame:
    """Targets per source from (source, source_size), one row per source.

    Sources in code-point order (null last) get the weights and tilts in turn.
    The targets share the total by weight; none exceeds ``cap`` times its
    source, and what is cut goes to the others by weight, i.e. target =
    min(cap * size, level * weight) with the one level that keeps the total.
    The windows below run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    t = (sizes.withColumn("rank", F.row_number().over(order) - 1)
         .withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts))
         .withColumn("most", F.col("source_size") * float(cap))
         .withColumn("full_at", F.col("most") / F.col("weight")))
    by_full = Window.orderBy("full_at", "rank")
    rest = by_full.rowsBetween(0, Window.unboundedFollowing)
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("level_here", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
         # the first source, by where it fills up, that the level does not fill
         .withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level_here"), F.struct("full_at", "rank", "level_here"))).over(everything)["level_here"]))
    return t.select("source", "source_size", "weight", "tilt",
                    F.least("most", F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), tilts: tuple[float, ...] = (-0.5, 0.0, 0.5), cap: float = 3.0) -> DataFrame:
    """Plan of the mix, one row per input row, range-sorted by first position.

    Columns: id, source, size (words), source_size, target, copies, taken
    (= copies * size), positions (array<double>, times in [0, 1] of the
    copies, ascending), position (the first, null if the row is not taken).

    Null texts and texts without words have size 0 and are not taken; a null
    source is a source of its own; rows that repeat are separate documents;
    the order of a source's stream depends on ids and sizes only, so reruns
    agree; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                             n_words(F.col(text_col)).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    # a null-safe join key and the place in the stream
    rows = rows.withColumn("key", F.concat_ws("", F.lit("s"), "source").alias("key"))
    rows = rows.withColumn("key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.col("key")))
    rows = rows.withColumn("h", F.xxhash64("id", "size"))
    bits = max(6, math.ceil(math.log2(rows.count() + 1) / 2))
    rows = rows.withColumn("range", F.shiftrightunsigned(F.col("h"), 64 - bits))
    ranges = saved(rows.groupBy("key", "source", "range").agg(F.sum("size").alias("range_size")))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("key", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, tilts, cap)
    targets = targets.withColumn("key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    starts = starts.join(targets, "key")
    inside = Window.partitionBy("key", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["key", "range"])
    out = out.withColumn("middle", F.col("range_start") + F.col("ahead") + F.col("size") / 2)
    copies = F.floor((F.col("target") - F.col("middle")) / F.col("source_size")) + 1
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(math.floor(cap)), copies))).otherwise(0).cast("int"))
    out = out.select("row", "key", "h", "id", "source", "size", "source_size", "target", "tilt", "middle", "copies")
    for _ in range(TRIMS):
        out = _nearer(saved(out), math.floor(cap))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    share = lambda epoch: (epoch * F.col("source_size") + F.col("middle")) / F.col("target")
    positions = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: time_of(F.least(share(e), F.lit(1.0)), F.col("tilt")))
    out = out.withColumn("positions", F.when(F.col("copies") > 0, positions).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("position", F.try_element_at("positions", F.lit(1)))
    out = out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken", "positions", "position")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col(id_col)).sortWithinPartitions(F.col("position").asc_nulls_last(), id_col)


def _nearer(out: DataFrame, most: int) -> DataFrame:
    """``copies`` with one document of each source taken once more or less, if that brings the source nearer to its target."""
    # one row per source, written: its known size lets the planner send it to the rows instead of dealing the rows by source
    gaps = saved(out.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")))
    fits = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs("gap") - F.col("size"))
    best = (out.join(gaps, "key").where((F.col("size") > 0) & fits & (left < F.abs("gap")))
            .groupBy("key").agg(F.min(F.struct(left.alias("left"), "h", "id", "row")).alias("best"), F.max(F.signum("gap")).cast("int").alias("step")))
    steps = best.select(F.col("best.row").alias("row"), "step")
    return out.join(steps, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")


def time_of(q: Column, tilt: Column) -> Column:
    """t with t + tilt * (t^2 - t) = q: the time at which a share q of the demand is met."""
    b = 1 - tilt
    root = (F.sqrt(b * b + 4 * tilt * q) - b) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, q).otherwise(F.greatest(F.lit(0.0), F.least(root, F.lit(1.0))))


def training_order(plan: DataFrame) -> DataFrame:
    """One row per document copy, range-sorted by position, from a ``mix`` plan."""
    return (plan.select("*", F.explode("positions").alias("at")).drop("position", "positions")
            .withColumnRenamed("at", "position")
            .repartitionByRange("position").sortWithinPartitions("position"))
