"""Aggregations (A*).

Each operator is one ``groupBy().agg()`` (or one global ``agg``) of built-in
aggregate functions, so Spark runs a partial aggregate in every input task
and shuffles only per-key partial states.  Conditional aggregates use
``when`` inside the aggregate instead of a second pass and a join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from matfold.functions._util import ColumnLike, col_of
from matfold.functions.text import is_blank
from matfold.session import ensure_checkpoint_dir


def score_stats(value: ColumnLike, prefix: str) -> list[Column]:
    """min, mean, sample variance (0.0 with fewer than two points), count."""
    v = col_of(value)
    n = F.count(v)
    return [
        F.min(v).alias(f"{prefix}_min"),
        F.avg(v).alias(f"{prefix}_mean"),
        F.when(n > 1, F.var_samp(v)).otherwise(F.lit(0.0)).alias(f"{prefix}_var"),
    ]


def first_nonblank(value: ColumnLike, order: Column, default: str | None = "") -> Column:
    """First non-blank value by ``order``; ``default`` when there is none.

    ``min_by`` skips rows whose ordering is null, so blank rows get a null
    ordering instead of a filter clause.
    """
    v = col_of(value)
    picked = F.min_by(v, F.when(~is_blank(v), order))
    return F.coalesce(picked, F.lit(default)) if default is not None else picked


#: Decimal digits of the order columns in ``packed_order``; 38 in all.
ORDER_DIGITS = (14, 4, 10, 10)


def packed_order(*cols: ColumnLike, digits: Sequence[int] = ORDER_DIGITS) -> Column:
    """Order columns (whole numbers from 0) as one number that orders like them.

    A fixed-width number can be a hash aggregate's buffer, a struct cannot.  A
    value that needs more than its digits raises.
    """
    out = None
    for c, d in zip(cols, digits, strict=False):
        x = col_of(c).cast("long")
        part = F.when((x >= 0) & (x < 10 ** d), x).when(x.isNotNull(), F.raise_error(F.lit(f"order value needs more than {d} digits")).cast("long"))
        part = part.cast("decimal(38,0)")
        out = part if out is None else out * F.lit(10 ** d).cast("decimal(11,0)") + part
    return out.cast("decimal(38,0)")


def stats_and_first(df: DataFrame, key: str, value: str, prefix: str, label: str, order: Column) -> DataFrame:
    """Per key: min, mean, sample variance and count of ``value``, and the first non-blank ``label`` by ``order``.

    Two aggregates: per (key, label) everything is a fixed-width number, so the
    whole input goes through a hash aggregate that is combined map-side and no
    task sorts it; what is left, a row per key and label, is merged per key.
    ``order`` is a number (``packed_order``); the label is '' when there is none.
    """
    given = F.when(~is_blank(label), col_of(label))
    part = df.select(key, F.col(value).alias("_v"), given.alias("_label"), F.when(given.isNotNull(), order).alias("_order")).groupBy(key, "_label").agg(
        F.min("_v").alias("_min"), F.count("_v").alias("_n"), F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var"), F.min("_order").alias("_first"))
    n, total = F.sum("_n"), F.sum(F.col("_n") * F.col("_mean"))
    squares = F.sum(F.col("_n") * (F.col("_var") + F.col("_mean") * F.col("_mean"))) - total * total / n
    return part.groupBy(key).agg(
        F.min("_min").alias(f"{prefix}_min"), F.when(n > 0, total / n).alias(f"{prefix}_mean"),
        F.when(n > 1, F.greatest(squares, F.lit(0.0)) / (n - 1)).otherwise(F.lit(0.0)).alias(f"{prefix}_var"),
        n.cast("long").alias("data_points"), F.coalesce(F.min_by("_label", "_first"), F.lit("")).alias(label))


def conditional_min(value: ColumnLike, flag: ColumnLike) -> Column:
    """min over flagged rows if the group has any, else over all rows.

    When flagged rows exist but all their values are null the result is
    null, not the overall minimum.
    """
    v, f = col_of(value), col_of(flag)
    return F.when(F.count_if(f) > 0, F.min(F.when(f, v))).otherwise(F.min(v))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing-value report: one row per column, count of nulls, descending.

    One aggregate over all columns, then an unpivot of the single result row.
    Ties are ordered by column name so the report is deterministic.
    """
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "missing")
    return long


def coverage_percent(value: ColumnLike) -> Column:
    """Percent of rows with a non-null value."""
    return 100.0 * F.avg(col_of(value).isNotNull().cast("double"))


def distinct_sample(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` smallest distinct values: a distributed top-k, no collect."""
    return (df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
              .distinct().orderBy("value").limit(n))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def mean_by_key(df: DataFrame, key: ColumnLike, key_name: str = "key",
                exclude: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column per key."""
    nums = numeric_columns(df, exclude)
    return df.groupBy(col_of(key).alias(key_name)).agg(*[F.avg(c).alias(c) for c in nums])


def _ordered_bits(value: ColumnLike) -> Column:
    """A double's bits as a long that orders like the double (-0.0 as 0.0, NaN last)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), col_of(value) + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


#: Bits of an ordered double that one round of ``grouped_medians`` tells apart.
MEDIAN_BITS = 16


def grouped_medians(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Exact per-key medians of several columns (mean of the two middle values).

    Radix selection: counts per (key, column, high bits of the value) locate the
    bucket of each middle rank; the rows of unfinished buckets alone are counted
    again by the next bits.  A bucket whose smallest and largest value agree is
    finished, and four rounds always are enough.  Only counts are shuffled, a
    key's histogram has at most 2^16 rows a round, so a key with a third of the
    rows and all values distinct costs no task more than its input.  Null keys are
    a group; a column without values has a null median.
    """
    ensure_checkpoint_dir(df.sparkSession)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(values)]))
    long = df.select(F.col(key).alias("_key"), each).where("_v IS NOT NULL")
    long = long.withColumn("_o", _ordered_bits("_v")).checkpoint()
    group = ["_key", "_c", "_prefix"]
    rows, found, wanted = long.withColumn("_prefix", F.lit(0).cast("long")), [], None
    for shift in range(64 - MEDIAN_BITS, -1, -MEDIAN_BITS):
        hist = (rows.groupBy(*group, F.shiftright("_o", shift).alias("_b"))
                .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        whole = Window.partitionBy(*group)
        upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        cum = hist.select("*", F.sum("_n").over(upto).alias("_cum"), F.sum("_n").over(whole).alias("_total"))
        if wanted is None:
            middle = F.array(F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1)
            ranked = cum.select("*", F.posexplode(middle).alias("_which", "_rank"))
        else:
            w = wanted.select(*[F.col(c).alias(f"w{c}") for c in group], "_which", "_rank")
            same = F.col("_key").eqNullSafe(F.col("w_key")) & (F.col("_c") == F.col("w_c")) & (F.col("_prefix") == F.col("w_prefix"))
            ranked = cum.join(w, same)
        start = F.col("_cum") - F.col("_n")
        hit = (ranked.where((start < F.col("_rank")) & (F.col("_rank") <= F.col("_cum")))
               .select("_key", "_c", F.col("_b").alias("_prefix"), "_which", (F.col("_rank") - start).alias("_rank"), "_lo", "_hi").checkpoint())
        done = F.col("_lo").eqNullSafe(F.col("_hi"))
        found.append(hit.where(done).select("_key", "_c", F.col("_lo").alias("_value")))
        wanted = hit.where(~done)
        if wanted.isEmpty():
            break
        open_ = wanted.select(F.col("_key").alias("w_key"), F.col("_c").alias("w_c"), F.col("_prefix").alias("w_prefix")).distinct()
        rows = (long.join(open_, F.col("_key").eqNullSafe(F.col("w_key")) & (F.col("_c") == F.col("w_c"))
                          & (F.shiftright("_o", shift) == F.col("w_prefix")))
                .select("_key", "_c", "_v", "_o", F.col("w_prefix").alias("_prefix")))
    middles = found[0]
    for f in found[1:]:
        middles = middles.unionByName(f)
    medians = middles.groupBy("_key", "_c").agg(F.avg("_value").alias("_m"))
    return medians.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(v) for i, v in enumerate(values)])
