"""Keep-first dedup, distinct, first-match and best-match operators.

Spark frames have no row order, so every "first row" rule takes an explicit
ordering.  ``keep_first`` is a grouped ``min_by`` rather than a
``row_number`` window: the aggregate is combined map-side, so a key holding
a third of all rows is reduced inside each input task before the shuffle
instead of being sorted whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of


def order_key(*cols: ColumnLike, nulls_last: Sequence[str] = ()) -> Column:
    """A struct usable as a min_by ordering; listed columns sort nulls last."""
    fields = []
    for i, c in enumerate(cols):
        name = c if isinstance(c, str) else f"_k{i}"
        if isinstance(c, str) and c in nulls_last:
            fields.append(col_of(c).isNull().alias(f"_n{i}"))
        fields.append(col_of(c).alias(name if isinstance(c, str) else f"_k{i}"))
    return F.struct(*fields)


def keep_first(df: DataFrame, subset: Sequence[str], order_by: Column | Sequence[ColumnLike], repeats: bool = False) -> DataFrame:
    """``drop_duplicates(subset, keep='first')`` with an explicit order.

    Null keys form one group, as in pandas.  Output keeps the input's
    column order.  ``repeats``: rows are mostly equal but for their one numeric
    order column, so they are reduced to their smallest order by a hash aggregate
    first.
    """
    if repeats:
        (at,) = order_by
        df = df.groupBy(*[c for c in df.columns if c != at]).agg(F.min(at).alias(at)).select(*df.columns)
    ordering = order_by if isinstance(order_by, Column) else F.struct(*[col_of(c) for c in order_by])
    others = [c for c in df.columns if c not in subset]
    if not others:
        return df.select(*subset).distinct()
    agg = (df.groupBy(*subset)
             .agg(F.min_by(F.struct(*others), ordering).alias("_first")))
    return agg.select(*[F.col(c) for c in subset], "_first.*").select(*df.columns)


def first_match(df: DataFrame, key: str, value: str, order_by: ColumnLike) -> DataFrame:
    """First ``value`` per ``key`` by ``order_by``."""
    return df.groupBy(key).agg(F.min_by(col_of(value), col_of(order_by)).alias(value))


def best_per_key(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Best-scoring row per key; ties go to the larger ``tie`` value.

    ``max_by`` over (score, tie) combines map-side like ``keep_first``.
    """
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(col_of(score), col_of(tie))).alias("_best"))
    return agg.select(key, "_best.*").select(*df.columns)


def argmax_class(probs: ColumnLike) -> tuple[Column, Column]:
    """Index (0-based) and value of the largest element of an array column."""
    p = col_of(probs)
    best = F.array_max(p)
    return (F.array_position(p, best) - 1).cast("int"), best
