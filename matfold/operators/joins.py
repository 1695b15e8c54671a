"""Joins (J*): exact, null-safe, substring, lookup, feature assembly.

No broadcast is requested here: the planner and AQE broadcast a side only when
its measured bytes are under ``spark.sql.autoBroadcastJoinThreshold``, and AQE
splits skewed partitions (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of
from matfold.functions.text import py_strip

def suffixed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                  suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """pandas-style merge: shared non-key columns get suffixes.

    ``null_safe=True`` matches null keys with null keys (``eqNullSafe``),
    which is what pandas does; the default drops them.
    """
    on = list(on)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    ls, rs = suffixes
    l2 = left.select(*[F.col(c).alias(c + ls if c in clash else c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(c + rs if c in clash else c) for c in right.columns])
    if not null_safe:
        return l2.join(r2, on, how)
    la = l2.alias("_l")
    ra = r2.alias("_r")
    cond = None
    for k in on:
        c = F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
        cond = c if cond is None else cond & c
    joined = la.join(ra, cond, how)
    keys = [F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in on]
    rest = ([F.col(f"_l.{c}") for c in l2.columns if c not in on]
            + [F.col(f"_r.{c}") for c in r2.columns if c not in on])
    return joined.select(*keys, *rest)


def lookup_first(left: DataFrame, index: DataFrame, left_key: ColumnLike, index_key: str,
                 value: str, default: str | None = None) -> DataFrame:
    """Left join to a unique index; missing -> ``default``."""
    idx = index.select(F.col(index_key).alias("_ik"), F.col(value).alias("_iv"))
    out = left.join(idx, col_of(left_key) == F.col("_ik"), "left")
    v = F.col("_iv") if default is None else F.coalesce(F.col("_iv"), F.lit(default))
    return out.select(*[F.col(c) for c in left.columns], v.alias(value))


def contains_any(df: DataFrame, text: ColumnLike, names: DataFrame, name_col: str,
                 flag: str = "is_match", empty_means: bool = True) -> DataFrame:
    """Flag rows whose text contains any of ``names`` as a substring.

    Blank names are dropped (they would match everything).  If the name
    table is empty every row gets ``empty_means``.  Each distinct text is
    exploded into its substrings of every length present in the name table,
    which join on equality - no cross product, the same plan at every size.
    """
    nm = (names.select(F.upper(py_strip(F.col(name_col))).alias("_name"))
               .where(F.col("_name").isNotNull() & (F.col("_name") != ""))
               .distinct())
    # Distinct name lengths are bounded by the longest name, not by the
    # row count, so they are safe to bring to the driver.
    lens = sorted(r[0] for r in nm.select(F.length("_name")).distinct().collect())
    if not lens:
        return df.select("*", F.lit(empty_means).alias(flag))
    keyed = df.select("*", F.upper(col_of(text)).alias("_text"))
    texts = keyed.select("_text").where(F.col("_text").isNotNull()).distinct()
    subs = (texts.select("_text", F.explode(F.array(*[F.lit(n) for n in lens])).alias("_len"))
            .where(F.length("_text") >= F.col("_len"))
            .select("_text", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_len") + 1))
                    .alias("_pos"), "_len")
            .select("_text", F.substring(F.col("_text"), F.col("_pos"), F.col("_len")).alias("_name")))
    hits = (subs.join(nm, "_name", "left_semi").select("_text").distinct()
                .select("_text", F.lit(True).alias("_hit")))
    out = keyed.join(hits, "_text", "left")
    return out.select(*[F.col(c) for c in df.columns],
                      F.coalesce(F.col("_hit"), F.lit(False)).alias(flag))
