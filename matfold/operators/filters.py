"""Declarative search: a filter spec compiled into one Column predicate (F*).

A spec is a dict: ``{"free_text": str, col: {"min": x, "max": y},
col: {"values": [...]}, col: scalar}``.  ``compile_filters`` turns it into a
single predicate, so one ``where`` carries the whole search and Catalyst can
push the parts that touch plain columns (equality, ranges on numeric
columns, IN lists) down to the parquet scan.  Columns named in the spec but
absent from the table are reported, not raised.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matfold.functions.parse import to_number
from matfold.functions.text import is_blank, py_strip


def _string_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def _pattern(text: str, regex: bool) -> str:
    return "(?i)" + (text if regex else re.escape(text))


def free_text_predicate(schema: T.StructType, text: str | None, regex: bool = True) -> Column:
    """Any string column contains ``text`` (case-insensitive).

    Empty text matches every row; a table without string columns matches
    none.  Nulls never match (the original matched 'None'/'nan' text).
    """
    if not text:
        return F.lit(True)
    text = str(text).strip()
    cols = _string_fields(schema)
    if not cols:
        return F.lit(False)
    pred = F.lit(False)
    for c in cols:
        pred = pred | F.coalesce(F.col(f"`{c}`").rlike(_pattern(text, regex)), F.lit(False))
    return pred


def _number(v: Any) -> float | None:
    if v is None:
        return None
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def range_predicate(col: Column, dtype: T.DataType, lo: Any = None, hi: Any = None,
                    keep_missing: bool = False) -> Column:
    """min/max bounds (inclusive); bound values may be numeric strings.

    Values that do not parse never pass.  ``keep_missing=True`` lets rows
    whose value is missing pass, as the original's NaN comparisons did.
    """
    lo, hi = _number(lo), _number(hi)
    v = col if isinstance(dtype, T.NumericType) else to_number(col.cast("string"))
    v = v.cast("double")
    pred = v.isNotNull()
    if lo is not None:
        pred = pred & (v >= lo)
    if hi is not None:
        pred = pred & (v <= hi)
    if keep_missing:
        pred = pred | col.isNull()
    return pred


def values_predicate(col: Column, values: Sequence[Any], dtype: T.DataType | None = None) -> Column:
    """Value list on the string form of the column; empty list -> no filter.

    On whole-number columns the values are compared as numbers, so that the
    list reaches the scan; values that are not such a column's text match nothing.
    """
    if not values:
        return F.lit(True)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = [int(str(v)) for v in values if re.fullmatch(r"0|-?[1-9]\d{0,17}", str(v))]
        return F.coalesce(col.isin(whole), F.lit(False)) if whole else F.lit(False)
    if isinstance(dtype, T.StringType):
        return F.coalesce(col.isin([str(v) for v in values]), F.lit(False))
    return F.coalesce(col.cast("string").isin([str(v) for v in values]), F.lit(False))


def contains_predicate(col: Column, text: Any, regex: bool = True) -> Column:
    return F.coalesce(col.cast("string").rlike(_pattern(str(text), regex)), F.lit(False))


def compile_filters(df: DataFrame, spec: Mapping[str, Any], keep_missing: bool = False,
                    regex: bool = True) -> tuple[Column, list[str]]:
    schema = df.schema
    types = {f.name: f.dataType for f in schema.fields}
    pred = free_text_predicate(schema, spec.get("free_text"), regex)
    missing: list[str] = []
    for name, rule in spec.items():
        if name == "free_text":
            continue
        if name not in types:
            missing.append(name)
            continue
        col = F.col(f"`{name}`")
        if isinstance(rule, Mapping) and ("min" in rule or "max" in rule):
            pred = pred & range_predicate(col, types[name], rule.get("min"), rule.get("max"), keep_missing)
        elif isinstance(rule, Mapping) and "values" in rule:
            pred = pred & values_predicate(col, rule.get("values") or [], types[name])
        else:
            pred = pred & contains_predicate(col, rule, regex)
    return pred, missing


def where_computed(df: DataFrame, pred: Column) -> DataFrame:
    """``df.where(pred)`` with the columns of ``df`` evaluated first, each once.

    Catalyst otherwise puts the expressions of parsed columns into every
    predicate that names them, and again into the projection.  A predicate that
    names a column without a fixed value stays above the projection.
    """
    return df.withColumn("_computed", F.spark_partition_id()).where(pred & (F.col("_computed") >= 0)).drop("_computed")


def apply_filters(df: DataFrame, spec: Mapping[str, Any], keep_missing: bool = False,
                  regex: bool = True, computed: bool = False) -> tuple[DataFrame, list[str]]:
    """``(filtered_df, missing_columns)``; ``computed`` for tables of parsed columns (see ``where_computed``)."""
    pred, missing = compile_filters(df, spec, keep_missing, regex)
    return where_computed(df, pred) if computed else df.where(pred), missing


def where_equal(df: DataFrame, columns: Sequence[str] | None = None,
                where: Mapping[str, Any] | None = None, limit: int | None = None,
                order_by: Sequence[str] | None = None) -> DataFrame:
    """Conjunctive equality filter + projection + optional ordered limit (F1)."""
    out = df
    for k, v in (where or {}).items():
        out = out.where(F.col(f"`{k}`") == F.lit(v))
    if columns:
        out = out.select(*[F.col(f"`{c}`") for c in columns])
    if limit is not None:
        out = out.orderBy(*(order_by or out.columns)).limit(limit)
    return out


def option_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-blank values as strings (dropdown options, F20/D3)."""
    v = F.col(f"`{column}`").cast("string")
    out = (df.select(v.alias("value"))
             .where(~is_blank("value") & (F.lower(py_strip("value")) != "nan"))
             .distinct().orderBy("value"))
    return out.limit(limit) if limit is not None else out


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows with a value in every column of ``subset``."""
    return df.dropna(subset=list(subset))


def rule_label(bounds: Mapping[str, tuple[float, float]]) -> Column:
    """'True' when every column lies within its inclusive bounds, else 'False' (F14)."""
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        cond = cond & F.coalesce(F.col(f"`{c}`").between(lo, hi), F.lit(False))
    return F.when(cond, F.lit("True")).otherwise(F.lit("False"))
