"""Schema operators (P*): names, aliases, coercion, column sets.

Name-level operators only touch ``df.columns`` on the driver (metadata, no
job).  Data-dependent ones (auto-coercion, all-null detection) run exactly
one aggregate over all columns and then rebuild a single projection; they
never loop over columns with one action each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matfold.functions.parse import to_number
from matfold.functions.text import py_strip

# --- fixed values ---------------------------------------------------------
# SQL-safe replacements applied to column names.
SQL_SAFE = [("%", "pct"), ("°", "C"), ("/", "_")]
# Prefix and unit fragments removed by the unit-stripping name option.
UNIT_FRAGMENTS = [("PROPERTY: ", ""), ("(GPa)", ""), ("(MPa)", ""), ("(wppm)", ""),
                  ("(μm)", "um"), ("μ", "u"), ("°C", "C"), ("/", "_"), ("%", "pct")]
# --------------------------------------------------------------------------


def normalize_column_name(name: str, strip_units: bool = False) -> str:
    """strip, newlines -> blank, collapse whitespace, blank -> '_'."""
    nc = str(name).strip().replace("\n", " ").replace("\r", " ")
    if strip_units:
        for a, b in UNIT_FRAGMENTS:
            nc = nc.replace(a, b)
        nc = nc.strip()
    nc = " ".join(nc.split())
    return nc.replace(" ", "_")


def normalize_columns(df: DataFrame, strip_units: bool = False) -> DataFrame:
    return df.toDF(*[normalize_column_name(c, strip_units) for c in df.columns])


def sql_safe_columns(df: DataFrame) -> DataFrame:
    def fix(c: str) -> str:
        for a, b in SQL_SAFE:
            c = c.replace(a, b)
        return c
    return df.toDF(*[fix(c) for c in df.columns])


def strip_header(df: DataFrame, underscore: bool = False) -> DataFrame:
    names = [c.strip() for c in df.columns]
    if underscore:
        names = [c.replace(" ", "_") for c in names]
    return df.toDF(*names)


def resolve_alias(columns: Sequence[str], candidates: Sequence[str],
                  pattern: str | None = None, fallback_first: bool = False) -> str | None:
    """First present candidate (names compared stripped), else a regex match."""
    stripped = {c.strip(): c for c in columns}
    for cand in candidates:
        if cand in stripped:
            return stripped[cand]
    if pattern:
        for c in columns:
            if re.search(pattern, c, flags=re.I):
                return c
    return columns[0] if fallback_first and columns else None


def add_missing_columns(df: DataFrame, expected: Sequence[str], dtype: str = "string") -> DataFrame:
    missing = [c for c in expected if c not in df.columns]
    return df.select("*", *[F.lit(None).cast(dtype).alias(c) for c in missing])


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    cols = set(columns)
    return df.select(*[to_number(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip every string column (Python strip semantics); nulls stay null."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(py_strip(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def auto_coerce(df: DataFrame, min_fraction: float = 0.0, only: Iterable[str] | None = None) -> DataFrame:
    """Cast every string column (of ``only``, if given) in which enough values parse as numbers.

    Pass 1 is one aggregate counting parseable and non-null values of all
    string columns; pass 2 is one projection.  ``min_fraction=0`` means
    "at least one value parses", the original rule.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (only is None or f.name in only)]
    if not strings:
        return df
    aggs = []
    for i, c in enumerate(strings):
        aggs.append(F.count(to_number(F.col(f"`{c}`"))).alias(f"p{i}"))
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"n{i}"))
    stats = df.agg(*aggs).first()
    cast = set()
    for i, c in enumerate(strings):
        parsed, nonnull = stats[f"p{i}"], stats[f"n{i}"]
        if parsed > 0 and (nonnull == 0 or parsed / nonnull >= min_fraction):
            cast.add(c)
    return df.select(*[to_number(F.col(f"`{c}`")).alias(c) if c in cast else F.col(f"`{c}`")
                       for c in df.columns])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns with no non-null value (one aggregate, then a projection)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def row_mean(cols: Sequence[Column]) -> Column:
    """Null-skipping mean across columns (pandas ``mean(axis=1)``)."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def duplicate_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose base name (before a dot) another column shares."""
    bases = [c.split(".")[0] for c in columns]
    return [c for c, b in zip(columns, bases, strict=True) if bases.count(b) > 1]


def merge_duplicate_numeric(df: DataFrame) -> DataFrame:
    """Merge numeric columns sharing a base name (``X``, ``X.1``) by row mean.

    The merged value is kept under the base name (the original dropped it
    again by accident); a single suffixed column is renamed to its base.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    groups: dict[str, list[str]] = {}
    for c in numeric:
        groups.setdefault(c.split(".")[0], []).append(c)
    out, done = [], set()
    for c in df.columns:
        if c in numeric:
            base = c.split(".")[0]
            if base in done:
                continue
            done.add(base)
            members = groups[base]
            if len(members) > 1:
                out.append(row_mean([F.col(f"`{m}`") for m in members]).alias(base))
            else:
                out.append(F.col(f"`{c}`").alias(base))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def drop_text_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The table a model sees: string columns go, but for those of ``keep``."""
    return df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep])


def symbol_name(name: str) -> str:
    """'Iron (Fe)' -> 'Fe'; names with 'Ultimate' -> 'UTS', 'Liquidus' -> 'Liquidus'."""
    if "Ultimate" in name:
        return "UTS"
    if "Liquidus" in name:
        return "Liquidus"
    m = re.search(r"\(([^)]+)\)", name)
    return m.group(1) if m else name.strip()


def rename_by_symbol(df: DataFrame) -> DataFrame:
    """Rename composition columns to their element symbol (driver-side, no job)."""
    return df.toDF(*[symbol_name(c) for c in df.columns])
