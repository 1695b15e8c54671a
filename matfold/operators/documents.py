"""Nested-document operators: flatten, tidy projections, key/value view.

Documents are Spark structs/arrays, so all of these are schema-driven
projections computed on the driver from ``df.schema`` (metadata only) and
executed as one ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matfold.functions.text import py_strip

# --- fixed values ---------------------------------------------------------
NOT_AVAILABLE = "N/A"
HIDDEN_VALUES = ["N/A", "None", "nan", ""]
TRUNCATE_AT = 80
# --------------------------------------------------------------------------


def _leaf_paths(dt: T.DataType, prefix: str) -> list[str]:
    if isinstance(dt, T.StructType):
        out = []
        for f in dt.fields:
            out.extend(_leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
        return out
    return [prefix]


def _ref(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> one column per leaf, named by the dotted path."""
    paths = _leaf_paths(df.schema, "")
    return df.select(*[_ref(p).alias(p.replace(".", sep)) for p in paths])


def young_from_k_g(k: Column, g: Column) -> Column:
    """E = 9KG / (3K + G) when both K and G are non-zero and non-null."""
    ok = k.isNotNull() & g.isNotNull() & (k != 0) & (g != 0)
    return F.when(ok, 9 * k * g / (3 * k + g))


def first_truthy(*cols: Column) -> Column:
    """Python ``a or b``: the first value that is neither null nor zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols[:-1]], cols[-1])


def key_value(df: DataFrame, id_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Long (id, key, value) view hiding null, 'N/A', 'None', 'nan' and blanks."""
    cols = [c for c in (columns or df.columns) if c != id_col]
    s = df.select(id_col, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = s.unpivot([id_col], cols, "key", "value")
    v = py_strip("value")
    return long.where(F.col("value").isNotNull() & ~v.isin(HIDDEN_VALUES))


def overview(df: DataFrame, defaults: dict[str, object], truncate: int = TRUNCATE_AT) -> DataFrame:
    """Projection with per-column defaults; strings cut to ``truncate`` chars."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c, d in defaults.items():
        col = F.coalesce(F.col(f"`{c}`"), F.lit(d)) if c in types else F.lit(d)
        if c in types and isinstance(types[c], T.StringType) or isinstance(d, str):
            col = F.substring(col.cast("string"), 1, truncate)
        out.append(col.alias(c))
    return df.select(*out)
