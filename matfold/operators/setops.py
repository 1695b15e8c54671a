"""Set operations (U*, D6)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables aligning columns by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def except_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right`` (anti join, no NOT IN trap)."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Idempotent merge of result sets: union then distinct."""
    return stack(frames).distinct()
