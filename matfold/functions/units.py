"""Unit conversions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of

# --- fixed values ---------------------------------------------------------
PSI_TO_MPA = 0.00689476
MILS_TO_MM = 0.0254
KELVIN_OFFSET = 273.15
KELVIN_THRESHOLD = 300.0  # values above are taken as kelvin
# --------------------------------------------------------------------------


def mpa_to_gpa(c: ColumnLike) -> Column:
    return col_of(c) / 1000.0


def kgm3_to_gcm3(c: ColumnLike) -> Column:
    return col_of(c) / 1000.0


def psi_to_mpa(c: ColumnLike) -> Column:
    return col_of(c) * PSI_TO_MPA


def mils_to_mm(c: ColumnLike) -> Column:
    return col_of(c) * MILS_TO_MM


def kelvin_to_celsius_if_high(c: ColumnLike, threshold: float = KELVIN_THRESHOLD) -> Column:
    """Values above ``threshold`` are kelvin and get converted; others kept.

    Kelvin values at or below the threshold are left as they are (the
    original rule); the threshold is an argument.
    """
    x = col_of(c)
    return F.when(x > threshold, x - KELVIN_OFFSET).otherwise(x)
