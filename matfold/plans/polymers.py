"""Polymer jobs: unified Tg table, Tg training set, lookup table, flexibility.

The unified table is an outer merge on the (float) glass-transition value
followed by keep-first per polymer name.  A literal many-to-many outer join
would emit every pair of rows sharing a Tg value (and every pair of null-Tg
rows, since the merge matches null with null).  Only the first class per Tg
value can ever survive the keep-first, so the class side is first reduced to
one row per Tg value (map-side combined ``min_by``) and then joined
many-to-one; rows of the class side whose Tg matches nothing are appended
by an anti join.  Same result, no pair explosion, no hot-key blow-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.functions.parse import to_number
from matfold.functions.score import flexibility_score, rigidity_class
from matfold.functions.text import py_strip, upper_strip
from matfold.functions.units import kelvin_to_celsius_if_high
from matfold.operators.filters import drop_missing
from matfold.operators.dedup import keep_first
from matfold.operators.schema import resolve_alias
from matfold.operators.setops import stack
from matfold.plans import sqlfrag as S
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view

# --- fixed values ---------------------------------------------------------
UNKNOWN_POLYMER = "Unknown Polymer"
TG_VALID = (-200.0, 1000.0)  # exclusive bounds of a plausible Tg
NAME_CANDIDATES = ["Polymer", "Name", "Material", "polymer"]
# --------------------------------------------------------------------------

UNIFIED_COLS = ["Polymer", "Polymer_Class", "SMILES", "Tg_C", "Density_g_cm3", "Rigidity_Class"]


def polymer_unified(named: DataFrame, classes: DataFrame) -> DataFrame:
    """named: (ord, name, SMILES, Tg, Density); classes: (ord, Polymer_Class, Tg)."""
    b = named.select(F.col("name").alias("Polymer"), "SMILES",
                     kelvin_to_celsius_if_high(to_number("Tg")).alias("Tg_C"),
                     to_number("Density").alias("Density_g_cm3"), F.col("ord").alias("_ob"))
    a = classes.select("Polymer_Class", kelvin_to_celsius_if_high(to_number("Tg")).alias("Tg_C"),
                       F.col("ord").alias("_oa"))
    a_first = a.groupBy("Tg_C").agg(F.min_by("Polymer_Class", "_oa").alias("Polymer_Class"),
                                    F.min("_oa").alias("_oa"))
    af = a_first.alias("af")
    matched = (b.alias("b").join(af, F.col("b.Tg_C").eqNullSafe(F.col("af.Tg_C")), "left")
                .select("b.Polymer", "af.Polymer_Class", "b.SMILES", "b.Tg_C", "b.Density_g_cm3",
                        "b._ob", "af._oa"))
    a_only = (af.join(b.select("Tg_C").alias("bk"), F.col("af.Tg_C").eqNullSafe(F.col("bk.Tg_C")),
                      "left_anti")
                .select(F.lit(None).cast("string").alias("Polymer"), "Polymer_Class",
                        F.lit(None).cast("string").alias("SMILES"), "Tg_C",
                        F.lit(None).cast("double").alias("Density_g_cm3"),
                        F.lit(None).cast("long").alias("_ob"), "_oa"))
    rows = stack([matched, a_only]).withColumn(
        "Polymer", F.coalesce(F.col("Polymer"), F.lit(UNKNOWN_POLYMER)))
    order = F.struct(F.col("Tg_C").isNull(), F.col("Tg_C"), F.col("_ob").isNull(), F.col("_ob"),
                     F.col("_oa"))
    first = keep_first(rows, ["Polymer"], order)
    return first.select("Polymer", "Polymer_Class", "SMILES", "Tg_C", "Density_g_cm3",
                        rigidity_class("Tg_C").alias("Rigidity_Class"))


def polymer_training(named: DataFrame, classes: DataFrame) -> DataFrame:
    b = named.select("SMILES", "Tg", "name", "abr", F.lit(None).cast("string").alias("Polymer_Class"),
                     upper_strip("name").alias("NAME_NORM"), F.lit(0).alias("_src"), F.col("ord").alias("_o"))
    a = classes.select("SMILES", "Tg", F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast("string").alias("abr"), "Polymer_Class",
                       upper_strip("Polymer_Class").alias("NAME_NORM"), F.lit(1).alias("_src"),
                       F.col("ord").alias("_o"))
    a_only = a.join(b.select("NAME_NORM").where(F.col("NAME_NORM").isNotNull()).distinct(),
                    "NAME_NORM", "left_anti")
    both = stack([b, a_only]).drop("NAME_NORM")
    first = keep_first(both, ["SMILES"], ["_src", "_o"])
    tg = to_number("Tg")
    lo, hi = TG_VALID
    return (drop_missing(first, ["SMILES", "Tg"])
                 .select(py_strip("SMILES").alias("SMILES"), tg.alias("Tg"), "name", "abr", "Polymer_Class")
                 .where(F.col("Tg").isNotNull() & (F.col("Tg") > lo) & (F.col("Tg") < hi)))


def polymer_lookup(named: DataFrame, classes: DataFrame) -> DataFrame:
    return stack([classes.drop("ord"), named.drop("ord")]).distinct()


def flexibility(named: DataFrame) -> DataFrame:
    data_cols = [c for c in named.columns if c != "ord"]
    name_col = resolve_alias(data_cols, NAME_CANDIDATES, fallback_first=True)
    tg = to_number("Tg")
    return named.select(F.col(name_col), tg.alias("Tg"), to_number("Density").alias("Density"),
                        flexibility_score(tg).alias("flexibility_score"))


def _inputs(spark, sf_dir):
    return raw_view(spark, sf_dir, "raw_polymer_b"), raw_view(spark, sf_dir, "raw_polymer_a")


def _k2c(x: str) -> str:
    v = S.to_number(x)
    return f"(CASE WHEN {v} > 300.0 THEN {v} - 273.15 ELSE {v} END)"


_POLY = duck_cte("raw_polymer_b", "raw_polymer_a")


@query("polymer_unified", oracle=_POLY + f"""
, b AS (SELECT name AS Polymer, SMILES, {_k2c('Tg')} AS Tg_C, {S.to_number('Density')} AS Density_g_cm3,
               ord AS ob FROM raw_polymer_b),
  a AS (SELECT Polymer_Class, {_k2c('Tg')} AS Tg_C, ord AS oa FROM raw_polymer_a),
  m AS (SELECT coalesce(b.Polymer, 'Unknown Polymer') AS Polymer, a.Polymer_Class, b.SMILES,
               coalesce(b.Tg_C, a.Tg_C) AS Tg_C, b.Density_g_cm3, b.ob, a.oa
        FROM b FULL OUTER JOIN a ON b.Tg_C IS NOT DISTINCT FROM a.Tg_C)
SELECT Polymer, Polymer_Class, SMILES, round(Tg_C, 6) AS Tg_C, round(Density_g_cm3, 6) AS Density_g_cm3,
       CASE WHEN Tg_C IS NULL THEN 'Unknown' WHEN Tg_C < 0 THEN 'Flexible'
            WHEN Tg_C <= 100 THEN 'Semi-rigid' ELSE 'Rigid' END AS Rigidity_Class
FROM m QUALIFY row_number() OVER (PARTITION BY Polymer
                                  ORDER BY Tg_C ASC NULLS LAST, ob ASC NULLS LAST, oa ASC NULLS LAST) = 1
""")
def q_polymer_unified(spark, sf_dir):
    out = polymer_unified(*_inputs(spark, sf_dir))
    return out.withColumn("Tg_C", F.round("Tg_C", 6)).withColumn("Density_g_cm3", F.round("Density_g_cm3", 6))


@query("polymer_training", oracle=_POLY + f"""
, b AS (SELECT SMILES, Tg, name, abr, NULL AS Polymer_Class, upper({S.strip('name')}) AS nn, 0 AS src, ord
        FROM raw_polymer_b),
  a AS (SELECT SMILES, Tg, NULL AS name, NULL AS abr, Polymer_Class, upper({S.strip('Polymer_Class')}) AS nn,
               1 AS src, ord FROM raw_polymer_a),
  u AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE nn NOT IN (SELECT nn FROM b WHERE nn IS NOT NULL)),
  f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY SMILES ORDER BY src, ord) = 1)
SELECT {S.strip('SMILES')} AS SMILES, {S.to_number('Tg')} AS Tg, name, abr, Polymer_Class FROM f
WHERE SMILES IS NOT NULL AND Tg IS NOT NULL AND {S.to_number('Tg')} > -200 AND {S.to_number('Tg')} < 1000
""")
def q_polymer_training(spark, sf_dir):
    return polymer_training(*_inputs(spark, sf_dir))


@query("polymer_lookup", oracle=_POLY + """
SELECT DISTINCT * FROM (
  SELECT SMILES, Tg, PID, Polymer_Class, NULL AS abr, NULL AS name, NULL AS grade, NULL AS manufacturer,
         NULL AS Density FROM raw_polymer_a
  UNION ALL
  SELECT SMILES, Tg, NULL, NULL, abr, name, grade, manufacturer, Density FROM raw_polymer_b)
""")
def q_polymer_lookup(spark, sf_dir):
    return polymer_lookup(*_inputs(spark, sf_dir))


@query("flexibility", oracle=_POLY + f"""
SELECT abr, {S.to_number('Tg')} AS Tg, {S.to_number('Density')} AS Density,
       CAST(CASE WHEN {S.to_number('Tg')} < 37 THEN 0.9 WHEN {S.to_number('Tg')} < 60 THEN 0.7
            WHEN {S.to_number('Tg')} < 100 THEN 0.4 ELSE 0.2 END AS DOUBLE) AS flexibility_score
FROM raw_polymer_b
""")
def q_flexibility(spark, sf_dir):
    return flexibility(raw_view(spark, sf_dir, "raw_polymer_b"))
