"""Unified materials job: names, standards, types, units, keep-first, union.

Plan shape: four narrow scans (parts, suppliers, customers, nations), each
projected once into the unified schema; the two small side sources are
deduplicated by a map-side-combined ``min_by``; one ``unionByName``.  The
material-type rule table is one generated CASE evaluated per row inside
codegen; no shuffle is spent on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.functions.rules import material_type, material_type_sql
from matfold.functions.text import (clean_name_basic, make_clean_name, normalize_name,
                                    normalize_whitespace, prefer_standard, surrogate_id,
                                    upper_strip)
from matfold.functions.parse import to_number
from matfold.functions.units import mpa_to_gpa, kgm3_to_gcm3, psi_to_mpa
from matfold.operators.agg import distinct_sample, null_counts
from matfold.operators.dedup import keep_first
from matfold.operators.filters import where_computed
from matfold.operators.joins import lookup_first
from matfold.operators.setops import stack
from matfold.plans import sqlfrag as S
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view
from matfold.sources.tables import read_table

UNIFIED_COLUMNS = [
    "Material_ID", "Material_Raw", "Material_Name", "Clean_Name", "Standard", "Material_Type",
    "Heat_treatment", "Tensile_Strength_MPa", "Yield_Strength_MPa", "Youngs_Modulus_GPa",
    "Shear_Modulus_GPa", "Poisson_Ratio", "Density_gcm3", "Elongation_percent",
    "Hardness_BHN", "Hardness_HV", "Notes",
]
# --- fixed values ---------------------------------------------------------
# Source-specific constants of the unified table.
HEA_STANDARD, HEA_TYPE, HEA_NOTE = "HEA", "HIGH_ENTROPY_ALLOY", "High Entropy Alloy: "
ALLOY_STANDARD, ALLOY_TYPE, ALLOY_NOTE = "ASTM", "ALLOY", "Alloy composition data"
ELEMENT_STANDARD, ELEMENT_TYPE = "ELEMENT", "METAL"
# --------------------------------------------------------------------------


def classify_names(df: DataFrame, name_col: str, out_col: str = "Material_Type") -> DataFrame:
    """Add the material type of ``name_col``, projected once per row."""
    return df.withColumn(out_col, material_type(name_col))


def prepare_main(raw: DataFrame) -> DataFrame:
    """Machine-design table -> unified schema (rename before the union).

    The clean name is projected first and the classifier reads the projected
    column, so the nested clean-name expression is computed once per row.
    """
    named = classify_names(raw.select("*", make_clean_name("Material").alias("_clean")), "_clean")
    return named.select(
        F.col("ID").alias("Material_ID"),
        F.col("Material").alias("Material_Raw"),
        F.col("_clean").alias("Material_Name"),
        F.col("_clean").alias("Clean_Name"),
        prefer_standard("Std", "Material").alias("Standard"),
        F.col("Material_Type"),
        F.col("Heat_treatment"),
        to_number("Su").alias("Tensile_Strength_MPa"),
        to_number("Sy").alias("Yield_Strength_MPa"),
        mpa_to_gpa(to_number("E")).alias("Youngs_Modulus_GPa"),
        mpa_to_gpa(to_number("G")).alias("Shear_Modulus_GPa"),
        to_number("mu").alias("Poisson_Ratio"),
        kgm3_to_gcm3(to_number("Ro")).alias("Density_gcm3"),
        to_number("A5").alias("Elongation_percent"),
        to_number("Bhn").alias("Hardness_BHN"),
        to_number("HV").alias("Hardness_HV"),
        F.col("Desc_text").alias("Notes"),
        F.lit(0).alias("_src"), F.col("ord").alias("_ord"),
    )


def prepare_hea(raw: DataFrame) -> DataFrame:
    clean = make_clean_name("FORMULA")
    df = raw.select(
        surrogate_id(clean).alias("Material_ID"),
        F.col("FORMULA").alias("Material_Raw"),
        clean.alias("Material_Name"), clean.alias("Clean_Name"),
        F.lit(HEA_STANDARD).alias("Standard"), F.lit(HEA_TYPE).alias("Material_Type"),
        F.col("Processing").alias("Heat_treatment"),
        to_number("UTS").alias("Tensile_Strength_MPa"),
        to_number("YS").alias("Yield_Strength_MPa"),
        to_number("Modulus").alias("Youngs_Modulus_GPa"),
        to_number("HV").alias("Hardness_HV"),
        to_number("Elongation").alias("Elongation_percent"),
        to_number("Density").alias("Density_gcm3"),
        F.concat(F.lit(HEA_NOTE), F.coalesce("Microstructure", F.lit(""))).alias("Notes"),
        F.lit(1).alias("_src"), F.col("ord").alias("_ord"),
    )
    return keep_first(df, ["Material_Name"], ["_ord"])


def prepare_alloys(raw: DataFrame) -> DataFrame:
    clean = make_clean_name("Alloy")
    df = raw.select(
        surrogate_id(clean).alias("Material_ID"),
        F.col("Alloy").alias("Material_Raw"),
        clean.alias("Material_Name"), clean.alias("Clean_Name"),
        F.lit(ALLOY_STANDARD).alias("Standard"), F.lit(ALLOY_TYPE).alias("Material_Type"),
        psi_to_mpa(to_number("UTS_psi")).alias("Tensile_Strength_MPa"),
        F.lit(ALLOY_NOTE).alias("Notes"),
        F.lit(2).alias("_src"), F.col("ord").alias("_ord"),
    )
    return keep_first(df, ["Material_Name"], ["_ord"])


def prepare_elements(nation: DataFrame) -> DataFrame:
    """Element moduli table (derived from the nation table)."""
    raw = nation.select(F.concat(F.lit("Metal "), F.col("n_name")).alias("Metal"),
                        (F.lit(40.0) + F.col("n_nationkey") * 5.0).alias("E_GPa"),
                        F.col("n_nationkey").cast("long").alias("ord"))
    clean = make_clean_name("Metal")
    df = raw.select(
        surrogate_id(clean).alias("Material_ID"),
        F.col("Metal").alias("Material_Raw"),
        clean.alias("Material_Name"), clean.alias("Clean_Name"),
        F.lit(ELEMENT_STANDARD).alias("Standard"), F.lit(ELEMENT_TYPE).alias("Material_Type"),
        F.col("E_GPa").alias("Youngs_Modulus_GPa"),
        F.lit(3).alias("_src"), F.col("ord").alias("_ord"),
    )
    return keep_first(df, ["Material_Name"], ["_ord"])


def unified_materials(spark: SparkSession, sf_dir: str, keep_order: bool = False) -> DataFrame:
    parts = [prepare_main(raw_view(spark, sf_dir, "raw_material")),
             prepare_hea(raw_view(spark, sf_dir, "raw_hea")),
             prepare_alloys(raw_view(spark, sf_dir, "raw_alloy")),
             prepare_elements(read_table(spark, sf_dir, "nation"))]
    df = stack(parts)
    cols = UNIFIED_COLUMNS + (["_src", "_ord"] if keep_order else [])
    return df.select(*cols)


# ---------------------------------------------------------------- queries

def _unified_sql() -> str:
    m = "Material"
    clean = S.clean_name(m)
    main = f"""
  SELECT ID AS Material_ID, Material AS Material_Raw, {clean} AS Material_Name, {clean} AS Clean_Name,
         {S.prefer_standard('Std', 'Material')} AS Standard,
         {material_type_sql(clean)} AS Material_Type,
         Heat_treatment,
         {S.to_number('Su')} AS Tensile_Strength_MPa, {S.to_number('Sy')} AS Yield_Strength_MPa,
         {S.to_number('E')} / 1000.0 AS Youngs_Modulus_GPa, {S.to_number('G')} / 1000.0 AS Shear_Modulus_GPa,
         {S.to_number('mu')} AS Poisson_Ratio, {S.to_number('Ro')} / 1000.0 AS Density_gcm3,
         {S.to_number('A5')} AS Elongation_percent, {S.to_number('Bhn')} AS Hardness_BHN,
         {S.to_number('HV')} AS Hardness_HV, Desc_text AS Notes, 0 AS _src, ord AS _ord
  FROM raw_material"""
    hc = S.clean_name("FORMULA")
    hea = f"""
  SELECT upper(md5({hc})) AS Material_ID, FORMULA AS Material_Raw, {hc} AS Material_Name, {hc} AS Clean_Name,
         'HEA' AS Standard, 'HIGH_ENTROPY_ALLOY' AS Material_Type, Processing AS Heat_treatment,
         {S.to_number('UTS')} AS Tensile_Strength_MPa, {S.to_number('YS')} AS Yield_Strength_MPa,
         {S.to_number('Modulus')} AS Youngs_Modulus_GPa, NULL::DOUBLE AS Shear_Modulus_GPa,
         NULL::DOUBLE AS Poisson_Ratio, {S.to_number('Density')} AS Density_gcm3,
         {S.to_number('Elongation')} AS Elongation_percent, NULL::DOUBLE AS Hardness_BHN,
         {S.to_number('HV')} AS Hardness_HV,
         'High Entropy Alloy: ' || coalesce(Microstructure, '') AS Notes, 1 AS _src, ord AS _ord
  FROM raw_hea
  QUALIFY row_number() OVER (PARTITION BY {hc} ORDER BY ord) = 1"""
    ac = S.clean_name("Alloy")
    alloy = f"""
  SELECT upper(md5({ac})) AS Material_ID, Alloy AS Material_Raw, {ac} AS Material_Name, {ac} AS Clean_Name,
         'ASTM' AS Standard, 'ALLOY' AS Material_Type, NULL AS Heat_treatment,
         {S.to_number('UTS_psi')} * 0.00689476 AS Tensile_Strength_MPa, NULL::DOUBLE AS Yield_Strength_MPa,
         NULL::DOUBLE AS Youngs_Modulus_GPa, NULL::DOUBLE AS Shear_Modulus_GPa, NULL::DOUBLE AS Poisson_Ratio,
         NULL::DOUBLE AS Density_gcm3, NULL::DOUBLE AS Elongation_percent, NULL::DOUBLE AS Hardness_BHN,
         NULL::DOUBLE AS Hardness_HV, 'Alloy composition data' AS Notes, 2 AS _src, ord AS _ord
  FROM raw_alloy
  QUALIFY row_number() OVER (PARTITION BY {ac} ORDER BY ord) = 1"""
    ec = S.clean_name("'Metal ' || n_name")
    elem = f"""
  SELECT upper(md5({ec})) AS Material_ID, 'Metal ' || n_name AS Material_Raw, {ec} AS Material_Name,
         {ec} AS Clean_Name, 'ELEMENT' AS Standard, 'METAL' AS Material_Type, NULL AS Heat_treatment,
         NULL::DOUBLE AS Tensile_Strength_MPa, NULL::DOUBLE AS Yield_Strength_MPa,
         40.0 + n_nationkey * 5.0 AS Youngs_Modulus_GPa, NULL::DOUBLE AS Shear_Modulus_GPa,
         NULL::DOUBLE AS Poisson_Ratio, NULL::DOUBLE AS Density_gcm3, NULL::DOUBLE AS Elongation_percent,
         NULL::DOUBLE AS Hardness_BHN, NULL::DOUBLE AS Hardness_HV, NULL AS Notes, 3 AS _src,
         CAST(n_nationkey AS BIGINT) AS _ord
  FROM nation
  QUALIFY row_number() OVER (PARTITION BY {ec} ORDER BY n_nationkey) = 1"""
    return (duck_cte("raw_material", "raw_hea", "raw_alloy")
            + f", unified AS ({main}\n  UNION ALL BY NAME {hea}\n  UNION ALL BY NAME {alloy}"
            + f"\n  UNION ALL BY NAME {elem})\n")


UNIFIED_SQL = _unified_sql()
_UCOLS = ", ".join(UNIFIED_COLUMNS)


def _r(c: str) -> str:
    return f"round({c}, 6) AS {c}"


_ROUNDED = [c for c in UNIFIED_COLUMNS if c.endswith(("_MPa", "_GPa", "_Ratio", "_gcm3", "_percent",
                                                       "_BHN", "_HV"))]


def _round_spark(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in df.columns])


@query("unified_materials", oracle=UNIFIED_SQL + "SELECT " + ", ".join(
    _r(c) if c in _ROUNDED else c for c in UNIFIED_COLUMNS) + " FROM unified")
def q_unified_materials(spark, sf_dir):
    return _round_spark(unified_materials(spark, sf_dir))


@query("missing_report", oracle=UNIFIED_SQL + f"""
SELECT "column", CAST(missing AS BIGINT) AS missing FROM (
  UNPIVOT (SELECT {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in UNIFIED_COLUMNS)}
           FROM unified)
  ON {_UCOLS} INTO NAME "column" VALUE missing)
""")
def q_missing_report(spark, sf_dir):
    rep = null_counts(unified_materials(spark, sf_dir))
    return rep.orderBy(F.desc("missing"), F.asc("column"))


@query("unmatched_types", oracle=UNIFIED_SQL + """
SELECT Material_ID, Material_Raw, Clean_Name FROM unified WHERE Material_Type = 'UNKNOWN'
""")
def q_unmatched_types(spark, sf_dir):
    u = unified_materials(spark, sf_dir)
    return where_computed(u.select("Material_ID", "Material_Raw", "Clean_Name", "Material_Type"),
                          F.col("Material_Type") == "UNKNOWN").drop("Material_Type")


@query("type_summary", oracle=UNIFIED_SQL + """
SELECT Material_Type, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT Standard) AS BIGINT) AS n_standards,
       min(Clean_Name) AS first_name
FROM unified GROUP BY Material_Type
""")
def q_type_summary(spark, sf_dir):
    u = unified_materials(spark, sf_dir)
    return u.groupBy("Material_Type").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_distinct("Standard").cast("long").alias("n_standards"),
        F.min("Clean_Name").alias("first_name"))


def material_index(unified: DataFrame) -> DataFrame:
    """Clean_Name -> Material_ID, first encounter in table order."""
    return keep_first(unified.select("Material_ID", "Clean_Name", "Material_Raw", "_src", "_ord"),
                      ["Clean_Name"], ["_src", "_ord"]).select("Material_ID", "Clean_Name", "Material_Raw")


_INDEX_SQL = UNIFIED_SQL + """, idx AS (
  SELECT Material_ID, Clean_Name, Material_Raw FROM unified
  QUALIFY row_number() OVER (PARTITION BY Clean_Name ORDER BY _src, _ord) = 1)
"""


@query("material_index", oracle=_INDEX_SQL + "SELECT * FROM idx")
def q_material_index(spark, sf_dir):
    return material_index(unified_materials(spark, sf_dir, keep_order=True))


@query("match_to_master", oracle=_INDEX_SQL.replace("WITH ", duck_cte("raw_corrosion")[:-1] + ",\n", 1) + f"""
, names AS (SELECT DISTINCT Material FROM raw_corrosion)
SELECT n.Material, coalesce(i.Material_ID, '') AS Material_ID
FROM names n LEFT JOIN idx i ON {S.clean_name('n.Material')} = i.Clean_Name
""")
def q_match_to_master(spark, sf_dir):
    idx = material_index(unified_materials(spark, sf_dir, keep_order=True))
    names = raw_view(spark, sf_dir, "raw_corrosion").select("Material").distinct()
    return lookup_first(names, idx, make_clean_name("Material"), "Clean_Name", "Material_ID",
                        default="").select("Material", "Material_ID")


# Name-normalisation queries over the raw material table.
_NAMES_SRC = duck_cte("raw_material")


@query("clean_names", oracle=_NAMES_SRC + f"""
SELECT ord, Material, {S.clean_name('Material')} AS Clean_Name, {S.clean_basic('Material')} AS Clean_Basic,
       {S.strip("regexp_replace(coalesce(Material, ''), '\\s+', ' ', 'g')")} AS Whitespace_Normalized
FROM raw_material
""")
def q_clean_names(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_material")
    return r.select("ord", "Material", make_clean_name("Material").alias("Clean_Name"),
                    clean_name_basic("Material").alias("Clean_Basic"),
                    normalize_whitespace("Material").alias("Whitespace_Normalized"))


@query("normalized_names", oracle=_NAMES_SRC + f"""
SELECT ord, {S.norm_name('Material')} AS Name_norm, upper({S.strip('Std')}) AS Std_upper,
       {S.norm_name('Std')} AS Std_norm
FROM raw_material
""")
def q_normalized_names(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_material")
    return r.select("ord", normalize_name("Material").alias("Name_norm"),
                    upper_strip("Std").alias("Std_upper"), normalize_name("Std").alias("Std_norm"))


@query("standard_pref", oracle=_NAMES_SRC + f"""
SELECT ord, Std, Material, {S.prefer_standard('Std', 'Material')} AS Standard FROM raw_material
""")
def q_standard_pref(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_material")
    return r.select("ord", "Std", "Material", prefer_standard("Std", "Material").alias("Standard"))


@query("material_type", oracle=_NAMES_SRC + f"""
SELECT ord, Material, {material_type_sql(S.clean_name('Material'))} AS Material_Type,
       {material_type_sql('Material')} AS Raw_Type
FROM raw_material
""")
def q_material_type(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_material").select("*", make_clean_name("Material").alias("_clean"))
    return r.select("ord", "Material", material_type("_clean").alias("Material_Type"),
                    material_type("Material").alias("Raw_Type"))


@query("standard_sample", oracle=UNIFIED_SQL + """
SELECT DISTINCT Standard AS value FROM unified WHERE Standard IS NOT NULL ORDER BY value LIMIT 10
""")
def q_standard_sample(spark, sf_dir):
    """Summary sample: the ten smallest distinct standards (distributed top-k)."""
    return distinct_sample(unified_materials(spark, sf_dir), "Standard", 10)


@query("distinct_counts", oracle=UNIFIED_SQL + """
SELECT CAST(count(DISTINCT Standard) AS BIGINT) AS n_standards,
       CAST(count(DISTINCT Material_Type) AS BIGINT) AS n_types, CAST(count(*) AS BIGINT) AS n_rows
FROM unified
""")
def q_distinct_counts(spark, sf_dir):
    u = unified_materials(spark, sf_dir)
    return u.agg(F.count_distinct("Standard").cast("long").alias("n_standards"),
                 F.count_distinct("Material_Type").cast("long").alias("n_types"),
                 F.count(F.lit(1)).cast("long").alias("n_rows"))
