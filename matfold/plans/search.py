"""Search queries: filter specs over the driver tables and the unified table.

Every search is one ``where`` built from a spec; projections and ordered
limits come last, so Spark reads only the needed columns and pushes the
simple comparisons into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.functions.parse import strip_suffix_int, to_number
from matfold.functions.text import concat_blank, is_blank, py_strip
from matfold.operators.filters import apply_filters, option_values, rule_label, where_equal
from matfold.operators.schema import select_present
from matfold.operators.setops import stack, union_distinct
from matfold.plans import sqlfrag as S
from matfold.plans.assays import _RECORDS_SQL, load_records
from matfold.plans.corrosion import with_rate_numeric
from matfold.plans.materials import UNIFIED_SQL, unified_materials
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view
from matfold.sources.tables import read_table

# --- fixed values ---------------------------------------------------------
# Inclusive ranges of the suitability rule on machine-design materials.
USE_RULE = {"Su": (336, 505), "Sy": (251, 376), "E": (165000, 248000),
            "G": (63000, 94000), "mu": (0.24, 0.36), "Ro": (6200, 9400)}
# Reference moduli (GPa) shown next to a computed value.
REFERENCE_MODULI = [("Steel", 200.0), ("Aluminum", 70.0), ("Titanium", 116.0),
                    ("Copper", 110.0), ("Polymer", 3.0)]
# Rows shown per local search.
RESULT_ROWS = 40
# --------------------------------------------------------------------------

RANGE_SPEC = {"p_retailprice": {"min": 920, "max": "960"}, "p_size": {"min": 10}}
VALUES_SPEC = {"c_mktsegment": {"values": ["BUILDING", "MACHINERY"]}, "c_nationkey": {"values": [1, 2, 3, 7]}}
CONTAINS_SPEC = {"p_name": "BOLT"}
COMBINED_SPEC = {"free_text": "promo", "p_retailprice": {"min": 950}, "p_name": "gear",
                 "p_brand": {"values": ["Brand#1", "Brand#2", "Brand#3", "Brand#13"]},
                 "no_such_column": {"min": 1}}
STRUCTURAL_SPEC = {"free_text": "grade", "Material_Type": {"values": ["STEEL", "ALLOY_STEEL", "CARBON_STEEL"]},
                   "Youngs_Modulus_GPa": {"min": 192.5}, "Tensile_Strength_MPa": {"min": "470"}}


# Search criteria of each domain: name -> (column, kind of rule).
CRITERIA = {
    "structural": {"family": ("Material_Type", "values"), "youngs_min": ("Youngs_Modulus_GPa", "min"),
                   "tensile_min": ("Tensile_Strength_MPa", "min")},
    "high_entropy": {},
    "corrosion": {"material_group": ("Material_Group", "values"), "temperature_min": ("Temperature_deg_C", "min"),
                  "rate_min": ("Rate_mm_numeric", "min")},
    "polymers": {"polymer_class": ("Polymer_Class", "values"), "name": ("name", "contains"), "tg_min": ("Tg", "min"),
                 "density_min": ("Density", "min"), "density_max": ("Density", "max")},
    "cytotoxicity": {"level": ("Cytotoxicity_Level", "values"), "cas": ("CAS", "values"), "name": ("Name", "contains"),
                     "cc50_min": ("CC50_mM", "min"), "cell_line": ("Cell_line", "values"),
                     "smiles": ("Canonical_SMILES", "contains")},
}


def search(df: DataFrame, spec: dict, **kw) -> DataFrame:
    out, _missing = apply_filters(df, spec, **kw)
    return out


def domain_spec(domain: str, free_text: str | None = None, **criteria) -> dict:
    """Filter spec of a domain's criteria; one that is None or empty is not set.

    A criterion ``<column>_min`` or ``<column>_max`` that the domain does not
    name bounds that column, so that any numeric column can be filtered.
    """
    spec: dict = {"free_text": free_text} if free_text else {}
    for key, value in criteria.items():
        if value is None or value == "" or value == []:
            continue
        column, kind = CRITERIA[domain].get(key) or (key[:-4], key[-3:])
        if kind in ("min", "max"):
            spec.setdefault(column, {})[kind] = value
        elif kind == "values":
            spec[column] = {"values": list(value) if isinstance(value, (list, tuple, set)) else [value]}
        elif kind == "contains":
            spec[column] = value
        else:
            raise ValueError(f"{domain} has no criterion {key!r}")
    return spec


def domain_search(df: DataFrame, domain: str, computed: bool = False, **criteria) -> tuple[DataFrame, list[str]]:
    """(rows of a domain's prepared table that meet all criteria, columns it lacks).

    ``computed``: the table's columns are parsed on the way, not read.
    """
    if domain == "cytotoxicity" and "Cytotoxicity_Level" in df.columns:
        level = F.lower(py_strip(F.col("Cytotoxicity_Level").cast("string")))
        df = df.withColumn("Cytotoxicity_Level", F.when(is_blank("Cytotoxicity_Level"), F.lit("unknown")).otherwise(level))
    return apply_filters(df, domain_spec(domain, **criteria), regex=False, computed=computed)


@query("search_range", oracle="""
SELECT * FROM part WHERE p_retailprice >= 920 AND p_retailprice <= 960 AND p_size >= 10
""")
def q_search_range(spark, sf_dir):
    return search(read_table(spark, sf_dir, "part"), RANGE_SPEC)


@query("search_values", oracle="""
SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND CAST(c_nationkey AS VARCHAR) IN ('1', '2', '3', '7')
""")
def q_search_values(spark, sf_dir):
    return search(read_table(spark, sf_dir, "customer"), VALUES_SPEC)


@query("search_text", oracle="""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE regexp_matches(text, 'eaux', 'i') OR regexp_matches(lang, 'eaux', 'i') OR regexp_matches(source, 'eaux', 'i')
""")
def q_search_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return search(docs, {"free_text": "eaux"}).select("doc_id", "lang", "source", "n_chars")


@query("search_contains", oracle="SELECT * FROM part WHERE regexp_matches(p_name, 'BOLT', 'i')")
def q_search_contains(spark, sf_dir):
    return search(read_table(spark, sf_dir, "part"), CONTAINS_SPEC)


@query("search_combined", oracle="""
SELECT * FROM part
WHERE (regexp_matches(p_name, 'promo', 'i') OR regexp_matches(p_brand, 'promo', 'i')
       OR regexp_matches(p_type, 'promo', 'i'))
  AND p_retailprice >= 950 AND regexp_matches(p_name, 'gear', 'i')
  AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#13')
""")
def q_search_combined(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    out, missing = apply_filters(part, COMBINED_SPEC)
    assert missing == ["no_such_column"], missing
    return out


@query("search_structural", oracle=UNIFIED_SQL + """
SELECT Material_Name, Material_Type, round(Youngs_Modulus_GPa, 6) AS Youngs_Modulus_GPa,
       round(Tensile_Strength_MPa, 6) AS Tensile_Strength_MPa
FROM unified
WHERE (regexp_matches(Material_ID, 'grade', 'i') OR regexp_matches(Material_Raw, 'grade', 'i')
       OR regexp_matches(Material_Name, 'grade', 'i') OR regexp_matches(Clean_Name, 'grade', 'i')
       OR regexp_matches(Standard, 'grade', 'i') OR regexp_matches(Material_Type, 'grade', 'i')
       OR regexp_matches(Heat_treatment, 'grade', 'i') OR regexp_matches(Notes, 'grade', 'i'))
  AND Material_Type IN ('STEEL', 'ALLOY_STEEL', 'CARBON_STEEL')
  AND Youngs_Modulus_GPa >= 192.5 AND Tensile_Strength_MPa >= 470
""")
def q_search_structural(spark, sf_dir):
    u, _ = apply_filters(unified_materials(spark, sf_dir), STRUCTURAL_SPEC, computed=True)
    return u.select("Material_Name", "Material_Type", F.round("Youngs_Modulus_GPa", 6).alias("Youngs_Modulus_GPa"),
                    F.round("Tensile_Strength_MPa", 6).alias("Tensile_Strength_MPa"))


def _rate_num_sql(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9.\\-]+', '', 'g')"
    return f"(CASE WHEN regexp_matches({s}, {S.q(S.NUMERIC_RE)}) THEN TRY_CAST({s} AS DOUBLE) END)"


@query("search_corrosion", oracle=duck_cte("raw_corrosion") + f"""
, r AS (SELECT *, {_rate_num_sql('Rate_mm')} AS Rate_mm_numeric FROM raw_corrosion)
SELECT ord_a, ord_b, ord_c, ord_d, Material, Environment, Rate_mm_numeric FROM r
WHERE (regexp_matches(Environment, 'water', 'i') OR regexp_matches(Material_Group, 'water', 'i')
       OR regexp_matches(Material_Family, 'water', 'i') OR regexp_matches(Material, 'water', 'i')
       OR regexp_matches(Rate_mm, 'water', 'i') OR regexp_matches(Rate_mils, 'water', 'i')
       OR regexp_matches(UNS, 'water', 'i') OR regexp_matches(Temperature, 'water', 'i'))
  AND Rate_mm_numeric >= 0.1
""")
def q_search_corrosion(spark, sf_dir):
    table = with_rate_numeric(raw_view(spark, sf_dir, "raw_corrosion")).drop("Rate_mils_numeric")
    rate_col = next(c for c in table.columns if c.lower().startswith("rate") and c.endswith("numeric"))
    out = search(table, {"free_text": "water", rate_col: {"min": 0.1}})
    return out.select("ord_a", "ord_b", "ord_c", "ord_d", "Material", "Environment", rate_col)


@query("sql_where_limit", oracle="""
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3
ORDER BY c_custkey LIMIT 40
""")
def q_sql_where_limit(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    return where_equal(cust, ["c_custkey", "c_name", "c_acctbal"],
                       {"c_mktsegment": "BUILDING", "c_nationkey": 3}, limit=RESULT_ROWS,
                       order_by=["c_custkey"])


@query("distinct_values", oracle="""
SELECT DISTINCT CAST(p_type AS VARCHAR) AS value FROM part
WHERE p_type IS NOT NULL AND trim(p_type) <> '' AND lower(trim(p_type)) <> 'nan' ORDER BY value LIMIT 200
""")
def q_distinct_values(spark, sf_dir):
    return option_values(read_table(spark, sf_dir, "part"), "p_type", limit=200)


@query("union_distinct_results", oracle="""
SELECT DISTINCT * FROM (
  SELECT * FROM part WHERE regexp_matches(p_name, 'BOLT', 'i')
  UNION ALL
  SELECT * FROM part WHERE p_retailprice >= 920 AND p_retailprice <= 960 AND p_size >= 10)
""")
def q_union_distinct_results(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return union_distinct([search(part, CONTAINS_SPEC), search(part, RANGE_SPEC)])


@query("comparison_table", oracle=UNIFIED_SQL + """
SELECT 'Predicted' AS Material, round(avg(Youngs_Modulus_GPa), 6) AS Youngs_Modulus_GPa FROM unified
UNION ALL SELECT 'Steel', 200.0 UNION ALL SELECT 'Aluminum', 70.0 UNION ALL SELECT 'Titanium', 116.0
UNION ALL SELECT 'Copper', 110.0 UNION ALL SELECT 'Polymer', 3.0
""")
def q_comparison_table(spark, sf_dir):
    u = unified_materials(spark, sf_dir)
    pred = u.agg(F.round(F.avg("Youngs_Modulus_GPa"), 6).alias("Youngs_Modulus_GPa")) \
            .select(F.lit("Predicted").alias("Material"), "Youngs_Modulus_GPa")
    consts = spark.createDataFrame(REFERENCE_MODULI, "Material string, Youngs_Modulus_GPa double")
    return stack([pred, consts])


def _between_sql(x: str, lo, hi) -> str:
    return f"coalesce({x} BETWEEN {lo} AND {hi}, FALSE)"


@query("rule_label", oracle=duck_cte("raw_material") + f"""
, r AS (
  SELECT ord, concat_ws(' ', coalesce(Std, ''), coalesce(Material, ''), coalesce(Heat_treatment, '')) AS Material,
         CASE WHEN regexp_matches({S.strip("replace(Sy, ' max', '')")}, '^[-+]?\\d+$')
              THEN TRY_CAST({S.strip("replace(Sy, ' max', '')")} AS INTEGER) END AS Sy,
         {S.to_number('Su')} AS Su, {S.to_number('E')} AS E, {S.to_number('G')} AS G,
         {S.to_number('mu')} AS mu, {S.to_number('Ro')} AS Ro
  FROM raw_material)
SELECT ord, Material, Sy,
       CASE WHEN {' AND '.join(_between_sql(c, lo, hi) for c, (lo, hi) in USE_RULE.items())}
            THEN 'True' ELSE 'False' END AS Use
FROM r
""")
def q_rule_label(spark, sf_dir):
    raw = raw_view(spark, sf_dir, "raw_material")
    df = raw.select("ord", concat_blank("Std", "Material", "Heat_treatment").alias("Material"),
                    strip_suffix_int("Sy").alias("Sy"),
                    *[to_number(c).alias(c) for c in ("Su", "E", "G", "mu", "Ro")])
    return df.select("ord", "Material", "Sy", rule_label(USE_RULE).alias("Use"))


@query("select_present", oracle=duck_cte("raw_material") + """
SELECT ID, Material, Std FROM raw_material
""")
def q_select_present(spark, sf_dir):
    return select_present(raw_view(spark, sf_dir, "raw_material"), ["ID", "Material", "Missing_Col", "Std"])


# ------------------------------------------------- searches of the domains

def _has(text: str, *cols: str) -> str:
    """One of the columns contains the (lower-case, literal) text."""
    return "(" + " OR ".join(f"coalesce(strpos(lower({c}), '{text}') > 0, FALSE)" for c in cols) + ")"


@query("search_alloys", oracle=duck_cte("raw_hea") + f"""
, t AS (SELECT ord, FORMULA, Processing, Microstructure, {', '.join(f"{S.to_number(c)} AS {c}" for c in ('UTS', 'YS', 'HV', 'Density'))}
        FROM raw_hea)
SELECT * FROM t WHERE {_has('ti', 'FORMULA', 'Processing', 'Microstructure')} AND HV >= 250 AND Density <= 7.7
""")
def q_search_alloys(spark, sf_dir):
    raw = raw_view(spark, sf_dir, "raw_hea")
    table = raw.select("ord", "FORMULA", "Processing", "Microstructure",
                       *[to_number(c).alias(c) for c in ("UTS", "YS", "HV", "Density")])
    return domain_search(table, "high_entropy", free_text="Ti", HV_min=250, Density_max=7.7)[0]


@query("search_polymers", oracle=duck_cte("raw_polymer_b") + f"""
, t AS (SELECT ord, name, SMILES, grade, manufacturer, {S.to_number('Tg')} AS Tg, {S.to_number('Density')} AS Density
        FROM raw_polymer_b)
SELECT * FROM t WHERE {_has('brand#1', 'name', 'SMILES', 'grade', 'manufacturer')} AND {_has('poly-', 'name')}
  AND Tg >= 260 AND Density >= 0.95 AND Density <= 1.2
""")
def q_search_polymers(spark, sf_dir):
    table = raw_view(spark, sf_dir, "raw_polymer_b").select(
        "ord", "name", "SMILES", "grade", "manufacturer", to_number("Tg").alias("Tg"), to_number("Density").alias("Density"))
    return domain_search(table, "polymers", free_text="brand#1", name="poly-", tg_min=260, density_min=0.95, density_max=1.2)[0]


@query("search_polymer_class", oracle=duck_cte("raw_polymer_a") + f"""
, t AS (SELECT ord, SMILES, PID, Polymer_Class, {S.to_number('Tg')} AS Tg FROM raw_polymer_a)
SELECT * FROM t WHERE {_has('(=o)', 'SMILES', 'PID', 'Polymer_Class')} AND Polymer_Class = 'polyamide' AND Tg >= 300
""")
def q_search_polymer_class(spark, sf_dir):
    table = raw_view(spark, sf_dir, "raw_polymer_a").select("ord", "SMILES", "PID", "Polymer_Class", to_number("Tg").alias("Tg"))
    return domain_search(table, "polymers", free_text="(=O)", polymer_class="polyamide", tg_min=300)[0]


_LEVEL_SQL = ("CASE WHEN CC50_mM IS NULL THEN 'unknown' WHEN CC50_mM < 0.1 THEN 'high' "
              "WHEN CC50_mM < 1 THEN 'medium' ELSE 'low' END")


@query("search_cytotoxicity", oracle=_RECORDS_SQL + f"""
, t AS (SELECT ord, Name, CAS, Clean_Name, CC50_mM, Cell_line, Method, Canonical_SMILES,
               {_LEVEL_SQL} AS Cytotoxicity_Level FROM records)
SELECT ord, Name, Clean_Name, round(CC50_mM, 9) AS CC50_mM, Cytotoxicity_Level FROM t
WHERE {_has('assay', 'Name', 'CAS', 'Clean_Name', 'Cell_line', 'Method', 'Canonical_SMILES', 'Cytotoxicity_Level')}
  AND Cytotoxicity_Level IN ('low', 'medium') AND {_has('view', 'Name')} AND CC50_mM >= 0.2 AND Cell_line = 'HeLa'
  AND {_has('[n+]', 'Canonical_SMILES')}
""")
def q_search_cytotoxicity(spark, sf_dir):
    """The level column arrives in mixed spelling and with blanks; both are normalised before the search."""
    cc = F.col("CC50_mM")
    level = F.when(cc.isNull(), F.lit(" ")).when(cc < 0.1, F.lit("High")).when(cc < 1, F.lit(" MEDIUM")).otherwise(F.lit("low "))
    table = load_records(spark, sf_dir).select("ord", "Name", "CAS", "Clean_Name", "CC50_mM", "Cell_line", "Method",
                                               "Canonical_SMILES", level.alias("Cytotoxicity_Level"))
    out, _ = domain_search(table, "cytotoxicity", computed=True, free_text="assay", level=["low", "medium"], name="view", cc50_min=0.2,
                           cell_line="HeLa", smiles="[N+]")
    return out.select("ord", "Name", "Clean_Name", F.round("CC50_mM", 9).alias("CC50_mM"), "Cytotoxicity_Level")


@query("search_corrosion_group", oracle=duck_cte("raw_corrosion") + f"""
, t AS (SELECT *, {_rate_num_sql('Rate_mm')} AS Rate_mm_numeric, {S.to_number('Temperature')} AS Temperature_deg_C FROM raw_corrosion)
SELECT ord_a, ord_b, ord_c, ord_d, Material_Group, Rate_mm_numeric, Temperature_deg_C FROM t
WHERE Material_Group IN ('PROMO', 'ECONOMY') AND Temperature_deg_C >= 20 AND Rate_mm_numeric >= 0.05
""")
def q_search_corrosion_group(spark, sf_dir):
    table = with_rate_numeric(raw_view(spark, sf_dir, "raw_corrosion")).withColumn("Temperature_deg_C", to_number("Temperature"))
    out, _ = domain_search(table, "corrosion", material_group=["PROMO", "ECONOMY"], temperature_min=20, rate_min=0.05)
    return out.select("ord_a", "ord_b", "ord_c", "ord_d", "Material_Group", "Rate_mm_numeric", "Temperature_deg_C")
