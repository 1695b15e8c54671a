"""Feature preparation, splits, metrics and small scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matfold.functions.atlas import ONTOLOGY_IDS, ORGAN_FOLDERS, ORGAN_IDS, model_url, ontology_id, organ_id, side
from matfold.functions.chem import AMINO_ACIDS, clean_placeholders, first_component, structure_problem, letter_frequencies
from matfold.functions.parse import extract_float
from matfold.functions.score import inverse_log10, log10_target, modulus_band, toxic_flag
from matfold.functions.text import level_norm
from matfold.operators.prep import (alphabetical_codes, auc, class_weights, classification_report,
                                    decode_labels, display_bounds, first_appearance_codes, fit_means,
                                    fit_standard, hash_split, impute, out_of_range, regression_metrics,
                                    standardize, stratified_split, unstandardize)
from matfold.plans import sqlfrag as S
from matfold.plans.assays import _RECORDS_SQL, _extract_float_sql, load_records
from matfold.plans.materials import UNIFIED_SQL, unified_materials
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view
from matfold.sources.tables import read_table, spark_sql

# --- fixed values ---------------------------------------------------------
# Training ranges of the structure-feature model (inclusive).
TRAINING_RANGES = {
    "Number_of_Residues": (50, 1000),
    "Number_of_Chains": (1, 12),
    "Helix": (0, 1500),
    "Sheet": (0, 500),
    "Coil": (0, 2000),
    "Molecular_Weight_per_Deposited_Model": (5000, 200000),
}
# --------------------------------------------------------------------------

_LI_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("standardize", oracle=f"""
SELECT {', '.join(_KEYS)},
  {', '.join(f"round((({c}) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
             for c in _LI_COLS)}
FROM lineitem
""")
def q_standardize(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(*_KEYS, *_LI_COLS)
    z = standardize(li, fit_standard(li, _LI_COLS))
    return z.select(*_KEYS, *[F.round(c, 6).alias(c) for c in _LI_COLS])


_NUMS = ["Tensile_Strength_MPa", "Yield_Strength_MPa", "Elongation_percent", "Hardness_BHN", "Hardness_HV"]


@query("impute_mean", oracle=UNIFIED_SQL + f"""
SELECT Material_ID, Material_Name,
  {', '.join(f"round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}" for c in _NUMS)},
  round(coalesce(Shear_Modulus_GPa, 0.0), 6) AS Shear_Modulus_GPa
FROM unified
""")
def q_impute_mean(spark, sf_dir):
    u = unified_materials(spark, sf_dir).select("Material_ID", "Material_Name", *_NUMS, "Shear_Modulus_GPa")
    filled = impute(impute(u, fit_means(u, _NUMS)), {"Shear_Modulus_GPa": 0.0})
    return filled.select("Material_ID", "Material_Name",
                         *[F.round(c, 6).alias(c) for c in _NUMS + ["Shear_Modulus_GPa"]])


@query("target_scale", oracle="""
SELECT o_orderkey,
  round((o_totalprice - avg(o_totalprice) OVER ()) / coalesce(nullif(stddev_pop(o_totalprice) OVER (), 0), 1), 6) AS y_scaled,
  round(o_totalprice, 6) AS y_back
FROM orders
""")
def q_target_scale(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    (m, s), = fit_standard(o, ["o_totalprice"]).values()
    z = o.select("o_orderkey", ((F.col("o_totalprice") - m) / s).alias("y_scaled"))
    return z.select("o_orderkey", F.round("y_scaled", 6).alias("y_scaled"),
                    F.round(unstandardize("y_scaled", m, s), 6).alias("y_back"))


@query("feature_bounds", oracle="""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                  avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT 'l_quantity' AS feature, CAST(greatest(1, round(mq - 3 * sq)) AS DOUBLE) AS min_value,
       CAST(round(mq + 3 * sq) AS DOUBLE) AS max_value, CAST(round(mq) AS DOUBLE) AS default_value FROM s
UNION ALL
SELECT 'l_extendedprice', round(greatest(0.0, mp - 3 * sp), 4), round(mp + 3 * sp, 4), round(mp, 4) FROM s
""")
def q_feature_bounds(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    rows = display_bounds(fit_standard(li, ["l_quantity", "l_extendedprice"]), integer_cols=["l_quantity"])
    df = spark.createDataFrame(rows, "feature string, min_value double, max_value double, default_value double")
    return df.select("feature", *[F.when(F.col("feature") == "l_quantity", F.col(c)).otherwise(F.round(c, 4))
                                  .alias(c) for c in ("min_value", "max_value", "default_value")])


@query("label_encode", oracle="""
SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code, p_type AS decoded
FROM part
""")
def q_label_encode(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    coded, labels = alphabetical_codes(part, "p_type")
    return decode_labels(coded, "code", labels, "decoded")


@query("factorize_first", oracle="""
WITH f AS (SELECT event_type, min(event_id) AS fe FROM events GROUP BY event_type),
     c AS (SELECT event_type, CAST(row_number() OVER (ORDER BY fe, event_type) - 1 AS INTEGER) AS code FROM f)
SELECT e.event_id, e.event_type, c.code FROM events e JOIN c USING (event_type)
""")
def q_factorize_first(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return first_appearance_codes(ev, "event_type", "event_id")


_MD5_SQL = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '42'), 1, 8)) AS BIGINT)"


@query("hash_split", oracle=f"""
SELECT o_orderkey, CASE WHEN {_MD5_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM orders
""")
def q_hash_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return hash_split(o, "o_orderkey")


@query("stratified_split", oracle=f"""
SELECT o_orderkey, o_orderstatus,
  CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5_SQL}, o_orderkey)
            <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM orders
""")
def q_stratified_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return stratified_split(o, "o_orderkey", "o_orderstatus")


@query("class_weights", oracle="""
WITH c AS (SELECT quality, count(*) AS n_c FROM labels WHERE quality IS NOT NULL GROUP BY quality)
SELECT quality, CAST(n_c AS BIGINT) AS n_c,
       round((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c), 9) AS weight FROM c
""")
def q_class_weights(spark, sf_dir):
    w = class_weights(read_table(spark, sf_dir, "labels"), "quality")
    return w.withColumn("weight", F.round("weight", 9))


@query("regression_metrics", oracle="""
WITH t AS (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)
SELECT CAST(count(y) AS BIGINT) AS n,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2,
       round(avg(abs(y - p)), 6) AS mae FROM t
""")
def q_regression_metrics(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("p"))
    m = regression_metrics(li, "y", "p")
    return m.select("n", F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"))


@query("classification_report", oracle="""
WITH t AS (SELECT toxic AS y, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS p FROM labels),
  cls AS (SELECT y AS cls FROM t UNION SELECT p FROM t),
  m AS (SELECT c.cls,
          count(*) FILTER (WHERE t.y = c.cls AND t.p = c.cls) AS tp,
          count(*) FILTER (WHERE t.y = c.cls) AS support,
          count(*) FILTER (WHERE t.p = c.cls) AS predicted
        FROM cls c, t GROUP BY c.cls)
SELECT cls,
  round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END, 6) AS f1,
  CAST(support AS BIGINT) AS support,
  round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM t), 6) AS accuracy
FROM m
""")
def q_classification_report(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels").select(
        F.col("toxic").alias("y"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("p"))
    r = classification_report(lab, "y", "p")
    return r.select(F.col("cls").cast("int").alias("cls"),
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support",
                    F.round("accuracy", 6).alias("accuracy"))


@query("auc_rank", oracle="""
WITH t AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)),
  r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM t)
SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 9) AS auc,
       CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (WHERE y <> 1) AS BIGINT) AS n_neg
FROM r
""")
def q_auc_rank(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = auc(lab.join(docs, "doc_id"), "quality", "n_chars")
    return a.select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query("qsar_targets", oracle=_RECORDS_SQL + """
SELECT ord, round(CC50_mM, 9) AS CC50_mM,
       round(CASE WHEN CC50_mM > 0 THEN log10(CC50_mM) END, 9) AS log_cc50,
       CASE WHEN CC50_mM IS NOT NULL THEN CAST(CC50_mM < 1.0 AS INTEGER) END AS toxic_label,
       round(pow(10.0, CASE WHEN CC50_mM > 0 THEN log10(CC50_mM) END), 6) AS cc50_back
FROM records
""")
def q_qsar_targets(spark, sf_dir):
    r = load_records(spark, sf_dir)
    t = r.select("ord", "CC50_mM", log10_target("CC50_mM").alias("log_cc50"),
                 toxic_flag("CC50_mM").alias("toxic_label"))
    return t.select("ord", F.round("CC50_mM", 9).alias("CC50_mM"), F.round("log_cc50", 9).alias("log_cc50"),
                    "toxic_label", F.round(inverse_log10("log_cc50"), 6).alias("cc50_back"))


def qsar_ready(records, cell_lines, methods):
    """Modelling table: first structure component, loose concentration,
    rows with a concentration only, cell-line and method metadata joined, family from the file."""
    cl = cell_lines.select(F.col("Cell_name").alias("Cell_line"), "Cell_type")
    md = methods.select(F.col("Method_abbreviation").alias("Method"), F.col("Full_name").alias("Method_full"))
    base = records.select(
        "ord", "Name", "Cell_line", "Method",
        clean_placeholders(first_component("Canonical_SMILES")).alias("SMILES_main"),
        extract_float("CC50_raw").alias("CC50"),
        F.regexp_replace("source_file", r"\.csv$", "").alias("Family"))
    return (base.where(F.col("CC50").isNotNull())
                .join(cl, "Cell_line", "left").join(md, "Method", "left")
                .select("ord", "Name", "SMILES_main", F.round("CC50", 9).alias("CC50"), "Family",
                        "Cell_type", "Method_full"))


@query("qsar_ready", oracle=_RECORDS_SQL.replace("WITH raw_assay AS", "WITH methods AS (" + """
SELECT CASE r_regionkey WHEN 0 THEN 'MTT' WHEN 1 THEN 'WST-1 assay' WHEN 2 THEN 'LDH release'
                        WHEN 3 THEN 'neutral red uptake' ELSE 'SRB' END AS Method_abbreviation,
       'method of ' || r_name AS Full_name
FROM region), raw_assay AS""", 1) + f"""
, b AS (
  SELECT ord, Name, Cell_line, Method,
         replace(replace(split_part(split_part({S.strip('Canonical_SMILES')}, ';', 1), '.', 1), '*', ''), '()', '')
           AS SMILES_main,
         {_extract_float_sql('CC50_raw')} AS CC50,
         regexp_replace(source_file, '\\.csv$', '') AS Family
  FROM records)
SELECT b.ord, b.Name, b.SMILES_main, round(b.CC50, 9) AS CC50, b.Family, c.Cell_type, m.Full_name AS Method_full
FROM b LEFT JOIN cell_lines c ON b.Cell_line = c.Cell_name LEFT JOIN methods m ON b.Method = m.Method_abbreviation
WHERE b.CC50 IS NOT NULL
""")
def q_qsar_ready(spark, sf_dir):
    return qsar_ready(load_records(spark, sf_dir), raw_view(spark, sf_dir, "cell_lines"),
                      raw_view(spark, sf_dir, "methods"))


def _aa_sql(ch: str) -> str:
    return (f"round((length(t) - length(replace(replace(t, '{ch}', ''), '{ch.lower()}', ''))) "
            f"/ greatest(length(t), 1), 9) AS aa_{ch}")


@query("aa_composition", oracle=f"""
SELECT doc_id, {', '.join(_aa_sql(ch) for ch in AMINO_ACIDS)}
FROM (SELECT doc_id, replace(coalesce(text, ''), 'ß', 'SS') AS t FROM documents)
""")
def q_aa_composition(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    freq = docs.select("doc_id", *letter_frequencies("text"))
    return freq.select("doc_id", *[F.round(f"aa_{ch}", 9).alias(f"aa_{ch}") for ch in AMINO_ACIDS])


@query("has_flag", oracle="""
SELECT d.doc_id, CAST(l.doc_id IS NOT NULL AS INTEGER) AS has_label FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def q_has_flag(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l")).distinct()
    j = docs.join(lab, F.col("doc_id") == F.col("_l"), "left")
    return j.select("doc_id", F.col("_l").isNotNull().cast("int").alias("has_label"))


@query("modulus_band", oracle=UNIFIED_SQL + """
SELECT Material_ID, Youngs_Modulus_GPa,
  CASE WHEN Youngs_Modulus_GPa IS NULL THEN NULL
       WHEN Youngs_Modulus_GPa < 10 THEN 'soft polymeric or elastomeric material'
       WHEN Youngs_Modulus_GPa < 70 THEN 'light alloys or composites'
       WHEN Youngs_Modulus_GPa < 200 THEN 'strong metallic alloy'
       ELSE 'ceramic or high-stiffness material' END AS band
FROM unified
""")
def q_modulus_band(spark, sf_dir):
    u = unified_materials(spark, sf_dir)
    return u.select("Material_ID", "Youngs_Modulus_GPa", modulus_band("Youngs_Modulus_GPa").alias("band"))


@query("level_norm", oracle=duck_cte("raw_material") + f"""
SELECT ord, CASE WHEN {S.blank('Heat_treatment')} THEN 'unknown' ELSE lower({S.strip('Heat_treatment')}) END AS level,
       CASE WHEN {S.blank('Std')} THEN 'unknown' ELSE lower({S.strip('Std')}) END AS std_level
FROM raw_material
""")
def q_level_norm(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_material")
    return r.select("ord", level_norm("Heat_treatment").alias("level"), level_norm("Std").alias("std_level"))


# Branch depth by a running sum, ring labels by their parity: one row per part of each string.
_STRUCTURE_SQL = duck_cte("raw_assay") + f""",
base AS (SELECT ord, SMILES, {S.blank('SMILES')} AS blank, {S.strip('SMILES')} AS s,
                regexp_extract_all({S.strip('SMILES')}, '%[0-9][0-9]|\\[[^\\[\\]]*\\]|.') AS parts FROM raw_assay),
part AS (SELECT ord, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM base),
depths AS (SELECT ord, x, i, sum(CASE x WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY i) AS d FROM part),
branches AS (SELECT ord, min(d) < 0 OR arg_max(d, i) <> 0 AS bad_branch, bool_or(x IN ('[', ']', '[]')) AS bad_square FROM depths GROUP BY ord),
labels AS (SELECT ord, CASE WHEN x = '%' THEN -1 ELSE CAST(ltrim(x, '%') AS INTEGER) END AS label, count(*) AS n
           FROM part WHERE regexp_matches(x, '^[0-9]$|^%') GROUP BY ALL),
rings AS (SELECT ord, bool_or(n % 2 = 1) AS bad_ring FROM labels GROUP BY ord),
problems AS (
  SELECT ord, SMILES, CASE WHEN blank THEN 'blank'
    WHEN NOT regexp_matches(s, '^[A-Za-z0-9@+\\-\\[\\]\\(\\)=#$:/\\\\%.*]+$') THEN 'illegal character'
    WHEN bad_branch THEN 'unbalanced parentheses' WHEN bad_square THEN 'unbalanced brackets'
    WHEN bad_ring THEN 'unpaired ring closure' END AS problem
  FROM base LEFT JOIN branches USING (ord) LEFT JOIN rings USING (ord))
"""


@query("structure_valid", oracle=_STRUCTURE_SQL + "SELECT ord, SMILES, problem FROM problems")
def q_structure_valid(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_assay")
    return r.select("ord", "SMILES", structure_problem("SMILES").alias("problem"))


_MUTATED = """CASE ord % 11 WHEN 0 THEN ')' || SMILES || '(' WHEN 1 THEN 'C]' || SMILES || 'C[' WHEN 2 THEN 'C%12CC%21' || SMILES
  WHEN 3 THEN 'C%12CC%12' || SMILES WHEN 4 THEN SMILES || '%1' WHEN 5 THEN 'C1CC1(' || SMILES || ')' WHEN 6 THEN '[C@H2](1)' || SMILES
  WHEN 7 THEN 'C12CC1C2' || SMILES WHEN 8 THEN '[]' || SMILES WHEN 9 THEN 'C%10%11C%11%10' || SMILES ELSE 'C0' || SMILES || 'C0' END"""


@query("structure_syntax", oracle=_STRUCTURE_SQL.replace("base AS (", f"mutated AS (SELECT ord, {_MUTATED} AS SMILES FROM raw_assay),\nbase AS (", 1)
       .replace("AS parts FROM raw_assay", "AS parts FROM mutated") + "SELECT ord, SMILES, problem FROM problems")
def q_structure_syntax(spark, sf_dir):
    """Every structure string with a syntax fault or a legal oddity written into it."""
    r = raw_view(spark, sf_dir, "raw_assay").select("ord", F.expr(_MUTATED).alias("SMILES"))
    return r.select("ord", "SMILES", structure_problem("SMILES").alias("problem"))


@query("structure_summary", oracle=_STRUCTURE_SQL + """
SELECT coalesce(problem, 'valid') AS status, CAST(count(*) AS BIGINT) AS n, min(ord) AS example_ord
FROM problems GROUP BY 1
""")
def q_structure_summary(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_assay").select("ord", structure_problem("SMILES").alias("problem"))
    return r.groupBy(F.coalesce("problem", F.lit("valid")).alias("status")).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.min("ord").alias("example_ord"))


@query("label_map", oracle="""
SELECT c.c_custkey, r.r_name || ' / ' || n.n_name || ' / ' || c.c_name AS label,
       'https://atlas.example.org/' || lower(r.r_name) || '/' || CAST(n.n_nationkey AS VARCHAR) || '/'
         || CAST(c.c_custkey AS VARCHAR) AS url,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def q_label_map(spark, sf_dir):
    """Label and link building per item by joins with the two lookup dimensions."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nat = read_table(spark, sf_dir, "nation")
    reg = read_table(spark, sf_dir, "region")
    j = cust.join(nat, cust.c_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
    return j.select("c_custkey", F.concat_ws(" / ", "r_name", "n_name", "c_name").alias("label"),
                    F.format_string("https://atlas.example.org/%s/%d/%d", F.lower("r_name"), "n_nationkey",
                                    "c_custkey").alias("url"),
                    F.when(F.col("c_custkey") % 2 == 0, "left").otherwise("right").alias("side"))


_ORGAN_LABELS = [*ORGAN_IDS, "Spleen", "Leftover Right"]
_ORGAN_LABEL = "CASE c_custkey % " + str(len(_ORGAN_LABELS) + 1) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ORGAN_LABELS)) + " END"
_FOLDER_IDS = [*ORGAN_FOLDERS, "femur-left"]
_FOLDER_ID = "CASE c_custkey % " + str(len(_FOLDER_IDS)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FOLDER_IDS)) + " END"


def _values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ") AS m(k, v)"


@query("organ_map", oracle=f"""
WITH c AS (SELECT c_custkey, {_ORGAN_LABEL} AS label, {_FOLDER_ID} AS organ, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer)
SELECT c_custkey, label, (SELECT v FROM {_values(ORGAN_IDS)} WHERE k = label) AS organ_id,
  (SELECT v FROM {_values(ONTOLOGY_IDS)} WHERE k = label) AS ontology_id,
  CASE WHEN label LIKE '%Left%' THEN 'left' WHEN label LIKE '%Right%' THEN 'right' ELSE 'none' END AS side,
  'https://atlas.example.org/' || (SELECT v FROM {_values(ORGAN_FOLDERS)} WHERE k = organ) || '/3d-vh-' || sex || '-' || organ || '.glb' AS url
FROM c
""")
def q_organ_map(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(_ORGAN_LABEL).alias("label"), F.expr(_FOLDER_ID).alias("organ"), F.expr("IF(c_custkey % 2 = 0, 'male', 'female')").alias("sex"))
    return c.select("c_custkey", "label", organ_id("label").alias("organ_id"), ontology_id("label").alias("ontology_id"), side("label").alias("side"),
                    model_url("organ", "sex", "https://atlas.example.org").alias("url"))


_PROTEIN = """
SELECT doc_id,
  CAST(n_chars % 1200 AS DOUBLE) AS Number_of_Residues,
  CAST(doc_id % 14 AS DOUBLE) AS Number_of_Chains,
  CAST((n_chars * 7) % 1600 AS DOUBLE) AS Helix,
  CAST((n_chars * 3) % 600 AS DOUBLE) AS Sheet,
  CAST((n_chars * 11) % 2100 AS DOUBLE) AS Coil,
  CAST((n_chars % 1200) * 110 AS DOUBLE) AS Molecular_Weight_per_Deposited_Model
FROM {documents}
"""


@query("range_violations", oracle="WITH p AS (" + _PROTEIN.format(documents="documents") + """)
SELECT doc_id, feature, value, min, max FROM (
  UNPIVOT p ON Number_of_Residues, Number_of_Chains, Helix, Sheet, Coil, Molecular_Weight_per_Deposited_Model
  INTO NAME feature VALUE value) u
JOIN (VALUES """ + ", ".join(f"('{k}', {float(a)}, {float(b)})" for k, (a, b) in TRAINING_RANGES.items()) + """)
  AS b(feature, min, max) USING (feature)
WHERE value < min OR value > max
""")
def q_range_violations(spark, sf_dir):
    p = spark_sql(spark, sf_dir, _PROTEIN)
    return out_of_range(p, "doc_id", TRAINING_RANGES)
