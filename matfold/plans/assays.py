"""Assay measurements -> identity map, human flag, labels, compound features.

Plan shape: one scan of the assay records with a single projection of all
per-record parsing; the human-cell flag joins the distinct cell-line texts to
the names they contain; labels and compound features are single aggregates whose
conditional parts are ``when`` expressions inside the aggregate (no second
pass, no join back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.functions.chem import formula_weight
from matfold.functions.parse import extract_float, parse_cc50, to_number
from matfold.functions.score import (cell_line_weight, composite_score, label_from_cc50,
                                     method_weight, toxicity_score)
from matfold.functions.text import clean_name_basic, is_blank, make_clean_name, py_strip
from matfold.operators.agg import conditional_min, coverage_percent, grouped_medians
from matfold.operators.dedup import keep_first
from matfold.operators.joins import contains_any
from matfold.plans import sqlfrag as S
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view

# --- fixed values ---------------------------------------------------------
# Organism text marking a human cell line (lower-cased substring test).
HUMAN_ORGANISM_WORDS = ["human", "homo sapiens"]
# Descriptors read as input columns (molecular weight comes from the formula).
INPUT_DESCRIPTORS = ["LogP", "TPSA", "HBD", "HBA", "AromaticRings"]
# --------------------------------------------------------------------------


def _s(c: str):
    return F.coalesce(py_strip(F.col(c)), F.lit(""))


def assay_records(raw: DataFrame) -> DataFrame:
    """Parsed measurement rows; rows with a blank name are skipped."""
    return (raw.where(~is_blank("Name"))
               .select("ord", "source_file",
                       py_strip("Name").alias("Name"),
                       _s("CAS").alias("CAS"),
                       make_clean_name("Name").alias("Clean_Name"),
                       _s("CC50").alias("CC50_raw"),
                       parse_cc50("CC50").alias("CC50_mM"),
                       _s("Cell_line").alias("Cell_line"),
                       _s("Method").alias("Method"),
                       _s("Mw").alias("Mw"),
                       _s("SMILES").alias("Canonical_SMILES"),
                       F.col("Empirical_formula"),
                       *[F.col(c) for c in INPUT_DESCRIPTORS if c in raw.columns]))


def human_cells(cell_lines: DataFrame) -> DataFrame:
    org = F.lower(F.coalesce(F.col("Organism"), F.lit("")))
    cond = F.lit(False)
    for w in HUMAN_ORGANISM_WORDS:
        cond = cond | (F.instr(org, w) > 0)
    return cell_lines.where(cond).select("Cell_name")


def flag_human(records: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Is_Human_Cell: cell line text contains a human cell name; all True
    when no human names are known."""
    return contains_any(records, "Cell_line", human_cells(cell_lines), "Cell_name",
                        flag="Is_Human_Cell", empty_means=True)


def material_labels(flagged: DataFrame) -> DataFrame:
    g = flagged.groupBy("Clean_Name").agg(
        conditional_min("CC50_mM", "Is_Human_Cell").alias("min_CC50_mM_on_human"),
        F.count(F.lit(1)).cast("long").alias("num_measurements"),
        F.count_if("Is_Human_Cell").cast("long").alias("num_human_measurements"))
    return g.select("Clean_Name", "min_CC50_mM_on_human",
                    label_from_cc50("min_CC50_mM_on_human").alias("biocompatibility_label"),
                    "num_measurements", "num_human_measurements")


def compound_features(records: DataFrame) -> DataFrame:
    """Per structure string: worst CC50, first name, sources, descriptor medians.

    Molecular weight comes from the formula; the other descriptors are read as
    input columns, and one that the table does not have is null.  The medians are
    found by counts per range of values (``grouped_medians``), as the blank
    structure string alone may hold a third of the rows.
    """
    given = [to_number(c).alias(c) if c in records.columns else F.lit(None).cast("double").alias(c)
             for c in INPUT_DESCRIPTORS]
    medians = ["MolWt", *INPUT_DESCRIPTORS]
    rows = records.select("Canonical_SMILES", "CC50_mM", "Name", "ord", "source_file",
                          formula_weight("Empirical_formula").alias("MolWt"), *given)
    g = rows.groupBy("Canonical_SMILES").agg(
        F.min("CC50_mM").alias("CC50_mM"),
        F.min_by("Name", "ord").alias("Name"),
        F.count_distinct("source_file").cast("long").alias("num_sources"))
    m = grouped_medians(rows.select("Canonical_SMILES", *medians), "Canonical_SMILES", medians).withColumnRenamed("Canonical_SMILES", "_structure")
    return g.join(m, F.col("Canonical_SMILES").eqNullSafe(F.col("_structure")), "left").select(
        "Canonical_SMILES", "CC50_mM", "Name", "num_sources", *medians, label_from_cc50("CC50_mM").alias("biocompatibility_label"))


def load_records(spark, sf_dir):
    return assay_records(raw_view(spark, sf_dir, "raw_assay"))


def load_flagged(spark, sf_dir):
    return flag_human(load_records(spark, sf_dir), raw_view(spark, sf_dir, "cell_lines"))


# ---------------------------------------------------------------- queries

def _ss(c: str) -> str:
    return f"coalesce({S.strip(c)}, '')"


_RECORDS_SQL = duck_cte("raw_assay", "cell_lines") + f""", records AS (
  SELECT ord, source_file, {S.strip('Name')} AS Name, {_ss('CAS')} AS CAS,
         {S.clean_name('Name')} AS Clean_Name, {_ss('CC50')} AS CC50_raw,
         {S.parse_cc50('CC50')} AS CC50_mM, {_ss('Cell_line')} AS Cell_line, {_ss('Method')} AS Method,
         {_ss('Mw')} AS Mw, {_ss('SMILES')} AS Canonical_SMILES, Empirical_formula,
         {', '.join(INPUT_DESCRIPTORS)}
  FROM raw_assay WHERE NOT {S.blank('Name')}),
humans AS (
  SELECT DISTINCT upper({S.strip('Cell_name')}) AS hn FROM cell_lines
  WHERE (strpos(lower(coalesce(Organism, '')), 'human') > 0
         OR strpos(lower(coalesce(Organism, '')), 'homo sapiens') > 0)
    AND {S.strip('Cell_name')} <> ''),
flagged AS (
  SELECT r.*, CASE WHEN (SELECT count(*) FROM humans) = 0 THEN TRUE
                   ELSE EXISTS (SELECT 1 FROM humans h WHERE strpos(upper(r.Cell_line), h.hn) > 0) END
              AS Is_Human_Cell
  FROM records r),
labels AS (
  SELECT Clean_Name,
         CASE WHEN count(*) FILTER (WHERE Is_Human_Cell) > 0 THEN min(CC50_mM) FILTER (WHERE Is_Human_Cell)
              ELSE min(CC50_mM) END AS min_CC50_mM_on_human,
         CAST(count(*) AS BIGINT) AS num_measurements,
         CAST(count(*) FILTER (WHERE Is_Human_Cell) AS BIGINT) AS num_human_measurements
  FROM flagged GROUP BY Clean_Name)
"""



def _extract_float_sql(x: str) -> str:
    s = f"replace({S.strip(f'CAST({x} AS VARCHAR)')}, ',', '.')"
    tok = f"string_split_regex({s}, '\\s+')[1]"
    parts = f"list_filter(string_split({tok}, '-'), lambda p: regexp_matches(p, '^(\\d+\\.?\\d*|\\.\\d+)$'))"
    ranged = f"CASE WHEN len({parts}) > 0 THEN list_sum(list_transform({parts}, lambda p: CAST(p AS DOUBLE))) / len({parts}) END"
    whole = f"CASE WHEN regexp_matches({tok}, {S.q(S.NUMERIC_RE)}) THEN TRY_CAST({tok} AS DOUBLE) END"
    out = f"CASE WHEN strpos({tok}, '-') > 0 THEN {ranged} ELSE {whole} END"
    return f"(CASE WHEN regexp_matches({tok}, {S.q(S.SCIENTIFIC_RE)}) THEN TRY_CAST({tok} AS DOUBLE) ELSE {out} END)"


@query("assay_measurements", oracle=_RECORDS_SQL + f"""
SELECT ord, source_file, Name, CAS, Clean_Name, CC50_raw, round(CC50_mM, 9) AS CC50_mM,
       round({_extract_float_sql('CC50_raw')}, 9) AS CC50_float, Cell_line, Method, Mw
FROM records
""")
def q_assay_measurements(spark, sf_dir):
    r = load_records(spark, sf_dir)
    return r.select("ord", "source_file", "Name", "CAS", "Clean_Name", "CC50_raw",
                    F.round("CC50_mM", 9).alias("CC50_mM"),
                    F.round(extract_float("CC50_raw"), 9).alias("CC50_float"),
                    "Cell_line", "Method", "Mw")


@query("identity_map", oracle=_RECORDS_SQL + """
SELECT Name, CAS, Clean_Name, source_file AS Source_File FROM records
QUALIFY row_number() OVER (PARTITION BY Name, CAS, Clean_Name ORDER BY ord) = 1
""")
def q_identity_map(spark, sf_dir):
    r = load_records(spark, sf_dir).select("Name", "CAS", "Clean_Name",
                                           F.col("source_file").alias("Source_File"), "ord")
    return keep_first(r, ["Name", "CAS", "Clean_Name"], ["ord"], repeats=True).drop("ord")


@query("human_flag", oracle=_RECORDS_SQL + "SELECT ord, Cell_line, Is_Human_Cell FROM flagged")
def q_human_flag(spark, sf_dir):
    return load_flagged(spark, sf_dir).select("ord", "Cell_line", "Is_Human_Cell")


@query("human_flag_nodim", oracle=_RECORDS_SQL.replace(
    "strpos(lower(coalesce(Organism, '')), 'human') > 0", "Organism = 'no such organism'").replace(
    "OR strpos(lower(coalesce(Organism, '')), 'homo sapiens') > 0", "") +
    "SELECT ord, Cell_line, Is_Human_Cell FROM flagged")
def q_human_flag_nodim(spark, sf_dir):
    dim = raw_view(spark, sf_dir, "cell_lines").where(F.lit(False))
    return flag_human(load_records(spark, sf_dir), dim).select("ord", "Cell_line", "Is_Human_Cell")


_LABEL_COLS = ("Clean_Name, round(min_CC50_mM_on_human, 9) AS min_CC50_mM_on_human, "
               f"{S.label_from_cc50('min_CC50_mM_on_human')} AS biocompatibility_label, "
               "num_measurements, num_human_measurements")


def _labels(spark, sf_dir):
    lab = material_labels(load_flagged(spark, sf_dir))
    return lab.withColumn("min_CC50_mM_on_human", F.round("min_CC50_mM_on_human", 9))


@query("biocompat_labels", oracle=_RECORDS_SQL + f"SELECT {_LABEL_COLS} FROM labels")
def q_biocompat_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("definitive", oracle=_RECORDS_SQL + f"SELECT * FROM (SELECT {_LABEL_COLS} FROM labels) "
       "WHERE biocompatibility_label IN (0, 1)")
def q_definitive(spark, sf_dir):
    return _labels(spark, sf_dir).where(F.col("biocompatibility_label").isin(0, 1))


@query("uncertain", oracle=_RECORDS_SQL + f"SELECT * FROM (SELECT {_LABEL_COLS} FROM labels) "
       "WHERE biocompatibility_label = -1")
def q_uncertain(spark, sf_dir):
    return _labels(spark, sf_dir).where(F.col("biocompatibility_label") == -1)


def _formula_weight_sql(f: str) -> str:
    pat = "([A-Z][a-z]?)(\\d*)"
    from matfold.functions.chem import ATOMIC_WEIGHTS
    syms = f"regexp_extract_all({f}, '{pat}', 1)"
    cnts = f"regexp_extract_all({f}, '{pat}', 2)"
    terms = (f"list_transform(list_zip({syms}, {cnts}), lambda z: (CASE z[1] "
             + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ATOMIC_WEIGHTS.items())
             + " END) * (CASE WHEN z[2] = '' THEN 1.0 ELSE CAST(z[2] AS DOUBLE) END))")
    total = f"list_reduce(list_prepend(0.0::DOUBLE, {terms}), lambda a, t: a + t)"
    return (f"(CASE WHEN NOT {S.blank(f)} AND regexp_replace({f}, '{pat}', '', 'g') = '' "
            f"THEN {total} END)")


_COMPOUND_SQL = _RECORDS_SQL + f""", compounds AS (
  SELECT Canonical_SMILES, min(CC50_mM) AS CC50_mM, arg_min(Name, ord) AS Name,
         CAST(count(DISTINCT source_file) AS BIGINT) AS num_sources,
         median({_formula_weight_sql('Empirical_formula')}) AS MolWt,
         {', '.join(f'median({S.to_number(c)}) AS {c}' for c in INPUT_DESCRIPTORS)}
  FROM records GROUP BY Canonical_SMILES)
"""


@query("compound_features", oracle=_COMPOUND_SQL + f"""
SELECT Canonical_SMILES, round(CC50_mM, 9) AS CC50_mM, Name, num_sources, round(MolWt, 6) AS MolWt,
       {', '.join(f'round({c}, 6) AS {c}' for c in INPUT_DESCRIPTORS)},
       {S.label_from_cc50('CC50_mM')} AS biocompatibility_label FROM compounds
""")
def q_compound_features(spark, sf_dir):
    c = compound_features(load_records(spark, sf_dir))
    return c.select("Canonical_SMILES", F.round("CC50_mM", 9).alias("CC50_mM"), "Name", "num_sources",
                    *[F.round(x, 6).alias(x) for x in ("MolWt", *INPUT_DESCRIPTORS)], "biocompatibility_label")


@query("coverage", oracle=_COMPOUND_SQL + """
SELECT round(100.0 * avg(CASE WHEN MolWt IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS descriptor_coverage_pct,
       CAST(count(*) AS BIGINT) AS n_compounds FROM compounds
""")
def q_coverage(spark, sf_dir):
    c = compound_features(load_records(spark, sf_dir))
    return c.agg(F.round(coverage_percent("MolWt"), 6).alias("descriptor_coverage_pct"),
                  F.count(F.lit(1)).cast("long").alias("n_compounds"))


def _tox_sql(x: str) -> str:
    v = S.to_number(x)
    return (f"(CASE WHEN {v} IS NULL THEN 0.5 WHEN {v} <= 0.1 THEN 0.1 WHEN {v} <= 1.0 THEN 0.3 "
            f"WHEN {v} <= 10.0 THEN 0.6 WHEN {v} <= 100.0 THEN 0.8 ELSE 0.95 END)")


def _any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"strpos({x}, '{w}') > 0" for w in words) + ")"


@query("tox_composite", oracle=duck_cte("raw_assay") + f"""
, t AS (
  SELECT ord, Name, Cell_line, Method, {_tox_sql('CC50')} AS normalized_toxicity,
         CASE WHEN Cell_line IS NULL THEN 0.5
              WHEN {_any_sql('upper(Cell_line)', ['HEK293', 'HELA', 'HEPG2', 'MCF-7'])} THEN 1.0
              WHEN {_any_sql('upper(Cell_line)', ['MOUSE', 'RAT'])} THEN 0.7 ELSE 0.5 END AS cell_line_weight,
         CASE WHEN Method IS NULL THEN 0.6
              WHEN {_any_sql('upper(Method)', ['MTT', 'MTS', 'ALAMARBLUE', 'PRESTOBLUE', 'CELLTITER-GLO'])} THEN 1.0
              WHEN {_any_sql('upper(Method)', ['LDH', 'NRU', 'SRB', 'WST-1', 'WST-8'])} THEN 0.8 ELSE 0.6 END
           AS method_reliability
  FROM raw_assay)
SELECT ord, Name, Cell_line, Method, CAST(normalized_toxicity AS DOUBLE) AS normalized_toxicity,
       CAST(cell_line_weight AS DOUBLE) AS cell_line_weight,
       CAST(method_reliability AS DOUBLE) AS method_reliability,
       round(CAST(normalized_toxicity * 0.6 + cell_line_weight * 0.3 + method_reliability * 0.1 AS DOUBLE), 6)
         AS cytotoxicity_score
FROM t
""")
def q_tox_composite(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_assay")
    t = r.select("ord", "Name", "Cell_line", "Method",
                 toxicity_score("CC50").alias("normalized_toxicity"),
                 cell_line_weight("Cell_line").alias("cell_line_weight"),
                 method_weight("Method").alias("method_reliability"))
    return t.select("*", F.round(composite_score("normalized_toxicity", "cell_line_weight",
                                                 "method_reliability"), 6).alias("cytotoxicity_score"))


@query("formula_weight", oracle=duck_cte("raw_assay") + f"""
SELECT DISTINCT Empirical_formula, round({_formula_weight_sql('Empirical_formula')}, 6) AS MolWt
FROM raw_assay
""")
def q_formula_weight(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_assay").select("Empirical_formula").distinct()
    return r.select("Empirical_formula", F.round(formula_weight("Empirical_formula"), 6).alias("MolWt"))


@query("chem_clean_names", oracle=duck_cte("raw_assay") + f"""
SELECT ord, {S.clean_basic(S.strip('Name'))} AS Clean_Name FROM raw_assay WHERE NOT {S.blank('Name')}
""")
def q_chem_clean_names(spark, sf_dir):
    r = raw_view(spark, sf_dir, "raw_assay").where(~is_blank("Name"))
    return r.select("ord", clean_name_basic(py_strip("Name")).alias("Clean_Name"))
