"""Cross-domain joins: unified training table, fuzzy match, feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.functions.text import normalize_name, upper_strip
from matfold.operators.agg import mean_by_key
from matfold.operators.fuzzy import fuzzy_best_match
from matfold.operators.joins import suffixed_join
from matfold.plans import sqlfrag as S
from matfold.plans.assays import (_COMPOUND_SQL, compound_features, flag_human, load_records,
                                  material_labels)
from matfold.plans.corrosion import CORROSION_SCORES_SQL, corrosion_scores
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view
from matfold.sources.tables import spark_sql

# --------------------------------------------------------------- training


def unified_training(chemical: DataFrame, biological: DataFrame, corrosion: DataFrame,
                     match_nulls: bool = False, fuzzy: str | None = None, cutoff: float = 0.75,
                     metric: str = "ratio") -> DataFrame:
    """chemical ⋈ biological on the normalised name (inner, _chem/_bio),
    then ⟕ corrosion (suffix _corr).

    ``fuzzy='unmatched'`` adds, for chemical rows without an exact partner,
    the biological row whose key is the best fuzzy match above ``cutoff``;
    ``fuzzy='only_if_empty'`` uses the fuzzy join instead of the exact one
    only when the exact join is empty (the original behaviour; one bounded
    emptiness check).
    """
    chem = chemical.withColumn("Name_norm", normalize_name("Name"))
    bio = biological.withColumn("Name_norm", normalize_name("Clean_Name"))
    corr = corrosion.withColumn("Name_norm", normalize_name("Clean_Name"))
    merged = suffixed_join(chem, bio, ["Name_norm"], "inner", ("_chem", "_bio"), null_safe=match_nulls)

    def fuzzy_part(probe_side: DataFrame) -> DataFrame:
        m = fuzzy_best_match(probe_side, "Name_norm", bio, "Name_norm", cutoff, metric)
        probed = probe_side.join(m.select(F.col("probe").alias("Name_norm"), "match"), "Name_norm")
        bio_m = bio.withColumnRenamed("Name_norm", "match")
        out = suffixed_join(probed, bio_m, ["match"], "inner", ("_chem", "_bio"))
        return out.drop("match").select(*merged.columns)

    if fuzzy == "unmatched":
        left_over = chem.join(bio.select("Name_norm").distinct(), "Name_norm", "left_anti")
        merged = merged.unionByName(fuzzy_part(left_over))
    elif fuzzy == "only_if_empty":
        if merged.limit(1).count() == 0:
            merged = fuzzy_part(chem)
    elif fuzzy is not None:
        raise ValueError(fuzzy)
    return suffixed_join(merged, corr, ["Name_norm"], "left", ("", "_corr"), null_safe=match_nulls)


_TRAIN_COLS = ["Name_norm", "Canonical_SMILES", "CC50_mM", "Name", "num_sources", "MolWt",
               "biocompatibility_label_chem", "Clean_Name", "min_CC50_mM_on_human",
               "biocompatibility_label_bio", "num_measurements", "num_human_measurements",
               "Clean_Name_corr", "corr_score_min", "corr_score_mean", "corr_score_var", "data_points", "UNS"]


def _training_sql() -> str:
    comp = _COMPOUND_SQL
    corr_body = CORROSION_SCORES_SQL.replace("WITH raw_corrosion AS", "raw_corrosion AS", 1)
    sql = comp + ", " + corr_body.replace("\nSELECT Clean_Name,", "\n, corr AS (SELECT Clean_Name,", 1)
    sql = sql.rstrip() + ")\n"
    sql += f"""
, chem AS (SELECT *, {S.norm_name('Name')} AS Name_norm FROM compounds),
  bio AS (SELECT *, {S.norm_name('Clean_Name')} AS Name_norm FROM labels),
  cor AS (SELECT *, {S.norm_name('Clean_Name')} AS Name_norm FROM corr)
SELECT c.Name_norm, c.Canonical_SMILES, round(c.CC50_mM, 9) AS CC50_mM, c.Name, c.num_sources,
       round(c.MolWt, 6) AS MolWt, {S.label_from_cc50('c.CC50_mM')} AS biocompatibility_label_chem,
       b.Clean_Name, round(b.min_CC50_mM_on_human, 9) AS min_CC50_mM_on_human,
       {S.label_from_cc50('b.min_CC50_mM_on_human')} AS biocompatibility_label_bio,
       b.num_measurements, b.num_human_measurements,
       r.Clean_Name AS Clean_Name_corr, r.corr_score_min, r.corr_score_mean, r.corr_score_var,
       r.data_points, r.UNS
FROM chem c JOIN bio b ON c.Name_norm = b.Name_norm LEFT JOIN cor r ON c.Name_norm = r.Name_norm
"""
    return sql


@query("unified_training", oracle=_training_sql())
def q_unified_training(spark, sf_dir):
    records = load_records(spark, sf_dir)
    chem = compound_features(records)
    bio = material_labels(flag_human(records, raw_view(spark, sf_dir, "cell_lines")))
    corr = corrosion_scores(raw_view(spark, sf_dir, "raw_corrosion"))
    out = unified_training(chem, bio, corr)
    return out.select(*[F.round(c, 9).alias(c) if c in ("CC50_mM", "min_CC50_mM_on_human")
                        else F.round(c, 6).alias(c) if c == "MolWt" else F.col(c) for c in _TRAIN_COLS])


@query("unified_training_fuzzy")
def q_unified_training_fuzzy(spark, sf_dir):
    """Exact matches plus fuzzy (difflib ratio >= 0.75) matches of the rest."""
    records = load_records(spark, sf_dir)
    chem = compound_features(records)
    bio = material_labels(flag_human(records, raw_view(spark, sf_dir, "cell_lines")))
    corr = corrosion_scores(raw_view(spark, sf_dir, "raw_corrosion"))
    return unified_training(chem, bio, corr, fuzzy="unmatched").select(*_TRAIN_COLS)


# ------------------------------------------------------------------ fuzzy

def _fuzzy_inputs(spark, sf_dir):
    probes = raw_view(spark, sf_dir, "raw_corrosion").select(normalize_name("Material").alias("probe"))
    cands = spark_sql(spark, sf_dir, "SELECT p_name, p_type, p_brand FROM {part}").select(
        normalize_name(F.concat_ws(" ", "p_type", "p_name")).alias("cand"))
    return probes, cands


_FUZZY_SQL = duck_cte("raw_corrosion") + f"""
, p AS (SELECT DISTINCT {S.norm_name('Material')} AS probe FROM raw_corrosion WHERE Material IS NOT NULL),
  c AS (SELECT DISTINCT {S.norm_name("concat_ws(' ', p_type, p_name)")} AS cand FROM part),
  s AS (SELECT probe, cand,
               1.0 - levenshtein(probe, cand) / greatest(length(probe), length(cand), 1) AS score
        FROM p, c)
SELECT probe, cand AS match, round(score, 9) AS score FROM s WHERE score >= 0.75 - 1e-12
QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, cand DESC) = 1
"""


@query("fuzzy_join", oracle=_FUZZY_SQL)
def q_fuzzy_join(spark, sf_dir):
    probes, cands = _fuzzy_inputs(spark, sf_dir)
    m = fuzzy_best_match(probes, "probe", cands, "cand", cutoff=0.75, metric="levenshtein")
    return m.select("probe", "match", F.round("score", 9).alias("score"))


@query("fuzzy_join_ratio")
def q_fuzzy_join_ratio(spark, sf_dir):
    """difflib ratio variant (checked against a brute force in the tests)."""
    probes, cands = _fuzzy_inputs(spark, sf_dir)
    m = fuzzy_best_match(probes, "probe", cands, "cand", cutoff=0.75, metric="ratio")
    return m.select("probe", "match", F.round("score", 9).alias("score"))


# --------------------------------------------------------- feature matrix

def feature_matrix(mechanical: DataFrame, chemical: DataFrame, biological: DataFrame,
                   master: DataFrame, target: str = "bio_cytotoxicity_score",
                   default_target: float = 0.5) -> DataFrame:
    """Per master item: mean numeric features of each domain (missing -> -1).

    Keys are compared after strip+upper on both sides (the original
    upper-cased only the probe, so mixed-case master names never matched).
    Each domain is reduced by one partial aggregate before the joins.
    """
    def dom(df, key, prefix):
        agg = mean_by_key(df, upper_strip(key), "_k", exclude=[key])
        return agg.select("_k", *[F.col(c).alias(f"{prefix}_{c}") for c in agg.columns if c != "_k"])
    m = dom(mechanical, "Material", "mech")
    c = dom(chemical, "Polymer", "chem")
    b = dom(biological, "Material", "bio")
    base = master.select("material_name", upper_strip("material_name").alias("_k"))
    out = base.join(m, "_k", "left").join(c, "_k", "left").join(b, "_k", "left")
    feats = [x for x in out.columns if x not in ("_k", "material_name")]
    cols = [F.coalesce(F.col(x), F.lit(-1.0)).alias(x) for x in feats]
    y = (F.coalesce(F.col(target), F.lit(-1.0)) if target in feats else F.lit(default_target)).alias("y")
    return out.select("material_name", *cols, y)


_FM_SRC = """
  SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS material_name FROM {part}
"""


def _fm_inputs(spark, sf_dir):
    master = spark_sql(spark, sf_dir, "SELECT DISTINCT * FROM (" + _FM_SRC + ")")
    mech = spark_sql(spark, sf_dir, "SELECT p_name AS Material, p_size, p_retailprice FROM {part}")
    li = spark_sql(spark, sf_dir, """
      SELECT p.p_name, l.l_quantity, l.l_discount, l.l_tax
      FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""")
    chem = li.select(F.upper("p_name").alias("Polymer"), "l_quantity", "l_discount")
    bio = li.select(F.lower("p_name").alias("Material"), "l_tax",
                    (F.lit(1.0) - F.col("l_discount")).alias("cytotoxicity_score"))
    return mech, chem, bio, master


_FM_SQL = "WITH master AS (SELECT DISTINCT * FROM (" + _FM_SRC.format(part="part") + """)),
  mech AS (SELECT upper(trim(p_name)) AS k, avg(p_size) AS mech_p_size, avg(p_retailprice) AS mech_p_retailprice
           FROM part GROUP BY 1),
  li AS (SELECT p.p_name, l.l_quantity, l.l_discount, l.l_tax FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
  chem AS (SELECT upper(trim(upper(p_name))) AS k, avg(l_quantity) AS chem_l_quantity,
                  avg(l_discount) AS chem_l_discount FROM li GROUP BY 1),
  bio AS (SELECT upper(trim(lower(p_name))) AS k, avg(l_tax) AS bio_l_tax,
                 avg(1.0 - l_discount) AS bio_cytotoxicity_score FROM li GROUP BY 1)
SELECT m.material_name,
       round(coalesce(mech_p_size, -1.0), 6) AS mech_p_size,
       round(coalesce(mech_p_retailprice, -1.0), 6) AS mech_p_retailprice,
       round(coalesce(chem_l_quantity, -1.0), 6) AS chem_l_quantity,
       round(coalesce(chem_l_discount, -1.0), 6) AS chem_l_discount,
       round(coalesce(bio_l_tax, -1.0), 6) AS bio_l_tax,
       round(coalesce(bio_cytotoxicity_score, -1.0), 6) AS bio_cytotoxicity_score,
       round(coalesce(bio_cytotoxicity_score, -1.0), 6) AS y
FROM master m LEFT JOIN mech ON upper(trim(m.material_name)) = mech.k
LEFT JOIN chem ON upper(trim(m.material_name)) = chem.k
LEFT JOIN bio ON upper(trim(m.material_name)) = bio.k
"""


@query("feature_matrix", oracle=_FM_SQL)
def q_feature_matrix(spark, sf_dir):
    fm = feature_matrix(*_fm_inputs(spark, sf_dir))
    return fm.select("material_name", *[F.round(c, 6).alias(c) for c in fm.columns if c != "material_name"])
