"""Corrosion scoring job and its queries.

Plan shape: scan lineitem + part (pruned to the used columns), one join on
the part key (AQE turns it into a broadcast only when the part side is
small at run time), staged projections computing the per-record expressions,
then a hash aggregate on (clean name, UNS) that is combined map-side, and a
small one per clean name.  A hot material name costs one partial row per UNS
and input task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.functions.parse import parse_stripped_rate, strip_to_number, to_number
from matfold.functions.score import corrosion_compat_score, is_bio_environment, rate_score, rating_score
from matfold.functions.text import clean_name_basic, py_strip
from matfold.operators.agg import packed_order, stats_and_first
from matfold.plans import sqlfrag as S
from matfold.plans.registry import query
from matfold.sources.raw_views import duck_cte, raw_view

ORDINAL = ["ord_a", "ord_b", "ord_c", "ord_d"]


def score_records(raw: DataFrame, mm_col: str = "Rate_mm", mils_col: str = "Rate_mils",
                  material_col: str = "Material", mils_unit: str = "text") -> DataFrame:
    """Per-record rate (mm/yr), row score and clean name.

    Staged projections: the stripped texts and the parsed rate are computed
    once and referenced by name, so the optimizer does not inline the parse
    into every place that uses it (CollapseProject keeps non-cheap shared
    expressions in their own projection).
    """
    staged = raw.select("*", py_strip(mm_col).alias("_smm"), py_strip(mils_col).alias("_smils"))
    parsed = staged.select(
        "*",
        F.coalesce(parse_stripped_rate(F.col("_smm")), parse_stripped_rate(F.col("_smils"), mils_unit)).alias("rate_mm_yr"),
        rating_score("_smm", "_smils").alias("_rating"),
        clean_name_basic(material_col).alias("Clean_Name"))
    return parsed.select(*raw.columns, "rate_mm_yr",
                         F.coalesce(rate_score("rate_mm_yr"), F.col("_rating")).alias("corr_score_row"),
                         "Clean_Name")


def corrosion_scores(raw: DataFrame, order_cols=ORDINAL, mils_unit: str = "text",
                     round_to: int | None = 6) -> DataFrame:
    """One row per clean material name: score min/mean/var, points, first UNS."""
    scored = score_records(raw, mils_unit=mils_unit)
    out = stats_and_first(scored, "Clean_Name", "corr_score_row", "corr_score", "UNS", packed_order(*order_cols))
    if round_to is not None:
        out = out.select("Clean_Name",
                         *[F.round(c, round_to).alias(c) for c in
                           ("corr_score_min", "corr_score_mean", "corr_score_var")],
                         "data_points", "UNS")
    return out


def bio_environment_scores(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Records in biologically relevant environments with a compatibility score."""
    return (raw.where(is_bio_environment("Environment"))
               .select(*ORDINAL, "Material", "Environment",
                       corrosion_compat_score("Rate_mm", strict=strict).alias("corrosion_score")))


def with_rate_numeric(raw: DataFrame) -> DataFrame:
    """The table plus ``<col>_numeric`` for every rate column (one projection)."""
    rate_cols = [c for c in raw.columns if "rate" in c.lower()]
    return raw.select("*", *[strip_to_number(c).alias(f"{c}_numeric") for c in rate_cols])


def rate_numeric(raw: DataFrame) -> DataFrame:
    """Every rate column stripped to a number; temperature coerced."""
    rate_cols = [c for c in raw.columns if "rate" in c.lower()]
    return raw.select(*ORDINAL,
                      *[strip_to_number(c).alias(f"{c}_numeric") for c in rate_cols],
                      to_number("Temperature").alias("Temperature_numeric"))


# ---------------------------------------------------------------- queries

_ORD = "ord_a, ord_b, ord_c, ord_d"

CORROSION_SCORES_SQL = duck_cte("raw_corrosion") + f"""
, scored AS (
  SELECT *, {S.corrosion_row_score('Rate_mm', 'Rate_mils')} AS s,
         {S.clean_basic('Material')} AS Clean_Name
  FROM raw_corrosion)
SELECT Clean_Name,
       round(min(s), 6) AS corr_score_min,
       round(avg(s), 6) AS corr_score_mean,
       round(CASE WHEN count(s) > 1 THEN var_samp(s) ELSE 0.0 END, 6) AS corr_score_var,
       CAST(count(s) AS BIGINT) AS data_points,
       coalesce(first(UNS ORDER BY {_ORD}) FILTER (WHERE NOT {S.blank('UNS')}), '') AS UNS
FROM scored GROUP BY Clean_Name
"""


@query("corrosion_scores", oracle=CORROSION_SCORES_SQL)
def q_corrosion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrosion_scores(raw_view(spark, sf_dir, "raw_corrosion"))


def _compat_sql(x: str) -> str:
    up = f"upper({x})"
    rate = S.to_number(x)
    return (f"(CASE WHEN {x} IS NULL THEN 0.5 "
            f"WHEN strpos({up}, 'A') > 0 OR strpos({up}, 'RESISTANT') > 0 THEN 0.9 "
            f"WHEN strpos({up}, 'B') > 0 OR strpos({up}, 'GOOD') > 0 THEN 0.7 "
            f"WHEN strpos({up}, 'C') > 0 OR strpos({up}, 'QUESTIONABLE') > 0 THEN 0.4 "
            f"WHEN strpos({up}, 'D') > 0 OR strpos({up}, 'POOR') > 0 THEN 0.1 "
            f"WHEN {rate} IS NULL THEN 0.5 WHEN {rate} < 0.01 THEN 0.9 WHEN {rate} < 0.1 THEN 0.7 "
            f"WHEN {rate} < 0.5 THEN 0.5 WHEN {rate} < 1.0 THEN 0.3 ELSE 0.1 END)")


CORROSION_ENV_SQL = duck_cte("raw_corrosion") + f"""
SELECT {_ORD}, Material, Environment, CAST({_compat_sql('Rate_mm')} AS DOUBLE) AS corrosion_score
FROM raw_corrosion
WHERE regexp_matches(Environment, 'saline|phosphate|blood|serum|water|NaCl|ringer|lactate|physiological', 'i')
"""


@query("corrosion_env_score", oracle=CORROSION_ENV_SQL)
def q_corrosion_env_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio_environment_scores(raw_view(spark, sf_dir, "raw_corrosion"))


def _strip_num_sql(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9.\\-]+', '', 'g')"
    return f"(CASE WHEN regexp_matches({s}, {S.q(S.NUMERIC_RE)}) THEN TRY_CAST({s} AS DOUBLE) END)"


RATE_NUMERIC_SQL = duck_cte("raw_corrosion") + f"""
SELECT {_ORD}, {_strip_num_sql('Rate_mm')} AS Rate_mm_numeric,
       {_strip_num_sql('Rate_mils')} AS Rate_mils_numeric,
       {S.to_number('Temperature')} AS Temperature_numeric
FROM raw_corrosion
"""


@query("rate_numeric", oracle=RATE_NUMERIC_SQL)
def q_rate_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_numeric(raw_view(spark, sf_dir, "raw_corrosion"))


ROW_SCORES_SQL = duck_cte("raw_corrosion") + f"""
SELECT {_ORD}, {S.clean_basic('Material')} AS Clean_Name,
       round(coalesce({S.parse_rate('Rate_mm')}, {S.parse_rate('Rate_mils')}), 6) AS rate_mm_yr,
       round({S.corrosion_row_score('Rate_mm', 'Rate_mils')}, 6) AS corr_score_row
FROM raw_corrosion
"""


@query("corrosion_row_scores", oracle=ROW_SCORES_SQL)
def q_corrosion_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_records(raw_view(spark, sf_dir, "raw_corrosion"))
    return s.select(*ORDINAL, "Clean_Name", F.round("rate_mm_yr", 6).alias("rate_mm_yr"),
                    F.round("corr_score_row", 6).alias("corr_score_row"))


def _mils_sql() -> str:
    rate = f"coalesce({S.parse_rate('Rate_mm')}, {S.parse_rate('Rate_mils', unit='mils')})"
    rating = f"coalesce({S.rating_score('Rate_mm')}, {S.rating_score('Rate_mils')})"
    return f"coalesce({S.rate_score(rate)}, {rating})"


@query("corrosion_scores_mils", oracle=CORROSION_SCORES_SQL.replace(
    S.corrosion_row_score('Rate_mm', 'Rate_mils'), _mils_sql()))
def q_corrosion_scores_mils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same summary with every number of the mils column read as mils."""
    return corrosion_scores(raw_view(spark, sf_dir, "raw_corrosion"), mils_unit="mils")


def _compat_strict_sql(x: str) -> str:
    up = f"upper({x})"
    rate = S.to_number(x)

    def word(ws):
        return f"regexp_matches({up}, '\\b({'|'.join(ws)})\\b')"
    return (f"(CASE WHEN {x} IS NULL THEN 0.5 "
            f"WHEN {word(['A', 'RESISTANT'])} THEN 0.9 WHEN {word(['B', 'GOOD'])} THEN 0.7 "
            f"WHEN {word(['C', 'QUESTIONABLE'])} THEN 0.4 WHEN {word(['D', 'POOR'])} THEN 0.1 "
            f"WHEN {rate} IS NULL THEN 0.5 WHEN {rate} < 0.01 THEN 0.9 WHEN {rate} < 0.1 THEN 0.7 "
            f"WHEN {rate} < 0.5 THEN 0.5 WHEN {rate} < 1.0 THEN 0.3 ELSE 0.1 END)")


@query("corrosion_env_score_strict", oracle=CORROSION_ENV_SQL.replace(
    _compat_sql('Rate_mm'), _compat_strict_sql('Rate_mm')))
def q_corrosion_env_score_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility scores with whole-word rating matches."""
    return bio_environment_scores(raw_view(spark, sf_dir, "raw_corrosion"), strict=True)
