"""Raw domain views derived from the driver tables.

The driver tables are clean TPC-H-like data; the operators of this library
work on dirty measurement text.  Each raw view below derives such text from
a base table with one SQL statement written in the subset both Spark and
DuckDB run identically, so the Spark job and the DuckDB oracle start from the
same rows.  Numbers are turned into text through DECIMAL casts whose scale
holds every digit (double -> string formatting differs between engines).

Every view scales with its base table: no row caps, no id subsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matfold.sources.tables import duck_refs, spark_sql


def _dec(expr: str, scale: int) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,{scale})) AS STRING)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# Corrosion records: one per lineitem, material text from its part.
RAW_CORROSION = f"""
SELECT
  l.l_orderkey AS ord_a, l.l_linenumber AS ord_b, l.l_partkey AS ord_c, l.l_suppkey AS ord_d,
  CASE l.l_orderkey % 7
    WHEN 0 THEN 'Saline solution, 37 C'
    WHEN 1 THEN 'Sea water'
    WHEN 2 THEN 'Sulfuric acid 10%'
    WHEN 3 THEN 'Ringer lactate'
    WHEN 4 THEN 'Sodium hydroxide'
    WHEN 5 THEN 'Human blood SERUM'
    ELSE NULL END AS Environment,
  p.p_type AS Material_Group,
  p.p_brand AS Material_Family,
  CASE p.p_partkey % 5
    WHEN 0 THEN 'ASTM ' || p.p_name
    WHEN 1 THEN 'iso: ' || upper(p.p_name) || ', annealed'
    WHEN 2 THEN '  ' || p.p_name || ' (cast) #' || {_s('p.p_size % 3')}
    WHEN 3 THEN 'Ti-6Al ' || p.p_name
    ELSE p.p_name END AS Material,
  CASE
    WHEN l.l_returnflag = 'R' AND l.l_linenumber % 2 = 0 THEN 'A (Resistant)'
    WHEN l.l_linenumber = 1 THEN 'D (Poor)'
    WHEN l.l_linenumber = 2 THEN '0.05 max'
    WHEN l.l_linenumber = 3 THEN {_dec('l.l_tax * 100', 2)} || ' mils'
    WHEN l.l_linenumber = 4 THEN {_dec('l.l_discount * 10', 3)}
    WHEN l.l_linenumber = 5 THEN NULL
    WHEN l.l_linenumber = 6 THEN '25 C'
    ELSE '' END AS Rate_mm,
  CASE
    WHEN l.l_linestatus = 'O' THEN {_dec('l.l_quantity / 10', 3)}
    WHEN l.l_returnflag = 'R' THEN 'E (Fair)'
    WHEN l.l_returnflag = 'N' THEN {_dec('l.l_tax', 2)} || '"'
    ELSE NULL END AS Rate_mils,
  CASE l.l_suppkey % 3
    WHEN 0 THEN 'S' || {_s('30400 + l.l_suppkey % 10')}
    WHEN 1 THEN ' '
    ELSE NULL END AS UNS,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'Boiling' WHEN 1 THEN '20-25' ELSE {_s('l.l_linenumber * 10')} END
    AS Temperature
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey
"""

# Cytotoxicity assay records: one per event.
RAW_ASSAY = f"""
SELECT
  e.event_id AS ord,
  'family_' || {_s('e.user_id % 9')} || '.csv' AS source_file,
  CASE e.event_id % 11
    WHEN 0 THEN ''
    WHEN 1 THEN NULL
    WHEN 2 THEN 'ASTM ' || upper(e.event_type) || '-' || {_s('e.user_id')}
    WHEN 3 THEN e.event_type || ', salt (' || {_s('e.user_id')} || ')'
    ELSE e.event_type || ' ' || {_s('e.user_id')} END AS Name,
  'C' || {_s('e.user_id % 20 + 1')} || 'H' || {_s('e.user_id % 30 + 2')} ||
    CASE e.user_id % 3 WHEN 0 THEN 'BrNO3' WHEN 1 THEN 'N2O' ELSE 'ClP' END AS Empirical_formula,
  CASE WHEN e.event_id % 9 = 0 THEN NULL
       ELSE {_s('e.user_id + 100')} || '-' || {_s('e.user_id % 97')} || '-' || {_s('e.user_id % 10')} END AS CAS,
  CASE e.user_id % 6
    WHEN 0 THEN repeat('C', CAST(e.user_id % 5 + 1 AS INT)) || '[N+](C)(C)C.[Br-]'
    WHEN 1 THEN 'CC' || repeat('O', CAST(e.user_id % 3 + 1 AS INT)) || ';Cl'
    WHEN 2 THEN ''
    WHEN 3 THEN 'C1CC(C' || repeat('N', CAST(e.user_id % 4 + 1 AS INT))
    WHEN 4 THEN 'c1ccccc1C(=O)' || repeat('C', CAST(e.user_id % 4 + 1 AS INT))
    ELSE NULL END AS SMILES,
  {_dec('100 + e.user_id * 1.5', 1)} AS Mw,
  CASE e.event_id % 8
    WHEN 0 THEN {_dec('e.value / 10', 3)}
    WHEN 1 THEN '>' || {_dec('e.value', 2)}
    WHEN 2 THEN '<' || {_dec('e.value / 100', 4)}
    WHEN 3 THEN {_dec('e.value / 100', 4)} || '-' || {_dec('e.value / 10', 3)}
    WHEN 4 THEN {_dec('e.value / 10', 3)} || '–' || {_dec('e.value', 2)}
    WHEN 5 THEN {_dec('e.value / 10', 3)} || ' (SD ' || {_dec('e.value / 100', 4)} || ')'
    WHEN 6 THEN CASE WHEN e.user_id % 2 = 0 THEN '2.7e-07' ELSE '1,200' END
    ELSE CASE e.user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'n.d.' ELSE '-5' END
  END AS CC50,
  CASE e.event_id % 5 WHEN 0 THEN '24' WHEN 1 THEN '48.0' ELSE '72' END AS Incubation_h,
  CASE e.user_id % 10
    WHEN 0 THEN 'HeLa'
    WHEN 1 THEN 'MCF-7 wt'
    WHEN 2 THEN 'HEK293T'
    WHEN 3 THEN 'rat hepatocytes'
    WHEN 4 THEN 'MOUSE L929'
    WHEN 5 THEN NULL
    WHEN 6 THEN 'NATION_' || {_s('e.user_id % 25')} || ' cells'
    WHEN 7 THEN 'nation_' || {_s('e.user_id % 13')}
    WHEN 8 THEN 'unknown'
    ELSE 'A549' END AS Cell_line,
  CASE e.event_type
    WHEN 'click' THEN 'MTT'
    WHEN 'view' THEN 'WST-1 assay'
    WHEN 'purchase' THEN 'LDH release'
    WHEN 'signup' THEN NULL
    ELSE 'neutral red uptake' END AS Method,
  {_dec('e.value / 100 - 2', 4)} AS LogP,
  CASE WHEN e.user_id % 7 = 0 THEN NULL ELSE {_dec('20 + e.user_id * 0.5', 1)} END AS TPSA,
  {_s('e.user_id % 4')} AS HBD,
  CASE WHEN e.event_id % 5 = 0 THEN 'n/a' ELSE {_s('e.user_id % 9')} END AS HBA,
  {_s('e.event_id % 3')} AS AromaticRings
FROM {{events}} e
"""

# Cell-line dimension: one row per nation; regions 0-2 are human lines.
CELL_LINES = """
SELECT n_name AS Cell_name,
       CASE WHEN n_regionkey < 3 THEN 'Homo sapiens (human)' ELSE 'Mus musculus (mouse)' END AS Organism,
       CASE WHEN n_regionkey = 4 THEN 'fibroblast' ELSE 'epithelial' END AS Cell_type
FROM {nation}
"""

# Method dimension: one row per region.
METHODS = """
SELECT CASE r_regionkey WHEN 0 THEN 'MTT' WHEN 1 THEN 'WST-1 assay' WHEN 2 THEN 'LDH release'
                        WHEN 3 THEN 'neutral red uptake' ELSE 'SRB' END AS Method_abbreviation,
       'method of ' || r_name AS Full_name
FROM {region}
"""

# Machine-design materials: one per part.
RAW_MATERIAL = f"""
SELECT
  p.p_partkey AS ord,
  CASE p.p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'din' WHEN 2 THEN ' ' WHEN 3 THEN 'JIS'
                       WHEN 4 THEN NULL ELSE 'ASTM ' END AS Std,
  'M' || {_s('p.p_partkey')} AS ID,
  CASE p.p_partkey % 12
    WHEN 0 THEN 'SUS' || {_s('300 + p.p_size')}
    WHEN 1 THEN 'C' || {_s('28000 + p.p_partkey % 700')}
    WHEN 2 THEN 'GG-' || {_s('p.p_size')}
    WHEN 3 THEN 'S' || {_s('10 + p.p_size')} || 'C'
    WHEN 4 THEN 'Brass ' || p.p_name
    WHEN 5 THEN 'ASTM A' || {_s('p.p_size')}
    WHEN 6 THEN 'DIN ' || {_s('p.p_size')} || 'CrMo4'
    WHEN 7 THEN 'Grade ' || {_s('p.p_size * 10')}
    WHEN 8 THEN 'Titanium ' || p.p_type
    WHEN 9 THEN p.p_name
    WHEN 10 THEN 'Aluminium ' || {_s('p.p_size')} || '-T6'
    ELSE 'ISO, ' || p.p_brand || ' steel' END AS Material,
  CASE p.p_partkey % 4 WHEN 0 THEN 'annealed' WHEN 1 THEN NULL WHEN 2 THEN 'quenched' ELSE 'as-rolled' END
    AS Heat_treatment,
  {_dec('p.p_retailprice / 2', 3)} AS Su,
  CASE WHEN p.p_partkey % 5 = 0 THEN {_s('p.p_size * 10')} || ' max'
       ELSE {_dec('p.p_retailprice * 0.4', 3)} END AS Sy,
  CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE {_s('p.p_size')} END AS A5,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE {_s('100 + p.p_size * 3')} END AS Bhn,
  {_s('190000 + p.p_size * 100')} AS E,
  CASE WHEN p.p_partkey % 4 = 0 THEN '' ELSE {_s('75000 + p.p_size * 50')} END AS G,
  '0.3' AS mu,
  {_s('7800 + p.p_size')} AS Ro,
  CASE WHEN p.p_partkey % 2 = 0 THEN lower(p.p_type) || ' grade' ELSE NULL END AS Desc_text,
  CASE WHEN p.p_partkey % 8 = 0 THEN {_s('p.p_size * 5')} ELSE NULL END AS HV
FROM {{part}} p
"""

# High-entropy alloys: one per supplier, formulas repeat (keep-first).
RAW_HEA = f"""
SELECT
  s.s_suppkey AS ord,
  'Al' || {_s('s.s_suppkey % 4')} || 'CoCrFeNi' || CASE WHEN s.s_suppkey % 3 = 0 THEN 'Ti' ELSE '' END AS FORMULA,
  CASE s.s_suppkey % 2 WHEN 0 THEN 'arc melted' ELSE 'powder' END AS Processing,
  {_dec('500 + s.s_nationkey * 20', 1)} AS UTS,
  {_dec('300 + s.s_nationkey * 10', 1)} AS YS,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE {_s('150 + s.s_nationkey')} END AS Modulus,
  {_s('200 + s.s_nationkey * 7')} AS HV,
  {_dec('s.s_nationkey * 1.5', 1)} AS Elongation,
  {_dec('7.5 + s.s_nationkey / 100', 4)} AS Density,
  CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE 'FCC' END AS Microstructure
FROM {{supplier}} s
"""

# Alloy compositions: one per customer, names repeat (keep-first).
RAW_ALLOY = f"""
SELECT
  c.c_custkey AS ord,
  'Alloy ' || c.c_mktsegment || ' ' || {_s('c.c_nationkey')} AS Alloy,
  {_dec('50000 + c.c_nationkey * 1000', 1)} AS UTS_psi
FROM {{customer}} c
"""

# Polymer glass transitions, set A (class-level records): one per supplier.
RAW_POLYMER_A = f"""
SELECT
  s.s_suppkey AS ord,
  repeat('C', CAST(s.s_suppkey % 6 + 1 AS INT)) || '(=O)O' AS SMILES,
  CASE WHEN s.s_suppkey % 10 = 9 THEN NULL ELSE {_s('250 + (s.s_suppkey % 50) * 3')} END AS Tg,
  'P' || {_s('s.s_suppkey')} AS PID,
  CASE s.s_nationkey % 4 WHEN 0 THEN 'polyester' WHEN 1 THEN 'polyamide'
                         WHEN 2 THEN 'polyolefin' ELSE 'polyimide' END AS Polymer_Class
FROM {{supplier}} s
"""

# Polymer glass transitions with density, set B (named records): one per part.
RAW_POLYMER_B = f"""
SELECT
  p.p_partkey AS ord,
  upper(substr(p.p_type, 1, 2)) || {_s('p.p_partkey % 40')} AS abr,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE 'poly-' || p.p_name END AS name,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL
       ELSE repeat('C', CAST(p.p_size % 7 + 1 AS INT)) || '(=O)O' END AS SMILES,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE 'grade ' || p.p_brand END AS grade,
  p.p_brand AS manufacturer,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL
       WHEN p.p_partkey % 5 = 0 THEN {_s('p.p_size * 2 - 60')}
       ELSE {_s('250 + (p.p_partkey % 50) * 3')} END AS Tg,
  CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE {_dec('0.9 + p.p_size / 100', 4)} END AS Density
FROM {{part}} p
"""

VIEWS = {
    "raw_corrosion": RAW_CORROSION,
    "raw_assay": RAW_ASSAY,
    "cell_lines": CELL_LINES,
    "methods": METHODS,
    "raw_material": RAW_MATERIAL,
    "raw_hea": RAW_HEA,
    "raw_alloy": RAW_ALLOY,
    "raw_polymer_a": RAW_POLYMER_A,
    "raw_polymer_b": RAW_POLYMER_B,
}


def raw_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw view ``name`` as a Spark DataFrame over ``sf_dir``."""
    return spark_sql(spark, sf_dir, VIEWS[name])


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named raw views for the DuckDB oracle."""
    refs = duck_refs()
    parts = [f"{n} AS ({VIEWS[n].format(**refs)})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
