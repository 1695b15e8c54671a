"""Crystal documents: staged endpoint tables, search, lookup, property rows.

The remote service of the original is replaced by staged endpoint tables; here
they are derived from the part table.  Summary, elasticity, thermo and magnetism
are typed; oxidation states, bonding and the description come as JSON documents
whose shape differs from one to the next and are read as VARIANT.  The document of
an id is assembled by a chain of left joins on ``material_id`` (J12); a missing
endpoint stays null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matfold.operators.dedup import first_match, keep_first
from matfold.functions.parse import to_number
from matfold.operators.documents import NOT_AVAILABLE, TRUNCATE_AT, first_truthy, flatten, key_value, overview, young_from_k_g
from matfold.plans.registry import query
from matfold.session import ensure_checkpoint_dir
from matfold.sources.readers import read_documents, write_documents
from matfold.sources.tables import spark_sql

# --- fixed values ---------------------------------------------------------
ELEMENTS = ["Fe", "Ni", "Cr", "Ti", "Al", "Cu", "Co", "Mo", "O", "Si"]
CRYSTAL_SYSTEMS = ["Cubic", "Hexagonal", "Tetragonal", "Orthorhombic", "Monoclinic", "Triclinic", "Trigonal"]
SEARCH_FIELDS = ["material_id", "pretty_formula", "density", "band_gap", "e_above_hull",
                 "crystal_system", "space_group"]
# --------------------------------------------------------------------------


def _case(expr: str, values: list[str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# One flat staging row per part; both engines run this text.
CRYSTAL_FLAT = f"""
SELECT p_partkey AS pk,
  'mp-' || CAST(p_partkey AS STRING) AS material_id,
  {_case('p_partkey % 10', ELEMENTS)} AS e1,
  {_case('(p_partkey + 3 + p_size % 5) % 10', ELEMENTS)} AS e2,
  {_case('p_size % 7', CRYSTAL_SYSTEMS)} AS crystal_system,
  'P' || CAST(p_size % 4 + 1 AS STRING) || '/m' AS space_group,
  CAST(CAST(p_retailprice / 100 AS DECIMAL(18,3)) AS DOUBLE) AS density,
  CAST(p_size AS DOUBLE) / 10 AS band_gap,
  CAST(p_partkey % 7 AS DOUBLE) / 10 AS energy_above_hull,
  CAST(-p_size AS DOUBLE) / 20 AS formation_energy_per_atom,
  CAST(CAST(p_retailprice / 5 AS DECIMAL(18,2)) AS DOUBLE) AS volume,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 0.0 ELSE CAST(p_size * 3 AS DOUBLE) END AS K_VRH,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END AS G_VRH,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size * 3 + 1 AS DOUBLE) END AS bulk_modulus,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size * 2 + 1 AS DOUBLE) END AS shear_modulus,
  CASE WHEN p_partkey % 6 = 0 THEN 'NM' WHEN p_partkey % 6 = 1 THEN 'FM' WHEN p_partkey % 6 = 2 THEN NULL ELSE 'AFM' END
    AS ordering,
  CAST(p_size % 3 AS DOUBLE) AS total_magnetization,
  p_partkey % 8 = 0 AS has_no_thermo
FROM {{part}}
"""


def staged_endpoints(spark, sf_dir) -> dict[str, DataFrame]:
    """The endpoint tables: one DataFrame each, keyed by material_id."""
    flat = spark_sql(spark, sf_dir, CRYSTAL_FLAT)
    elements = F.array_distinct(F.array("e1", "e2"))
    summary = flat.select(
        "material_id",
        F.struct(
            F.col("material_id"),
            F.concat("e1", "e2", F.lit("2")).alias("formula_pretty"),
            F.array_join(F.array_sort(elements), "-").alias("chemsys"),
            elements.alias("elements"),
            "density", "band_gap", "energy_above_hull", "formation_energy_per_atom",
            (F.col("energy_above_hull") == 0).alias("is_stable"),
            "volume",
            F.struct(F.col("crystal_system"), F.col("space_group").alias("symbol")).alias("symmetry"),
        ).alias("summary"))
    elasticity = flat.where(F.col("K_VRH").isNotNull() | F.col("bulk_modulus").isNotNull()).select(
        "material_id", F.struct("K_VRH", "G_VRH", "bulk_modulus", "shear_modulus").alias("elasticity"))
    thermo = flat.where(~F.col("has_no_thermo")).select(
        "material_id", F.struct("formation_energy_per_atom", "energy_above_hull",
                                (F.col("energy_above_hull") == 0).alias("is_stable"),
                                F.lit("GGA_GGA+U").alias("thermo_type")).alias("thermo"))
    magnetism = flat.select(
        "material_id", F.struct(
            "ordering", (F.col("total_magnetization") > 0).alias("is_magnetic"), "total_magnetization",
            F.when(F.col("total_magnetization") > 0, F.array("e1")).otherwise(F.array().cast("array<string>"))
             .alias("types_of_magnetic_species")).alias("magnetism"))
    return {"summary": summary, "elasticity": elasticity, "thermo": thermo, "magnetism": magnetism}


def assemble_documents(endpoints: dict[str, DataFrame]) -> DataFrame:
    """One nested document per id: summary left-joined with the others.

    Of several documents of an id the one with the smallest ``ord`` counts;
    endpoints without that column are ordered by their fields.
    """
    doc = endpoints["summary"]
    for name in ENDPOINTS:
        if name not in endpoints:
            continue
        ep = endpoints[name]
        if name in DOCUMENT_ENDPOINTS:  # one document an id already (first_document)
            doc = doc.join(ep, "material_id", "left")
            continue
        order = ["ord"] if "ord" in ep.columns else [c for c in ep.columns if c != "material_id"]
        first = keep_first(ep, ["material_id"], order).drop("ord")
        doc = doc.join(first, "material_id", "left")
    return doc


#: Endpoints that come as documents, and all endpoints besides the summary.
DOCUMENT_ENDPOINTS = ("oxidation_states", "bonding", "robocrys")
ENDPOINTS = ("elasticity", "thermo", "magnetism", *DOCUMENT_ENDPOINTS)


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("doc", f"$.{path}", kind)


def _texts(path: str) -> Column:
    """A list of texts, or one text that stands for a list."""
    return F.coalesce(_get(path, "array<string>"), F.when(F.schema_of_variant(_get(path, "variant")) == "STRING", F.array(_get(path, "string"))))


def _measure(path: str) -> Column:
    """A number, or a text that begins with one ('2.1 A')."""
    return F.coalesce(_get(path, "double"), to_number(F.regexp_extract(_get(path, "string"), r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1)))


def oxidation_endpoint(docs: DataFrame) -> DataFrame:
    """States per element; a document with one number for all of them holds it under 'all'."""
    average = F.coalesce(_get("average_oxidation_state", "map<string,double>"),
                         F.when(_get("average_oxidation_state", "double").isNotNull(), F.create_map(F.lit("all"), _get("average_oxidation_state", "double"))))
    return docs.select("material_id", "ord", "value", F.struct(average.alias("average_oxidation_state"), _texts("possible_species").alias("possible_species")).alias("oxidation_states"))


def bonding_endpoint(docs: DataFrame) -> DataFrame:
    return docs.select("material_id", "ord", "value", F.struct(
        _measure("average_bond_length").alias("average_bond_length"), _measure("average_coordination_number").alias("average_coordination_number"),
        F.size(F.coalesce(_get("bonds", "array<variant>"), F.array().cast("array<variant>"))).cast("long").alias("n_bonds")).alias("bonding"))


def description_endpoint(docs: DataFrame) -> DataFrame:
    return docs.select("material_id", "ord", "value", F.struct(_get("description", "string").alias("description")).alias("robocrys"))


def first_document(endpoint: DataFrame, name: str) -> DataFrame:
    """(material_id, <name>): of several documents of an id the first by ordinal (a missing one last), then by text."""
    order = F.struct(F.col("ord").isNull(), F.col("ord"), F.col("value"))
    return endpoint.groupBy("material_id").agg(F.min_by(name, order).alias(name))


def chemistry_rows(docs: DataFrame) -> DataFrame:
    """Flat view of the three document endpoints of each id."""
    ox, bond, text = F.col("oxidation_states"), F.col("bonding"), F.col("robocrys")
    states = F.map_values(ox["average_oxidation_state"])
    return docs.select(
        "material_id", F.size(F.coalesce(states, F.array().cast("array<double>"))).cast("long").alias("n_states"),
        F.aggregate(states, F.lit(0.0), lambda a, x: a + x).alias("state_sum"),
        F.array_join(F.coalesce(ox["possible_species"], F.array().cast("array<string>")), ", ").alias("species"),
        bond["average_bond_length"].alias("bond_length"), bond["average_coordination_number"].alias("coordination"),
        F.coalesce(bond["n_bonds"], F.lit(0)).cast("long").alias("n_bonds"),
        F.substring(F.coalesce(text["description"], F.lit(NOT_AVAILABLE)), 1, TRUNCATE_AT).alias("description"))


def crystal_search(docs: DataFrame, elements=None, exclude_elements=None, formula=None, chemsys=None,
                   material_ids=None, band_gap=None, density=None, energy_above_hull=None,
                   crystal_system=None, spacegroup_symbol=None, **extra) -> DataFrame:
    """Conjunctive document search; the fixed 7-column result projection.

    The hull energy is read from ``energy_above_hull`` (the original read a
    misspelled field and always got null).
    """
    s = F.col("summary")
    pred = F.lit(True)
    if elements:
        pred = pred & F.forall(F.array(*[F.lit(e) for e in elements]),
                               lambda x: F.array_contains(s["elements"], x))
    if exclude_elements:
        pred = pred & ~F.arrays_overlap(s["elements"], F.array(*[F.lit(e) for e in exclude_elements]))
    if formula:
        pred = pred & s["formula_pretty"].like(formula.replace("*", "%"))
    if chemsys:
        pred = pred & s["chemsys"].isin(list(chemsys) if not isinstance(chemsys, str) else [chemsys])
    if material_ids:
        pred = pred & s["material_id"].isin(list(material_ids))
    for name, rng in (("band_gap", band_gap), ("density", density), ("energy_above_hull", energy_above_hull)):
        if rng:
            lo, hi = rng
            pred = pred & s[name].between(lo, hi)
    if crystal_system:
        pred = pred & (s["symmetry"]["crystal_system"] == crystal_system)
    if spacegroup_symbol:
        pred = pred & (s["symmetry"]["symbol"] == spacegroup_symbol)
    for k, v in extra.items():
        if v is not None:
            pred = pred & (s[k] == v)
    return docs.where(pred).select(
        s["material_id"].alias("material_id"), s["formula_pretty"].alias("pretty_formula"),
        s["density"].alias("density"), s["band_gap"].alias("band_gap"),
        s["energy_above_hull"].alias("e_above_hull"),
        s["symmetry"]["crystal_system"].alias("crystal_system"), s["symmetry"]["symbol"].alias("space_group"))


def resolve_terms(terms: DataFrame, term_col: str, docs: DataFrame) -> DataFrame:
    """Term -> material id: an 'mp-' id is taken as is, a formula maps to its
    first id (lowest numeric id); unknown formulas give null."""
    by_formula = docs.select(F.col("summary.formula_pretty").alias("_f"),
                             F.col("material_id").alias("_id"),
                             F.substring_index(F.col("material_id"), "-", -1).cast("long").alias("_n"))
    first = first_match(by_formula, "_f", "_id", "_n").withColumnRenamed("_id", "_fid")
    t = terms.select("*", F.lower(F.col(term_col)).startswith("mp-").alias("_isid"))
    j = t.join(first, F.col(term_col) == F.col("_f"), "left")
    return j.select(*[F.col(c) for c in terms.columns],
                    F.when(F.col("_isid"), F.col(term_col)).otherwise(F.col("_fid")).alias("material_id"))


def property_rows(docs: DataFrame) -> DataFrame:
    s, th, mg, el = F.col("summary"), F.col("thermo"), F.col("magnetism"), F.col("elasticity")
    k = first_truthy(el["K_VRH"], el["bulk_modulus"])
    g = first_truthy(el["G_VRH"], el["shear_modulus"])
    return docs.select(
        s["material_id"].alias("material_id"), s["formula_pretty"].alias("formula_pretty"),
        s["chemsys"].alias("chemsys"), s["density"].alias("density"), s["band_gap"].alias("band_gap"),
        F.coalesce(th["energy_above_hull"], s["energy_above_hull"]).alias("energy_above_hull"),
        F.coalesce(th["formation_energy_per_atom"], s["formation_energy_per_atom"]).alias("formation_energy_per_atom"),
        F.coalesce(th["is_stable"], s["is_stable"]).alias("is_stable"),
        F.coalesce(s["symmetry"]["crystal_system"], F.lit("N/A")).alias("crystal_system"),
        F.coalesce(s["symmetry"]["symbol"], F.lit("N/A")).alias("space_group"),
        s["volume"].alias("volume"),
        F.when(th.isNotNull(), F.coalesce(th["thermo_type"], F.lit("N/A"))).alias("thermo_type"),
        mg["ordering"].alias("ordering"),
        F.coalesce(mg["is_magnetic"], F.lit(False)).alias("is_magnetic"),
        mg["total_magnetization"].alias("total_magnetization"),
        F.array_join(F.coalesce(mg["types_of_magnetic_species"], F.array().cast("array<string>")), ", ")
         .alias("types_of_magnetic_species"),
        k.alias("K_VRH"), g.alias("G_VRH"), el["bulk_modulus"].alias("bulk_modulus"),
        el["shear_modulus"].alias("shear_modulus"),
        young_from_k_g(k, g).alias("E_est_GPa"))


def load_docs(spark, sf_dir):
    return assemble_documents(staged_endpoints(spark, sf_dir))


# ---------------------------------------------------------------- queries

_FLAT_SQL = "WITH flat AS (" + CRYSTAL_FLAT.format(part="part") + """),
 docs AS (
  SELECT material_id, e1 || e2 || '2' AS formula_pretty,
         CASE WHEN e1 = e2 THEN e1 WHEN e1 < e2 THEN e1 || '-' || e2 ELSE e2 || '-' || e1 END AS chemsys,
         CASE WHEN e1 = e2 THEN [e1] ELSE [e1, e2] END AS elements,
         density, band_gap, energy_above_hull, formation_energy_per_atom, energy_above_hull = 0 AS is_stable,
         volume, crystal_system, space_group, K_VRH, G_VRH, bulk_modulus, shear_modulus,
         (K_VRH IS NOT NULL OR bulk_modulus IS NOT NULL) AS has_el, has_no_thermo, ordering,
         total_magnetization, pk, e1
  FROM flat)
"""

_SEARCH_KW = dict(elements=["Fe"], exclude_elements=["O"], band_gap=(0.5, 4.0), density=(9.2, 9.9),
                  energy_above_hull=(0.0, 0.3))


@query("crystal_search", oracle=_FLAT_SQL + """
SELECT material_id, formula_pretty AS pretty_formula, density, band_gap, energy_above_hull AS e_above_hull,
       crystal_system, space_group
FROM docs
WHERE list_contains(elements, 'Fe') AND NOT list_contains(elements, 'O')
  AND band_gap BETWEEN 0.5 AND 4.0 AND density BETWEEN 9.2 AND 9.9 AND energy_above_hull BETWEEN 0.0 AND 0.3
""")
def q_crystal_search(spark, sf_dir):
    return crystal_search(load_docs(spark, sf_dir), **_SEARCH_KW)


@query("crystal_search_formula", oracle=_FLAT_SQL + """
SELECT material_id, formula_pretty AS pretty_formula, density, band_gap, energy_above_hull AS e_above_hull,
       crystal_system, space_group
FROM docs WHERE formula_pretty LIKE 'Ti%' AND crystal_system = 'Cubic'
""")
def q_crystal_search_formula(spark, sf_dir):
    return crystal_search(load_docs(spark, sf_dir), formula="Ti*", crystal_system="Cubic")


_TERMS = """
SELECT p_partkey AS tk, CASE WHEN p_partkey % 3 = 0 THEN 'mp-' || CAST(p_partkey * 7 % 1000 AS STRING)
            WHEN p_partkey % 3 = 1 THEN {e1} || {e2} || '2' ELSE 'Xx' || CAST(p_size AS STRING) END AS term
FROM {{part}}
""".format(e1=_case('p_partkey % 10', ELEMENTS), e2=_case('(p_partkey + 3 + p_size % 5) % 10', ELEMENTS))


@query("crystal_lookup", oracle=_FLAT_SQL + ", terms AS (" + _TERMS.format(part="part") + """),
  firsts AS (SELECT formula_pretty, arg_min(material_id, pk) AS fid FROM docs GROUP BY formula_pretty)
SELECT t.tk, t.term, CASE WHEN starts_with(lower(t.term), 'mp-') THEN t.term ELSE f.fid END AS material_id
FROM terms t LEFT JOIN firsts f ON t.term = f.formula_pretty
""")
def q_crystal_lookup(spark, sf_dir):
    terms = spark_sql(spark, sf_dir, _TERMS)
    return resolve_terms(terms, "term", load_docs(spark, sf_dir))


_PROPS_SQL = _FLAT_SQL + """, props AS (
  SELECT material_id, formula_pretty, chemsys, density, band_gap, energy_above_hull, formation_energy_per_atom,
         is_stable, crystal_system, space_group, volume,
         CASE WHEN has_no_thermo THEN NULL ELSE 'GGA_GGA+U' END AS thermo_type,
         ordering, coalesce(total_magnetization > 0, FALSE) AS is_magnetic, total_magnetization,
         CASE WHEN total_magnetization > 0 THEN e1 ELSE '' END AS types_of_magnetic_species,
         CASE WHEN NOT has_el THEN NULL ELSE coalesce(nullif(K_VRH, 0), bulk_modulus) END AS K_VRH,
         CASE WHEN NOT has_el THEN NULL ELSE coalesce(nullif(G_VRH, 0), shear_modulus) END AS G_VRH,
         CASE WHEN has_el THEN bulk_modulus END AS bulk_modulus,
         CASE WHEN has_el THEN shear_modulus END AS shear_modulus
  FROM docs)
"""


@query("crystal_properties", oracle=_PROPS_SQL + """
SELECT * EXCLUDE (density, volume), round(density, 6) AS density, round(volume, 6) AS volume,
       round(CASE WHEN K_VRH <> 0 AND G_VRH <> 0 THEN 9 * K_VRH * G_VRH / (3 * K_VRH + G_VRH) END, 6) AS E_est_GPa
FROM props
""")
def q_crystal_properties(spark, sf_dir):
    p = property_rows(load_docs(spark, sf_dir))
    return p.select(*[F.round(c, 6).alias(c) if c in ("density", "volume", "E_est_GPa") else F.col(c)
                      for c in p.columns])


@query("flatten_doc", oracle=_FLAT_SQL + """
SELECT material_id, material_id AS "summary.material_id", formula_pretty AS "summary.formula_pretty",
       chemsys AS "summary.chemsys", elements AS "summary.elements", density AS "summary.density",
       band_gap AS "summary.band_gap", energy_above_hull AS "summary.energy_above_hull",
       formation_energy_per_atom AS "summary.formation_energy_per_atom", is_stable AS "summary.is_stable",
       volume AS "summary.volume", crystal_system AS "summary.symmetry.crystal_system",
       space_group AS "summary.symmetry.symbol"
FROM docs
""")
def q_flatten_doc(spark, sf_dir):
    return flatten(staged_endpoints(spark, sf_dir)["summary"])


@query("clean_kv", oracle=_PROPS_SQL + """
, kv AS (UNPIVOT (SELECT material_id, CAST(formula_pretty AS VARCHAR) AS formula_pretty,
                         CAST(crystal_system AS VARCHAR) AS crystal_system, CAST(thermo_type AS VARCHAR) AS thermo_type,
                         CAST(ordering AS VARCHAR) AS ordering,
                         CAST(types_of_magnetic_species AS VARCHAR) AS types_of_magnetic_species
                  FROM props)
         ON formula_pretty, crystal_system, thermo_type, ordering, types_of_magnetic_species
         INTO NAME key VALUE value)
SELECT material_id, key, value FROM kv
WHERE value IS NOT NULL AND trim(value) NOT IN ('N/A', 'None', 'nan', '')
""")
def q_clean_kv(spark, sf_dir):
    p = property_rows(load_docs(spark, sf_dir))
    return key_value(p, "material_id", ["formula_pretty", "crystal_system", "thermo_type", "ordering",
                                        "types_of_magnetic_species"])


@query("crystal_overview", oracle=_PROPS_SQL + """
SELECT substr(material_id, 1, 80) AS material_id, substr(coalesce(formula_pretty, 'N/A'), 1, 80) AS formula_pretty,
       coalesce(band_gap, 0.0) AS band_gap, substr(coalesce(ordering, 'unknown'), 1, 80) AS ordering
FROM props
""")
def q_crystal_overview(spark, sf_dir):
    p = property_rows(load_docs(spark, sf_dir))
    return overview(p, {"material_id": "N/A", "formula_pretty": "N/A", "band_gap": 0.0, "ordering": "unknown"})


# JSON texts of the three document endpoints: one or two documents an id, of several shapes, some lines broken.
_ID = """'"material_id":"mp-' || CAST(p_partkey AS STRING) || '"'"""
CRYSTAL_DOCUMENTS = {
    "oxidation_states": f"""
SELECT CASE p_partkey % 5
  WHEN 0 THEN '{{{{' || {_ID} || ',"average_oxidation_state":{{{{"Fe":2,"O":-' || CAST(p_size % 3 AS STRING) || '}}}},"possible_species":["Fe2+","O2-"],"ord":1}}}}'
  WHEN 1 THEN '{{{{"ord":2,' || {_ID} || ',"average_oxidation_state":' || CAST(p_size AS STRING) || ',"possible_species":"Ti4+"}}}}'
  WHEN 2 THEN '{{{{' || {_ID} || ',"average_oxidation_state":null,"possible_species":null}}}}'
  WHEN 3 THEN '{{{{' || {_ID} || ',"average_oxidation_state":{{{{}}}},"extra":[1,[2]]}}}}'
  ELSE '{{{{"broken' END AS value
FROM {{part}}
UNION ALL
SELECT '{{{{' || {_ID} || ',"ord":0,"average_oxidation_state":7}}}}' FROM {{part}} WHERE p_partkey % 10 = 5
UNION ALL
SELECT '{{{{' || {_ID} || ',"average_oxidation_state":9}}}}' FROM {{part}} WHERE p_partkey % 10 = 6""",
    "bonding": f"""
SELECT CASE p_partkey % 4
  WHEN 0 THEN '{{{{' || {_ID} || ',"average_bond_length":2.5,"average_coordination_number":' || CAST(p_size AS STRING) || ',"bonds":[[0,1],{{{{"a":1}}}},"x"]}}}}'
  WHEN 1 THEN '{{{{' || {_ID} || ',"average_bond_length":"' || CAST(p_size AS STRING) || '.5 A","bonds":[]}}}}'
  WHEN 2 THEN '[1, 2]'
  ELSE '{{{{' || {_ID} || ',"bonds":"none"}}}}' END AS value
FROM {{part}}""",
    "robocrys": f"""
SELECT '{{{{' || {_ID} || ',"description":"' || p_name || ' crystallizes. ' || repeat('x', CAST(p_size AS INT) * 2) || '"}}}}' AS value FROM {{part}} WHERE p_partkey % 3 > 0""",
}


def staged_documents(spark, sf_dir) -> dict[str, DataFrame]:
    """The document endpoints, staged as JSON lines in the shared folder and read back."""
    makers = {"oxidation_states": oxidation_endpoint, "bonding": bonding_endpoint, "robocrys": description_endpoint}
    out = {}
    for name, text in CRYSTAL_DOCUMENTS.items():
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents-{name}-{uuid.uuid4().hex}"
        write_documents(spark_sql(spark, sf_dir, text), path)
        out[name] = first_document(makers[name](read_documents(spark, path)), name)
    return out


def load_all_docs(spark, sf_dir) -> DataFrame:
    """Documents of all seven endpoints."""
    return assemble_documents(staged_endpoints(spark, sf_dir) | staged_documents(spark, sf_dir))


@query("crystal_chemistry", oracle="""
SELECT 'mp-' || p_partkey AS material_id,
  CAST(CASE WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 5 THEN 2 WHEN p_partkey % 10 = 5 OR p_partkey % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_states,
  CASE WHEN p_partkey % 10 = 5 THEN 7.0 WHEN p_partkey % 5 = 0 THEN 2.0 - p_size % 3 WHEN p_partkey % 5 = 1 THEN CAST(p_size AS DOUBLE)
       WHEN p_partkey % 5 = 3 THEN 0.0 END AS state_sum,
  CASE WHEN p_partkey % 10 = 5 THEN '' WHEN p_partkey % 5 = 0 THEN 'Fe2+, O2-' WHEN p_partkey % 5 = 1 THEN 'Ti4+' ELSE '' END AS species,
  CASE p_partkey % 4 WHEN 0 THEN 2.5 WHEN 1 THEN p_size + 0.5 END AS bond_length,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) END AS coordination,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 3 ELSE 0 END AS BIGINT) AS n_bonds,
  CASE WHEN p_partkey % 3 > 0 THEN substr(p_name || ' crystallizes. ' || repeat('x', CAST(p_size * 2 AS INT)), 1, 80) ELSE 'N/A' END AS description
FROM part
""")
def q_crystal_chemistry(spark, sf_dir):
    return chemistry_rows(load_all_docs(spark, sf_dir))
