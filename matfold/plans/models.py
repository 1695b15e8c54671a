"""Model queries: fingerprints, forests, trees, networks, selection, scoring.

Trained models depend on Spark ML's random seeds and split points, so these
queries are checked on row counts and in the tests (metric sanity, save/load
round trip); ``knn_regress`` is exact and has a DuckDB oracle.
"""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.functions.chem import AMINO_ACIDS, letter_frequencies
from matfold.functions.score import log10_target, toxic_flag
from matfold.operators.knn import knn_candidates, knn_regress
from matfold.operators.models import add_fingerprint, assembler, binding_features, fit_pipeline, materialize
from matfold.operators.prep import (auc, class_weights, classification_report, fit_means, fit_standard,
                                    hash_split, impute, regression_metrics, standardize, stratified_split)
from matfold.operators.scoring import ModelRegistry, fit_contract
from matfold.plans import sqlfrag as S
from matfold.plans.assays import load_records
from matfold.plans.joins import _FM_SQL, _fm_inputs, feature_matrix
from matfold.plans.features import _PROTEIN
from matfold.plans.registry import query
from matfold.plans.search import USE_RULE
from matfold.sources.raw_views import duck_cte, raw_view
from matfold.sources.tables import read_table, spark_sql
from matfold.functions.parse import strip_suffix_int, to_number

SEED = 42


def qsar_table(spark, sf_dir) -> DataFrame:
    r = load_records(spark, sf_dir)
    t = r.where(F.col("CC50_mM") > 0).select(
        "ord", "Canonical_SMILES", to_number("Mw").alias("Mw"),
        F.regexp_replace("source_file", r"\.csv$", "").alias("Family"),
        log10_target("CC50_mM").alias("log_cc50"), toxic_flag("CC50_mM").alias("toxic"))
    t = add_fingerprint(t, "Canonical_SMILES")
    return hash_split(t.fillna({"Mw": 0.0}), "ord")


@query("fingerprint")
def q_fingerprint(spark, sf_dir):
    r = load_records(spark, sf_dir).select("ord", "Canonical_SMILES")
    fp = add_fingerprint(r, "Canonical_SMILES")
    arr = vector_to_array("fp")
    return fp.select("ord", F.size(arr).alias("n_bits"),
                     F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).cast("int").alias("bits_set"))


@query("rf_qsar")
def q_rf_qsar(spark, sf_dir, trees: int = 300, depth: int = 30):
    """Forests on fingerprints: regression of log10 CC50 and the toxic class."""
    t = materialize(qsar_table(spark, sf_dir))
    fam = StringIndexer(inputCol="Family", outputCol="Family_enc", handleInvalid="keep")
    asm = assembler(["fp", "Mw", "Family_enc"])
    train, test = t.where(F.col("split") == "train"), t.where(F.col("split") == "test")
    reg = fit_pipeline(train, [fam, asm, RandomForestRegressor(labelCol="log_cc50", numTrees=trees, maxDepth=depth,
                                                               featureSubsetStrategy="sqrt", seed=SEED)])
    clf = fit_pipeline(train, [fam, asm, RandomForestClassifier(labelCol="toxic", numTrees=trees, maxDepth=depth,
                                                                featureSubsetStrategy="sqrt", seed=SEED)])
    rp = reg.transform(test)
    cp = materialize(clf.transform(test).select("toxic", vector_to_array("probability")[1].alias("p1"),
                                                F.col("prediction").cast("int").alias("pred")))
    rm = regression_metrics(rp, "log_cc50", "prediction").select(
        F.lit("regressor").alias("model"), F.col("r2").alias("score_1"), F.col("mae").alias("score_2"))
    acc = classification_report(cp, "toxic", "pred").select("accuracy").limit(1)
    a = auc(cp, "toxic", "p1")
    cm = a.select(F.lit("classifier").alias("model"), F.col("auc").alias("score_1"),
                  F.lit(None).cast("double").alias("score_2"))
    return rm.unionByName(cm).unionByName(acc.select(F.lit("classifier_accuracy").alias("model"),
                                                     F.col("accuracy").alias("score_1"),
                                                     F.lit(None).cast("double").alias("score_2")))


def material_rule_table(spark, sf_dir) -> DataFrame:
    raw = raw_view(spark, sf_dir, "raw_material")
    df = raw.select("ord", strip_suffix_int("Sy").cast("double").alias("Sy"),
                    *[to_number(c).alias(c) for c in ("Su", "E", "G", "mu", "Ro")])
    cond = F.lit(True)
    for c, (lo, hi) in USE_RULE.items():
        cond = cond & F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    return df.select("*", cond.cast("int").alias("use")).fillna(0.0)


@query("tree_rule")
def q_tree_rule(spark, sf_dir):
    df = hash_split(material_rule_table(spark, sf_dir), "ord")
    cols = list(USE_RULE)
    model = fit_pipeline(df.where(F.col("split") == "train"),
                         [assembler(cols), DecisionTreeClassifier(labelCol="use", seed=SEED)])
    pred = materialize(model.transform(df.where(F.col("split") == "test")).select(
        "use", F.col("prediction").cast("int").alias("pred")))
    return classification_report(pred, "use", "pred")


def protein_table(spark, sf_dir) -> DataFrame:
    p = spark_sql(spark, sf_dir, _PROTEIN)
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    comp = docs.select("doc_id", *letter_frequencies("text"))
    t = p.join(lab, "doc_id").join(comp, "doc_id")
    return hash_split(t.select("*", (F.col("quality") * 2 + F.col("toxic")).alias("state"),
                               (F.col("Number_of_Chains") + 1).alias("count")), "doc_id")


_PROT_FEATS = ["Number_of_Residues", "Number_of_Chains", "Helix", "Sheet", "Coil",
               "Molecular_Weight_per_Deposited_Model"]


@query("mlp_state")
def q_mlp_state(spark, sf_dir, hidden: tuple[int, ...] = (128, 64, 32), epochs: int = 100, rounds: int = 100):
    """Perceptron for the state class, boosted trees for the chain count."""
    t = materialize(protein_table(spark, sf_dir))
    train, test = t.where(F.col("split") == "train"), t.where(F.col("split") == "test")
    feats = _PROT_FEATS + [f"aa_{c}" for c in "ACDEFGHIKLMNPQRSTVWY"]
    stats = fit_standard(train, feats)
    train, test = standardize(train, stats), standardize(test, stats)
    mlp = MultilayerPerceptronClassifier(labelCol="state", layers=[len(feats), *hidden, 4], maxIter=epochs, seed=SEED)
    clf = fit_pipeline(train, [assembler(feats), mlp])
    gbt = fit_pipeline(train, [assembler(feats), GBTRegressor(labelCol="count", maxIter=rounds, seed=SEED)])
    cp = materialize(clf.transform(test).select(F.col("state").cast("int").alias("y"),
                                                F.col("prediction").cast("int").alias("p")))
    gp = gbt.transform(test)
    rep = classification_report(cp, "y", "p")
    mae = regression_metrics(gp, "count", "prediction")
    return rep.select(F.col("cls").cast("string").alias("item"), "f1", "support") \
              .unionByName(mae.select(F.lit("count_mae").alias("item"), F.col("mae").alias("f1"),
                                      F.col("n").alias("support")))


@query("binding_weighted")
def q_binding_weighted(spark, sf_dir, iterations: int = 100):
    """Binary classifier with balanced class weights (weightCol).

    Stratified split; weights and scaling come from the training side alone.
    """
    t = materialize(stratified_split(protein_table(spark, sf_dir).drop("split"), "doc_id", "toxic"))
    train, test = t.where(F.col("split") == "train"), t.where(F.col("split") == "test")
    stats = fit_standard(train, _PROT_FEATS)
    train = standardize(train, stats).join(class_weights(train, "toxic").select("toxic", "weight"), "toxic")
    model = fit_pipeline(train, [assembler(_PROT_FEATS),
                                 LogisticRegression(labelCol="toxic", weightCol="weight", maxIter=iterations)])
    pred = materialize(model.transform(standardize(test, stats)).select(
        "toxic", F.col("prediction").cast("int").alias("pred")))
    return classification_report(pred, "toxic", "pred")


MODULUS_FEATURES = ["Su", "Ro", "Bhn"]


def modulus_table(spark, sf_dir) -> DataFrame:
    """Rows with a target; missing features get the column's mean."""
    raw = raw_view(spark, sf_dir, "raw_material")
    df = raw.select("ord", to_number("Su").alias("Su"), to_number("Ro").alias("Ro"),
                    to_number("Bhn").alias("Bhn"), (to_number("E") / 1000.0).alias("E_GPa"))
    df = df.where(F.col("E_GPa").isNotNull())
    return hash_split(impute(df, fit_means(df, MODULUS_FEATURES)), "ord")


@query("select_model")
def q_select_model(spark, sf_dir, trees: int = 200, depth: int = 30):
    """kNN(7) on scaled features against a random forest on raw ones, by test
    R^2; the forest is chosen only where it is better."""
    t = materialize(modulus_table(spark, sf_dir))
    train, test = t.where(F.col("split") == "train"), t.where(F.col("split") == "test")
    stats = fit_standard(train, MODULUS_FEATURES)
    scaled = lambda df: standardize(df, stats).withColumn("vec", F.array(*MODULUS_FEATURES))
    kp = knn_regress(scaled(train), scaled(test), "ord", "vec", "E_GPa", k=7).join(test.select("ord", "E_GPa"), "ord")
    # each row keeps its node of every tree, so no level walks the deep trees from their roots; the trees are the same
    rf = fit_pipeline(train, [assembler(MODULUS_FEATURES),
                              RandomForestRegressor(labelCol="E_GPa", numTrees=trees, maxDepth=depth, cacheNodeIds=True, seed=SEED)])
    rp = rf.transform(test)
    km = regression_metrics(kp, "E_GPa", "prediction").select(F.lit("knn7").alias("model"), "r2", "mae")
    fm = regression_metrics(rp, "E_GPa", "prediction").select(F.lit("forest").alias("model"), "r2", "mae")
    both = materialize(km.unionByName(fm))
    best = both.orderBy(F.desc("r2"), F.desc("model")).limit(1).select("model", F.lit(True).alias("chosen"))
    return both.join(best, "model", "left").fillna({"chosen": False})


# Raw texts with blanks, words and units in them, columns in another order than the model's.
_DIRTY = """
SELECT ord, Bhn, CASE WHEN ord % 9 = 0 THEN 'n/a' ELSE Su END AS Su, CASE ord % 8 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || Ro || ' ' ELSE Ro END AS Ro, E
"""
_SPLIT_SQL = "CASE WHEN CAST(('0x' || substr(md5(CAST(ord AS VARCHAR) || '42'), 1, 8)) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END"
_PAIRS = [("1", "1"), ("1", "2"), ("1", "3"), ("2", "2"), ("2", "3"), ("3", "3")]


# Least squares on three features in closed form (Cramer's rule on the covariances).
_SCORE_SQL = duck_cte("raw_material") + f""",
dirty AS ({_DIRTY} FROM raw_material),
t AS (SELECT ord, {S.to_number('Su')} AS x1, {S.to_number('Ro')} AS x2, {S.to_number('Bhn')} AS x3, {S.to_number('E')} / 1000.0 AS y, {_SPLIT_SQL} AS split
      FROM dirty WHERE {S.to_number('E')} IS NOT NULL),
m AS (SELECT coalesce(avg(x1), 0) AS m1, coalesce(avg(x2), 0) AS m2, coalesce(avg(x3), 0) AS m3 FROM t WHERE split = 'train'),
f AS (SELECT ord, y, split, coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2, coalesce(x3, m3) AS x3 FROM t, m),
c AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(x3) AS a3, avg(y) AS ay, {', '.join(f'covar_pop(x{a}, x{b}) AS s{a}{b}' for a, b in _PAIRS)},
             covar_pop(x1, y) AS t1, covar_pop(x2, y) AS t2, covar_pop(x3, y) AS t3 FROM f WHERE split = 'train'),
d AS (SELECT *, s11*(s22*s33-s23*s23) - s12*(s12*s33-s23*s13) + s13*(s12*s23-s22*s13) AS det FROM c),
b AS (SELECT *, (t1*(s22*s33-s23*s23) - s12*(t2*s33-s23*t3) + s13*(t2*s23-s22*t3)) / det AS b1,
                (s11*(t2*s33-s23*t3) - t1*(s12*s33-s23*s13) + s13*(s12*t3-t2*s13)) / det AS b2,
                (s11*(s22*t3-t2*s23) - s12*(s12*t3-t2*s13) + t1*(s12*s23-s22*s13)) / det AS b3 FROM d)
SELECT ord, y AS E_GPa, round(ay + b1*(x1-a1) + b2*(x2-a2) + b3*(x3-a3), 4) AS E_pred FROM f, b
"""


@query("batch_score", oracle=_SCORE_SQL)
def q_batch_score(spark, sf_dir):
    """Fit behind a scoring contract, register, load, score the whole dirty table."""
    raw_view(spark, sf_dir, "raw_material").createOrReplaceTempView("mf_raw_material_score")
    dirty = spark.sql(_DIRTY + "FROM mf_raw_material_score")
    rows = hash_split(dirty.withColumn("E_GPa", to_number("E") / 1000.0).where("E_GPa IS NOT NULL"), "ord")
    train = rows.where(F.col("split") == "train")
    contract = fit_contract(train, MODULUS_FEATURES)
    model = fit_pipeline(train, [contract, LinearRegression(labelCol="E_GPa")])
    registry = ModelRegistry(spark)
    version = registry.register("modulus_linear", model, "E_GPa")
    scored = registry.load("modulus_linear", version).transform(rows.drop("split"))
    return scored.select("ord", "E_GPa", F.round("prediction", 4).alias("E_pred"))


@query("binding_features", oracle="""
SELECT doc_id, CAST(2068 AS BIGINT) AS n_features, doc_id % 4 <> 0 AS has_ligand,
       """ + ", ".join(f"round((length(t) - length(replace(replace(t, '{ch}', ''), '{ch.lower()}', ''))) / greatest(length(t), 1), 9) AS aa_{ch}" for ch in AMINO_ACIDS) + """
FROM (SELECT doc_id, replace(coalesce(text, ''), 'ß', 'SS') AS t FROM documents)
""")
def q_binding_features(spark, sf_dir):
    """Ligand bits and amino-acid shares of every document taken as a sequence; every fourth has a ligand with a fault."""
    ligand = F.expr("CASE doc_id % 4 WHEN 0 THEN 'C1CC)' WHEN 1 THEN 'CCO' WHEN 2 THEN 'c1ccccc1.[Na+]' ELSE 'C%12CC%12' END")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", ligand.alias("ligand"))
    x = vector_to_array("features")
    f = binding_features(docs, "text", "ligand").select("doc_id", x.alias("x"))
    bits = F.aggregate(F.slice("x", 1, 2048), F.lit(0.0), lambda a, v: a + v)
    return f.select("doc_id", F.size("x").cast("long").alias("n_features"), (bits > 0).alias("has_ligand"),
                    *[F.round(F.element_at("x", 2049 + i), 9).alias(f"aa_{ch}") for i, ch in enumerate(AMINO_ACIDS)])


_KNN_SQL = """
WITH e AS (SELECT vec_id, embedding, CAST(label AS DOUBLE) AS label,
                  CASE WHEN CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '42'), 1, 8)) AS BIGINT) % 100 < 80
                       THEN 'train' ELSE 'test' END AS split FROM embeddings),
  d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label,
               list_sum(list_transform(list_zip(q.embedding, t.embedding),
                                       lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS dist
        FROM e q, e t WHERE q.split = 'test' AND t.split = 'train'),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d)
SELECT qid AS vec_id, round(avg(label), 9) AS prediction, CAST(count(*) AS BIGINT) AS n_neighbors
FROM r WHERE rn <= 7 GROUP BY qid
"""


@query("knn_regress", oracle=_KNN_SQL)
def q_knn_regress(spark, sf_dir):
    e = hash_split(read_table(spark, sf_dir, "embeddings"), "vec_id")
    train = e.where(F.col("split") == "train").select("vec_id", "embedding", F.col("label").cast("double"))
    test = e.where(F.col("split") == "test").select("vec_id", "embedding")
    out = knn_regress(train, test, "vec_id", "embedding", "label", k=7)
    return out.select("vec_id", F.round("prediction", 9).alias("prediction"), "n_neighbors")


# Prices and sizes in coarse steps: a part has many others at the same distance.
_TIE_ROWS = "SELECT p_partkey AS id, CAST(p_size % 6 AS DOUBLE) AS x1, CAST(p_partkey % 5 AS DOUBLE) AS x2, CAST(p_retailprice AS DOUBLE) AS y, p_partkey % 10 = 0 AS asked FROM {part}"


@query("knn_ties", oracle="WITH t AS (" + _TIE_ROWS.format(part="part") + """),
r AS (SELECT q.id AS test_id, a.id AS train_id, (q.x1 - a.x1) ** 2 + (q.x2 - a.x2) ** 2 AS dist,
             row_number() OVER (PARTITION BY q.id ORDER BY (q.x1 - a.x1) ** 2 + (q.x2 - a.x2) ** 2, a.id) AS rn
      FROM t q JOIN t a ON q.asked AND NOT a.asked)
SELECT test_id, train_id, dist FROM r WHERE rn <= 7
""")
def q_knn_ties(spark, sf_dir):
    """The seven nearest parts of every tenth part, equal distances by id."""
    t = spark_sql(spark, sf_dir, _TIE_ROWS).select("id", F.array("x1", "x2").alias("vec"), "y", "asked")
    return knn_candidates(t.where("NOT asked"), t.where("asked"), "id", "vec", "y", k=7).select("test_id", "train_id", "dist")


@query("tg_regress")
def q_tg_regress(spark, sf_dir):
    """Glass-transition regression on structure fingerprints with a
    standardised target (kept with the model and inverted after scoring)."""
    from matfold.operators.prep import fit_standard, unstandardize
    from matfold.plans.polymers import polymer_training
    t = polymer_training(raw_view(spark, sf_dir, "raw_polymer_b"), raw_view(spark, sf_dir, "raw_polymer_a"))
    t = hash_split(add_fingerprint(t, "SMILES"), "SMILES")
    (m, s), = fit_standard(t.where(F.col("split") == "train"), ["Tg"]).values()
    t = t.withColumn("Tg_z", (F.col("Tg") - m) / s)
    model = fit_pipeline(t.where(F.col("split") == "train"),
                         [assembler(["fp"]), LinearRegression(labelCol="Tg_z", regParam=0.1)])
    pred = model.transform(t).select("SMILES", "split", "Tg",
                                     unstandardize("prediction", m, s).alias("Tg_pred"))
    return pred


@query("training_matrix", oracle=_FM_SQL)
def q_training_matrix(spark, sf_dir):
    """Three-domain feature matrix assembled into one vector per master item, read back by its places."""
    fm = feature_matrix(*_fm_inputs(spark, sf_dir))
    cols = [c for c in fm.columns if c not in ("material_name", "y")]
    X = assembler(cols, "X").transform(fm).select("material_name", "y", vector_to_array("X").alias("X"))
    return X.select("material_name", *[F.round("y" if c == "y" else F.element_at("X", cols.index(c) + 1), 6).alias(c) for c in fm.columns if c != "material_name"])
