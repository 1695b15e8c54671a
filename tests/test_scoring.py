"""Scoring contracts, model registry, atlas labels, document endpoints, registry paths."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from matfold.functions import atlas
from matfold.operators.models import binding_features, fit_pipeline
from matfold.operators.schema import drop_text_columns
from matfold.operators.scoring import FeatureContract, LabelDecoder, ModelRegistry, fit_contract
from matfold.plans import crystals
from matfold.sources import readers, registry


def test_contract_orders_coerces_fills_and_scales(spark):
    train = spark.createDataFrame([(" 1 ", 10.0), ("3", 30.0), ("n/a", 20.0), (None, float("nan"))], "a string, ` b ` double")
    c = fit_contract(train, ["b", "a"])
    assert c.getOrDefault(c.fill) == [20.0, 2.0]
    filled = {"b": [10, 30, 20, 20], "a": [1, 3, 2, 2]}
    assert np.allclose(c.getOrDefault(c.scale), [np.std(filled["b"]), np.std(filled["a"])])
    dirty = spark.createDataFrame([("x", "2", 5), ("1d", " 4.0 ", 6)], "a string, b string, extra int")
    got = [r[0] for r in c.transform(dirty).select(vector_to_array("features")).collect()]
    sb, sa = c.getOrDefault(c.scale)
    assert np.allclose(got, [[(2 - 20) / sb, 0.0], [(4 - 20) / sb, 0.0]])
    # a missing column, and a constant feature
    alone = c.transform(dirty.select("extra")).select(vector_to_array("features")).first()[0]
    assert alone == [0.0, 0.0]
    const = fit_contract(train.withColumn("k", F.lit(7)), ["k"])
    assert const.getOrDefault(const.scale) == [1.0]
    plain = fit_contract(train, ["a"], scaled=False)
    assert plain.transform(dirty).select(vector_to_array("features")).collect()[0][0] == [2.0]


def test_registered_models_score_shuffled_and_dirty_tables(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 2))
    rows = [(float(a), float(b), float(2 * a - 3 * b + 1)) for a, b in X]
    train = spark.createDataFrame(rows, "a double, b double, y double")
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="matfold-models-", dir="/tmp"))
    assert reg.table().count() == 0
    with pytest.raises(KeyError):
        reg.load("plane")
    model = fit_pipeline(train, [fit_contract(train, ["a", "b"]), LinearRegression(labelCol="y")])
    assert reg.register("plane", model, "y", {"mae": 0.0}) == 1
    other = fit_pipeline(train, [fit_contract(train, ["b"]), LinearRegression(labelCol="y")])
    assert reg.register("plane", other, "y") == 2 and reg.register("other", other, "y") == 1
    card = {(r["name"], r["version"]): r for r in reg.table().collect()}
    assert card["plane", 1]["features"] == ["a", "b"] and card["plane", 1]["metrics"] == {"mae": 0.0} and card["plane", 2]["features"] == ["b"]
    dirty = spark.createDataFrame([("z", " 2 ", "1.5"), ("w", "-1", "bad")], "name string, b string, a string")
    got = {r["name"]: r["prediction"] for r in reg.load("plane", 1).transform(dirty).collect()}
    assert math.isclose(got["z"], 2 * 1.5 - 3 * 2 + 1, abs_tol=1e-6)
    assert math.isclose(got["w"], 2 * float(X[:, 0].mean()) + 3 + 1, abs_tol=1e-6)
    with pytest.raises(KeyError):
        reg.load("plane", 9)


def test_labels_come_back_from_a_saved_pipeline(spark):
    train = spark.createDataFrame([(float(i), 0.0 if i < 10 else 1.0) for i in range(20)], "x double, code double")
    model = fit_pipeline(train, [fit_contract(train, ["x"]), DecisionTreeClassifier(labelCol="code"), LabelDecoder(["cubic", "other"], "prediction", "structure")])
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="matfold-models-", dir="/tmp"))
    reg.register("crystal", model, "code")
    out = reg.load("crystal").transform(spark.createDataFrame([("3",), ("15 ",)], "x string")).select("structure").collect()
    assert [r[0] for r in out] == ["cubic", "other"]
    assert reg.table().first()["labels"] == ["cubic", "other"]
    codes = spark.createDataFrame([(0.0,), (5.0,), (None,)], "prediction double")
    assert [r["label"] for r in LabelDecoder(["a"]).transform(codes).collect()] == ["a", None, None]
    assert LabelDecoder().transform(codes).where("label IS NULL").count() == 3 and FeatureContract().getOrDefault("features") == []


def test_binding_features(spark):
    df = spark.createDataFrame([(1, "AAc", "CCO"), (2, None, "C1CC"), (3, "", None)], "k int, seq string, smiles string")
    got = {r["k"]: r["x"] for r in binding_features(df, "seq", "smiles").select("k", vector_to_array("features").alias("x")).collect()}
    assert all(len(x) == 2068 for x in got.values())
    assert sum(got[1][:2048]) >= 4 and math.isclose(got[1][2048], 2 / 3) and math.isclose(got[1][2049], 1 / 3)
    assert sum(got[2]) == 0 and sum(got[3]) == 0


def test_atlas_labels(spark):
    df = spark.createDataFrame([("Kidney (Left)",), ("Right Femur",), ("Hip",), ("Moon",), (None,)], "label string")
    got = [tuple(r) for r in df.select(atlas.organ_id("label"), atlas.ontology_id("label"), atlas.side("label")).collect()]
    assert got == [("kidney-left", "http://purl.obolibrary.org/obo/UBERON_0004538", "left"), ("femur-right", None, "right"),
                   ("pelvis", "http://purl.obolibrary.org/obo/UBERON_0001270", "none"), (None, None, "none"), (None, None, "none")]
    url = spark.createDataFrame([("pelvis", "male"), ("spleen", "male")], "o string, s string").select(atlas.model_url("o", "s", "http://x/")).collect()
    assert [r[0] for r in url] == ["http://x/ref-organ/pelvis/3d-vh-male-pelvis.glb", None]
    root = tempfile.mkdtemp(prefix="matfold-atlas-", dir="/tmp")
    assert atlas.load_crosswalk(spark, root) is None
    path = os.path.join(root, atlas.CROSSWALK)
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        f.write('anatomical_structure_of,label\n#VHMPelvis,"hip, left"\n')
    assert tuple(atlas.load_crosswalk(spark, root).first()) == ("#VHMPelvis", "hip, left")


def test_domains_load_by_key_alone(spark):
    root = tempfile.mkdtemp(prefix="matfold-root-", dir="/tmp")
    for key, text in {"polymers": "SMILES, Tg ,name\nCC,12,a\nCO,x,b\n", "cytotoxicity": "Name,CC50_mM,Mw,Mw.1\n a ,1,2,4\n",
                      "high_entropy": "FORMULA,PROPERTY: YS (MPa)\n AlCo ,158\n"}.items():
        path = os.path.join(root, registry.PATHS[key])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    spark.conf.set(registry.ROOT_CONF, root)
    try:
        df, meta = registry.load_and_prepare(spark, "polymers")
        assert meta["columns"] == ["SMILES", "Tg", "name"] and meta["nrows"]() == 2 and dict(df.dtypes)["Tg"] == "double"
        assert [r["Tg"] for r in df.orderBy("SMILES").collect()] == [12.0, None]
        df, _ = registry.load_and_prepare(spark, "cytotoxicity")
        assert df.first()["Name"] == "a" and df.columns == ["Name", "CC50_mM", "Mw"] and df.first()["Mw"] == 3.0
        df, _ = registry.load_and_prepare(spark, "high_entropy")
        assert tuple(df.first()) == ("AlCo", 158.0) and df.columns == ["FORMULA", "YS"]
        assert registry.load_and_prepare(spark, "corrosion") == (None, {}) and registry.load_and_prepare(spark, "nothing") == (None, {})
    finally:
        spark.conf.unset(registry.ROOT_CONF)


def test_documents_of_any_shape(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="matfold-docs-", dir="/tmp"), "docs")
    lines = ['{"material_id":"a","ord":2,"average_oxidation_state":{"Fe":2.5}}', '{"material_id":"a","ord":1,"average_oxidation_state":3,"possible_species":["x","y"]}',
             '{"material_id":"b","possible_species":"z"}', '{"ord":1}', "not json", "", "[]", '{"material_id":"c","average_bond_length":"1.5 A","bonds":[1,{"k":[]}]}']
    readers.write_documents(spark.createDataFrame([(x,) for x in lines], "t string"), path)
    docs = readers.read_documents(spark, path)
    assert sorted(r["material_id"] for r in docs.collect()) == ["a", "a", "b", "c"]
    ox = {r["material_id"]: r["oxidation_states"] for r in crystals.first_document(crystals.oxidation_endpoint(docs), "oxidation_states").collect()}
    assert ox["a"]["average_oxidation_state"] == {"all": 3.0} and ox["a"]["possible_species"] == ["x", "y"] and ox["b"]["possible_species"] == ["z"]
    bond = {r["material_id"]: r["bonding"] for r in crystals.first_document(crystals.bonding_endpoint(docs), "bonding").collect()}
    assert (bond["c"]["average_bond_length"], bond["c"]["n_bonds"], bond["a"]["n_bonds"]) == (1.5, 2, 0)


def test_text_columns_are_dropped_before_modelling(spark):
    df = spark.createDataFrame([("a", 1, "b", 2.0)], "name string, n int, label string, x double")
    assert drop_text_columns(df).columns == ["n", "x"] and drop_text_columns(df, keep=["label"]).columns == ["n", "label", "x"]
