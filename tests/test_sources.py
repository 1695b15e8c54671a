"""Readers, writers, registry and the streaming path on temporary folders."""

import os
import tempfile

from pyspark.sql import functions as F

from matfold.operators.models import load_model, save_model
from matfold.sources import readers, registry, writers
from matfold.sources.raw_views import raw_view
from matfold.streaming import corrosion as stream_corrosion


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_csv_readers(spark):
    d = tempfile.mkdtemp(prefix="matfold-src-", dir="/tmp")
    _write(os.path.join(d, "a.csv"), 'Name,"Mw, g*mol-1",CC50\nx,"1,5",12\n"y, z",2,>3\n')
    _write(os.path.join(d, "b.csv"), 'Name,"Mw. g*mol-1",CC50\nq,3,4\n')
    _write(os.path.join(d, "c.csv"), 'Name,"Mw, g*mol-1",CC50\nr,4,5\n')
    _write(os.path.join(d, "methods.csv"), "Method abbreviation\nMTT\n")
    df = readers.read_csv_dir(spark, d, exclude=["methods.csv"])
    rows = sorted((r["Name"], r["source_file"]) for r in df.collect())
    assert rows == [("q", "b.csv"), ("r", "c.csv"), ("x", "a.csv"), ("y, z", "a.csv")]
    assert df.columns == ["Name", "Mw, g*mol-1", "CC50", "source_file"]  # two spellings, one column
    assert dict(df.dtypes)["CC50"] == "string"
    assert readers.read_csv_if_exists(spark, os.path.join(d, "nope.csv")) is None
    semi = os.path.join(d, "semi.txt")
    _write(semi, "Metal;Symbol;E\nIron;Fe;211\n")
    assert readers.read_csv(spark, semi, sep=";").columns == ["Metal", "Symbol", "E"]
    latin = os.path.join(d, "latin.txt")
    _write(latin, "Material\nAcier inoxydable é\n", encoding="latin-1")
    assert readers.needs_latin1(spark, latin)
    assert readers.read_csv_any_encoding(spark, latin).first()[0] == "Acier inoxydable é"


def test_writers_and_registry(spark):
    d = tempfile.mkdtemp(prefix="matfold-out-", dir="/tmp")
    df = spark.createDataFrame([("A", 1.0), ("B", None)], "k string, v double")
    writers.write_table(df, os.path.join(d, "t.parquet"))
    writers.write_table(df, os.path.join(d, "t.csv"), fmt="csv")
    assert spark.read.parquet(os.path.join(d, "t.parquet")).count() == 2
    assert spark.read.option("header", True).csv(os.path.join(d, "t.csv")).columns == ["k", "v"]
    writers.write_json_record(spark, {"rows": 2, "ok": True}, os.path.join(d, "meta"))
    assert spark.read.json(os.path.join(d, "meta")).first()["rows"] == 2
    out = writers.run_sql(spark, "SELECT :x + 1 AS y", {"x": 41})
    assert out.first()["y"] == 42
    card = registry.schema_card(spark, "corrosion")
    assert card.count() == len(registry.DOMAINS["corrosion"].columns)
    p = os.path.join(d, "corr.csv")
    _write(p, "Environment ,Rate (mm/yr) or Rating\nwater,0.05 max\nacid,B\n")
    prepared, meta = registry.load_and_prepare(spark, "corrosion", p)
    assert "Rate_(mm/yr)_or_Rating_numeric" in meta["columns"] and meta["nrows"]() == 2
    assert registry.load_and_prepare(spark, "corrosion", os.path.join(d, "missing.csv")) == (None, {})


def test_model_round_trip(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from matfold.operators.models import fit_pipeline, model_dir
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    m = fit_pipeline(df, [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")])
    path = save_model(m, model_dir(spark, "test_linear"))
    pred = load_model(path).transform(df).select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert pred < 1e-6


def test_streaming_scores_match_batch(spark):
    d = tempfile.mkdtemp(prefix="matfold-stream-", dir="/tmp")
    raw = raw_view(spark, "/root/testdata/sf0.001", "raw_corrosion")
    raw.repartition(3).write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = stream_corrosion.record_stream(spark, os.path.join(d, "in"), raw.schema, max_files_per_trigger=1)
    q = stream_corrosion.start(stream_corrosion.material_scores(stream), "corr_scores_test",
                               checkpoint=os.path.join(d, "ckpt"))
    q.processAllAvailable()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM corr_scores_test").collect())
    q.stop()
    from matfold.plans.corrosion import corrosion_scores
    want = sorted(tuple(r) for r in corrosion_scores(raw).collect())
    assert got == want


def test_save_table_modes(spark):
    import pytest
    df = spark.createDataFrame([(1,), (2,)], "x int")
    name = "mf_test_save_modes"
    writers.save_table(df, name, "replace")
    writers.save_table(df, name, "append")
    assert spark.table(name).count() == 4
    writers.save_table(df, name, "replace")
    assert spark.table(name).count() == 2
    with pytest.raises(Exception):
        writers.save_table(df, name, "fail")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
