"""Forests: inputs dealt to enough tasks, rows that keep their nodes, the same trees."""

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from matfold.operators import models
from matfold.plans import models as plans


def test_materialize_deals_few_large_tasks_to_more(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100, raising=False)
    df = spark.range(1000).coalesce(1)
    out = models.materialize(df)
    assert out.rdd.getNumPartitions() == min(10, 2 * spark.sparkContext.defaultParallelism)
    assert sorted(r[0] for r in out.collect()) == list(range(1000))
    assert models.materialize(spark.range(50).coalesce(1)).rdd.getNumPartitions() == 1


def test_forests_of_the_queries_keep_node_ids(spark, tmp_path, monkeypatch):
    parts = [(i, f"hot bolt {i}", "Brand#7", "LARGE", 1 + i % 50, 900.0 + i * 1.7) for i in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
         .write.parquet(str(tmp_path / "part.parquet"))
    fitted = []
    fit = plans.fit_pipeline
    monkeypatch.setattr(plans, "fit_pipeline", lambda df, stages: (fitted.append((df, stages)), fit(df, stages))[1])
    rows = plans.q_select_model(spark, str(tmp_path), trees=5, depth=6).collect()
    assert sorted(r["model"] for r in rows) == ["forest", "knn7"] and sum(r["chosen"] for r in rows) == 1
    (df, (features, forest)), = fitted
    assert isinstance(forest, RandomForestRegressor) and forest.getCacheNodeIds()
    # the option does not change the trees
    trees = [[t.toDebugString.split("\n", 1)[1] for t in forest.copy({forest.cacheNodeIds: keep}).fit(features.transform(df.sort("ord").coalesce(1).withColumn("x", F.lit(0)))).trees]
             for keep in (True, False)]
    assert trees[0] == trees[1]
