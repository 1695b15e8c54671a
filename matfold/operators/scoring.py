"""Scoring contract and model registry.

A model's input is a contract: which features, in which order, what stands for a
missing one, and how each is scaled.  ``FeatureContract`` carries all of it as the
first stage of a ``PipelineModel``, so that scoring takes any table that has the
columns in any order, as numbers or as dirty text, and ``LabelDecoder`` turns
codes back into labels at the end.  Both are saved with the pipeline.

``ModelRegistry`` keeps versions of models and a table of their features, labels
and metrics under a folder of its own (the warehouse unless told otherwise), never
in the checkpoint folder, whose files a cluster may drop.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matfold.functions.parse import to_number


def _number(df: DataFrame, name: str) -> Column:
    """Column ``name`` (names compared stripped) as a number; null where it is missing, not a number or NaN."""
    found = next((f for f in df.schema.fields if f.name.strip() == name.strip()), None)
    if found is None:
        return F.lit(None).cast("double")
    c = F.col(f"`{found.name}`")
    x = to_number(c) if isinstance(found.dataType, T.StringType) else c.cast("double")
    return F.when(~F.isnan(x), x)


class FeatureContract(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Orders, coerces, fills and scales the features of a model and assembles them into ``outputCol``."""

    features = Param(Params._dummy(), "features", "names of the features in the model's order", TypeConverters.toListString)
    fill = Param(Params._dummy(), "fill", "value of a missing feature", TypeConverters.toListFloat)
    center = Param(Params._dummy(), "center", "subtracted from each feature", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "each feature is divided by it", TypeConverters.toListFloat)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def __init__(self, features: Sequence[str] = (), fill: Sequence[float] = (), center: Sequence[float] = (),
                 scale: Sequence[float] = (), outputCol: str = "features") -> None:
        super().__init__()
        self._set(features=list(features), fill=list(fill), center=list(center), scale=list(scale), outputCol=outputCol)

    def columns(self, df: DataFrame) -> list[Column]:
        names, fill, center, scale = (self.getOrDefault(p) for p in (self.features, self.fill, self.center, self.scale))
        return [(F.coalesce(_number(df, n), F.lit(f)) - c) / s for n, f, c, s in zip(names, fill, center, scale, strict=True)]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOrDefault(self.outputCol)
        held = [f"_{out}_{i}" for i in range(len(self.getOrDefault(self.features)))]
        wide = df.select("*", *[c.alias(h) for c, h in zip(self.columns(df), held, strict=True)])
        return VectorAssembler(inputCols=held, outputCol=out, handleInvalid="keep").transform(wide).drop(*held)


def fit_contract(train: DataFrame, features: Sequence[str], scaled: bool = True, out: str = "features") -> FeatureContract:
    """The contract of a training table: missing values get the feature's mean,
    scaling is by mean and population deviation of the filled column (a constant
    one is divided by 1).  One aggregate."""
    x = [_number(train, f) for f in features]
    row = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                    *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)], *[F.count(c).alias(f"c{i}") for i, c in enumerate(x)]).first()
    mean = [row[f"m{i}"] or 0.0 for i in range(len(x))]
    # filled rows add nothing to the squares around the mean
    var = [(row[f"v{i}"] or 0.0) * row[f"c{i}"] / row["n"] if row["n"] else 0.0 for i in range(len(x))]
    if not scaled:
        return FeatureContract(features, mean, [0.0] * len(x), [1.0] * len(x), out)
    return FeatureContract(features, mean, mean, [v ** 0.5 or 1.0 for v in var], out)


class LabelDecoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``outputCol`` = the label of the code in ``predictionCol``; null for a code without one."""

    labels = Param(Params._dummy(), "labels", "label of each code", TypeConverters.toListString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of codes", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of labels", TypeConverters.toString)

    def __init__(self, labels: Sequence[str] = (), predictionCol: str = "prediction", outputCol: str = "label") -> None:
        super().__init__()
        self._set(labels=list(labels), predictionCol=predictionCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.getOrDefault(self.labels)]) if self.getOrDefault(self.labels) else F.array().cast("array<string>")
        return df.withColumn(self.getOrDefault(self.outputCol), F.get(names, F.col(self.getOrDefault(self.predictionCol)).cast("int")))


class ModelRegistry:
    """Saved models by name and version, and a table of what each expects and gives."""

    SCHEMA = ("name string, version int, path string, features array<string>, target string, labels array<string>, "
              "metrics map<string,double>")

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/matfold_models").rstrip("/")

    def table(self) -> DataFrame:
        """One row per registered version."""
        from matfold.sources.readers import path_exists
        if not path_exists(self.spark, f"{self.root}/registry"):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/registry")

    def register(self, name: str, model: PipelineModel, target: str, metrics: dict[str, float] | None = None) -> int:
        """Save ``model`` as the next version of ``name``; features and labels come from its own stages."""
        version = (self.table().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
        path = f"{self.root}/{name}/{version}-{uuid.uuid4().hex}"
        model.write().save(path)
        contract = next((s for s in model.stages if isinstance(s, FeatureContract)), None)
        decoder = next((s for s in model.stages if isinstance(s, LabelDecoder)), None)
        row = (name, version, path, contract.getOrDefault(contract.features) if contract else [], target,
               decoder.getOrDefault(decoder.labels) if decoder else [], dict(metrics or {}))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/registry")
        return version

    def load(self, name: str, version: int | None = None) -> PipelineModel:
        """The newest (or the given) version of ``name``; KeyError when there is none."""
        rows = self.table().where(F.col("name") == name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        best = rows.orderBy(F.desc("version"), "path").first()
        if best is None:
            raise KeyError(f"{name} {version or ''}".strip())
        return PipelineModel.load(best["path"])
