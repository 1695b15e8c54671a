"""Model building blocks on Spark ML.

Fingerprints are text fingerprints: character n-grams (1-3) of the main
structure component hashed into 2048 binary features with ``HashingTF``.
They are not circular chemical fingerprints (no chemistry toolkit is used).
Every model is a ``Pipeline``; scoring is ``PipelineModel.transform`` on a
whole table; persistence is ``PipelineModel.save/load`` under the cluster's
shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matfold.functions._util import ColumnLike, col_of
from matfold.functions.chem import first_component, letter_frequencies, structure_problem
from matfold.session import ensure_checkpoint_dir

N_BITS = 2048
#: Rows of one task of a model's input, unless there are tasks enough.
TASK_ROWS = 20_000


def char_tokens(c: ColumnLike) -> Column:
    """Characters of the main structure component as an array (empty for blank)."""
    s = F.coalesce(first_component(col_of(c)), F.lit(""))
    return F.filter(F.split(s, ""), lambda x: x != "")


def fingerprint_stages(token_col: str, out_col: str = "fp", n_bits: int = N_BITS) -> list:
    """Stages turning a character array into a binary hashed n-gram vector."""
    stages, grams = [], []
    for n in (1, 2, 3):
        g = f"_g{n}"
        stages.append(NGram(n=n, inputCol=token_col, outputCol=g))
        grams.append(g)
    return stages, grams


def add_fingerprint(df: DataFrame, structure_col: str, out_col: str = "fp", n_bits: int = N_BITS) -> DataFrame:
    """``df`` with the hashed n-gram vector of its structure column."""
    toks = df.withColumn("_chars", char_tokens(structure_col))
    stages, grams = fingerprint_stages("_chars")
    for st in stages:
        toks = st.transform(toks)
    toks = toks.withColumn("_grams", F.concat(*[F.col(g) for g in grams]))
    tf = HashingTF(inputCol="_grams", outputCol=out_col, numFeatures=n_bits, binary=True)
    return tf.transform(toks).drop("_chars", "_grams", *grams)


def binding_features(df: DataFrame, sequence_col: str, structure_col: str, out_col: str = "features", n_bits: int = N_BITS) -> DataFrame:
    """Protein and ligand in one row: the ligand's fingerprint, then the shares of the twenty amino acids.

    A blank or malformed structure has no bits; a null sequence has no shares.
    """
    legal = df.withColumn("_ligand", F.when(structure_problem(structure_col).isNull(), F.col(structure_col)))
    shares = letter_frequencies(sequence_col)
    names = [f"_{sequence_col}_{i}" for i in range(len(shares))]
    wide = add_fingerprint(legal, "_ligand", "_bits", n_bits).select("*", *[s.alias(n) for s, n in zip(shares, names, strict=True)])
    return assembler(["_bits", *names], out_col).transform(wide).drop("_ligand", "_bits", *names)


def model_dir(spark, name: str) -> str:
    """A new model folder inside the shared checkpoint folder of the session."""
    return os.path.join(ensure_checkpoint_dir(spark), "models", f"{name}-{uuid.uuid4().hex}")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it back.

    Used for model inputs that several fits and scorings read: the parsing
    and fingerprinting run once, the lineage is cut, and a lost executor
    costs a re-read of the checkpoint files rather than a recomputation.
    Rows that came in fewer tasks than the cluster runs (few or small files)
    are dealt to more, ``TASK_ROWS`` to each at least.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)  # computed once, then written
    try:
        tasks = min(2 * df.sparkSession.sparkContext.defaultParallelism, cached.count() // TASK_ROWS)
        if cached.rdd.getNumPartitions() < tasks:
            return cached.repartition(tasks).checkpoint(eager=True)
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def fit_pipeline(df: DataFrame, stages: list, cache: bool = True) -> PipelineModel:
    """Fit a pipeline; the training input is persisted for the duration of
    the fit (iterative estimators pass over it many times) and released
    afterwards.  Persisted blocks are recomputed from lineage if an executor
    is lost."""
    from pyspark import StorageLevel
    if not cache:
        return Pipeline(stages=stages).fit(df)
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()
