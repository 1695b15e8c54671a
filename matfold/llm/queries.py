"""The thin queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matfold.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from matfold.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.mixing import mix
    plan = mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.decontam import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.substring_dedup import substring_dedup
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.setsketch import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.line_dedup import dedup_lines
    found = dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.topk import exact_top_k
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLE["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 5
"""


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.license_scan import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.quality import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.conversation_repair import repair_damaged
    return repair_damaged(table(spark, sf_dir, "conversations"))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matfold.llm.suffix_dedup import suffix_dedup
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE |= {"op11_conversation_repair": oracles.OP11, "op12_spelling_variants": oracles.OP12, "op13_suffix_dedup": oracles.OP13}
