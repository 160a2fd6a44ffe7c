"""Queries of the learned operators: op2, op3, op6. None has SQL; they are tested on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality, toxicity
from .shared import doc_key


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = toxicity.in_fold(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD)
    out = toxicity.scored(docs, model)
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fitted(docs.select("doc_id", "text", "lang"))
    held = toxicity.in_fold(F.col("doc_id"), langid.FOLDS, langid.HELD)
    return langid.labelled(doc_key(docs), model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_key(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = quality.scored(docs, quality.fitted(docs))
    return out.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity, "op3_language": op3_language, "op6_quality": op6_quality}
SQL: dict[str, str] = {}
