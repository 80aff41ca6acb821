"""Queries of this subpackage for the registry: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, lm, packing, quality, secrets, sharding, simhash, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "quality_score", "keep")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings")).withColumn("distance", F.round("distance", 5))


OP10_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, min(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS n FROM p)
SELECT vec_id, n::INTEGER AS rank, neighbour_id, round(d, 5) AS distance FROM r WHERE n <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_quality, op2_sharding, op3_lm, op4_decontamination, op5_licenses, op6_secrets, op7_packing, op8_toxicity, op9_simhash, op10_topk)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": OP10_SQL}
