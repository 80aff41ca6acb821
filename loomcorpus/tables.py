"""The tables of a crawl, made from the test tables where no crawl has filled them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as crawled pages: one job for each source."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("crawl_job_id"),
        F.format_string("https://%s.example.com/%s/%d", "source", "lang", "doc_id").alias("url"),
        F.col("text").alias("text_content"),
        F.col("n_chars").alias("content_length"),
        F.lit(200).alias("status_code"),
        F.lit(False).alias("is_archived"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("crawled_at"),
    )


PAGES_SQL = """
pages_ AS (
  SELECT doc_id AS page_id, source AS crawl_job_id, 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
         text AS text_content, n_chars AS content_length, 200 AS status_code, FALSE AS is_archived,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS crawled_at
  FROM documents)"""


def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each source."""
    jobs = read(spark, sf_dir, "documents").select("source").distinct()
    return jobs.select(F.col("source").alias("id"), F.concat("source", F.lit(".example.com")).alias("domain"))


JOBS_SQL = "jobs_ AS (SELECT DISTINCT source AS id, source || '.example.com' AS domain FROM documents)"


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    """The same literal table as SQL."""

    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return repr(x)
        return "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"
