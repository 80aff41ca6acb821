"""Continuous ingestion of fetched pages (an extension: crawls in batches need none of it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import html as H
from ..functions import urls as U

PAGES = "page_id long, url string, html string, fetched_at timestamp"


def new_pages(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """A stream of the pages that appear in a folder, each URL of a job once within the watermark."""
    pages = spark.readStream.schema(PAGES).parquet(folder).withWatermark("fetched_at", delay)
    keyed = pages.withColumns({"crawl_job_id": U.base_domain(U.host(F.col("url"))), "url_hash": F.sha2(U.normalise(F.col("url")), 256)})
    return keyed.filter("url_hash IS NOT NULL").dropDuplicatesWithinWatermark(["crawl_job_id", "url_hash"])


def indexed(pages: DataFrame) -> DataFrame:
    """Pages as the store keeps them: text, title and content hash."""
    text = pages.withColumn("text_content", H.text(F.col("html")))
    return text.select("page_id", "crawl_job_id", "url", "url_hash", H.title(F.col("html")).alias("title"), "text_content", F.sha2("text_content", 256).alias("doc_hash"), F.col("fetched_at").alias("crawled_at"))


def ingest(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs sink on every batch of new, indexed pages that is there, then stops."""
    return indexed(new_pages(spark, folder)).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
