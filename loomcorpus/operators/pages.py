"""The page store and the crawl frontier, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def content_dedup(pages: DataFrame) -> DataFrame:
    """One page for each content of a job, the first; shells of unrendered applications (is_shell) all stay."""
    shells = pages.filter("is_shell")
    return first_of(pages.filter("NOT is_shell"), ["crawl_job_id", "doc_hash"], ["page_id"]).unionByName(shells)


def merge_fetches(fetches: DataFrame) -> DataFrame:
    """Repeated fetches of one URL folded in order of seq: a later one replaces the record if it is larger, or mends an error.

    Title and text are replaced only by ones that are there. The first fetch's id stays.
    """
    row = F.struct("seq", "page_id", "status_code", "content_length", "error", "title", "text")
    lists = fetches.groupBy("crawl_job_id", "url_hash").agg(F.sort_array(F.collect_list(row)).alias("f"))

    def step(old: Column, new: Column) -> Column:
        better = (new["content_length"] > old["content_length"]) | ((new["error"] == "") & (old["error"] != ""))

        def pick(name: str, keep_if_missing: bool = False) -> Column:
            ok = better & (F.coalesce(new[name], F.lit("")) != "") if keep_if_missing else better
            return F.when(ok, new[name]).otherwise(old[name]).alias(name)

        return F.struct(old["seq"].alias("seq"), old["page_id"].alias("page_id"), pick("status_code"), pick("content_length"), pick("error"), pick("title", True), pick("text", True))

    folded = F.aggregate(F.slice("f", F.lit(2), F.size("f")), F.element_at("f", 1), step)
    return lists.select("crawl_job_id", "url_hash", folded.alias("p")).select("crawl_job_id", "url_hash", "p.page_id", "p.status_code", "p.content_length", "p.error", "p.title", "p.text")


def new_urls(found: DataFrame, pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """URLs to add to the frontier: each once, neither fetched nor waiting. All have crawl_job_id and url_hash."""
    keys = ["crawl_job_id", "url_hash"]
    return found.join(pages, keys, "left_anti").join(frontier, keys, "left_anti").dropDuplicates(keys)


def claim(frontier: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A batch of n pending rows of each job, those of the smallest seeded hashes, as processing."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    w = Window.partitionBy("crawl_job_id").orderBy(h, "id")
    return frontier.filter("status = 'pending'").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n").withColumn("status", F.lit("processing"))


def failed(frontier: DataFrame, most: int = 3) -> DataFrame:
    """Rows whose fetch failed: one more retry, waiting again below the limit."""
    retries = F.col("retries") + 1
    return frontier.select(*[c for c in frontier.columns if c not in ("retries", "status")], retries.alias("retries"), F.when(F.col("retries") < most, "pending").otherwise("failed").alias("status"))


def breadth_first(spark_links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int = 0) -> DataFrame:
    """(url, depth): each URL's least number of links (src, dst) from the seeds, up to max_depth.

    Each round's URLs are stored, so a round's plan doesn't hold the earlier ones. max_pages, if not 0, stops after the round in which
    so many are reached, and keeps that many, by depth and url.
    """
    seen = materialise(seeds.select("url", F.lit(0).alias("depth")).dropDuplicates(["url"]), "depth0")
    edge = seen
    for depth in range(1, max_depth + 1):
        if max_pages and seen.count() >= max_pages:
            break
        nxt = edge.join(spark_links, edge["url"] == spark_links["src"]).select(F.col("dst").alias("url")).distinct()
        edge = materialise(nxt.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), f"depth{depth}")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen.orderBy("depth", "url").limit(max_pages) if max_pages else seen
