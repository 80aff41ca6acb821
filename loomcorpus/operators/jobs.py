"""Crawl jobs: states, copies, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Settings of a job by type; lists that are empty count as not given.
SETTINGS = {
    "max_concurrent_requests": "int",
    "request_timeout_sec": "int",
    "max_depth": "int",
    "max_pages": "int",
    "max_retries": "int",
    "user_agent": "string",
    "respect_robots_txt": "boolean",
    "skip_content_duplicates": "boolean",
    "enable_word_extraction": "boolean",
    "enable_stemming": "boolean",
    "default_language": "string",
    "skip_extensions": "array<string>",
    "url_include_patterns": "array<string>",
    "url_exclude_patterns": "array<string>",
}
SETTINGS_TYPE = "struct<reset:boolean," + ",".join(f"{k}:{t}" for k, t in SETTINGS.items()) + ">"


def transition(status: Column, action: Column, other_runs: Column) -> Column:
    """A job's status after an action, or null where the action isn't allowed. Only one job runs at a time."""
    live = status.isin("running", "paused")
    return (
        F.when((action == "start") & ~other_runs & (status != "running"), "running")
        .when((action == "stop") & live, "cancelled")
        .when((action == "pause") & (status == "running"), "paused")
        .when((action == "resume") & (status == "paused") & ~other_runs, "running")
        .when((action == "complete") & (status == "running"), "completed")
    )


def duplicate(jobs: DataFrame, new_id: Column) -> DataFrame:
    """Pending copies of jobs: target, domain, depth and settings are copied, seed URLs and figures aren't."""
    return jobs.select(new_id.alias("id"), "target_url", "domain", "max_depth", "settings", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("seed_urls"), F.lit(0).alias("crawled_urls"))


def settings_of(body: Column) -> Column:
    """The settings that a JSON body asks for; null, which resets them, if it says so or gives none. A body that isn't a JSON object gives null."""
    s = F.from_json(body, SETTINGS_TYPE)
    given = F.lit(False)
    for name, kind in SETTINGS.items():
        given = given | (F.size(s[name]) > 0 if kind.startswith("array") else s[name].isNotNull())
    own = F.struct(*(s[name].alias(name) for name in SETTINGS))
    return F.when(F.coalesce(~F.coalesce(s["reset"], F.lit(False)) & given, F.lit(False)), own)


def update_settings(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """jobs (id, status, settings) after updates (id, settings): only pending jobs change; `updated` says which did."""
    asked = updates.select("id", F.col("settings").alias("_new"), F.lit(True).alias("_asked"))
    out = jobs.join(asked, "id", "left").withColumn("updated", F.coalesce(F.col("_asked") & (F.col("status") == "pending"), F.lit(False)))
    return out.select("id", "status", F.when(F.col("updated"), F.col("_new")).otherwise(F.col("settings")).alias("settings"), "updated")


def subdomains_of(jobs: DataFrame, subdomains: DataFrame) -> DataFrame:
    """(job_id, subdomain) of jobs (id, discovery_job_id): what a job discovered itself, or, if nothing, what its linked discovery did."""
    own = jobs.select(F.col("id").alias("job_id")).join(subdomains.withColumnRenamed("discovery_job_id", "job_id"), "job_id")
    rest = jobs.join(own.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti").filter("coalesce(discovery_job_id, '') <> ''")
    linked = rest.join(subdomains, "discovery_job_id").select(F.col("id").alias("job_id"), "subdomain")
    return own.select("job_id", "subdomain").unionByName(linked)


def surf(links: DataFrame, teleport: float, seed: int = 0) -> DataFrame:
    """(page, next, teleports) of links (page, link): a random surfer's next link from each page, uniformly chosen by a seeded hash; none, and a teleport, with chance `teleport`.

    A page's links needn't be brought together: the choice is a minimum.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), "page", "link"), 256)
    best = links.groupBy("page").agg(F.min_by("link", h).alias("link"))
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}t"), F.col("page").cast("string")), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    return best.withColumn("teleports", draw < teleport).select("page", F.when(~F.col("teleports"), F.col("link")).alias("next"), "teleports")


def unseen(urls: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """urls (url, ...) that aren't in seen, the first of each by `order`: checks and marks in one step."""
    first = F.row_number().over(Window.partitionBy("url").orderBy(order))
    return urls.join(seen, "url", "left_anti").withColumn("_n", first).filter("_n = 1").drop("_n")
