"""Sources and sinks: JSON entry files, insert-ignore, upsert, the vector store, settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of {"data": [...]} files."""
    rows = spark.read.option("multiLine", True).schema(f"data array<struct<{schema}>>").json(path)
    return rows.select(F.explode("data").alias("e")).select("e.*")


def append_entries(entries: DataFrame, path: str) -> None:
    """Adds entries as JSON lines; files appear whole, so writers need no lock."""
    entries.write.mode("append").json(path)


def insert_ignore(new: DataFrame, table: str, keys: list[str]) -> None:
    """Appends the rows of new whose keys neither the Parquet table nor an earlier row has."""
    spark = new.sparkSession
    fresh = new.dropDuplicates(keys)
    if _exists(spark, table):
        fresh = fresh.join(spark.read.parquet(table).select(*keys), keys, "left_anti").select(*new.columns)
    fresh.write.mode("append").parquet(table)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last written row of each key: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The vector store: one folder for each job, so a job's search reads only its own."""
    vectors.write.mode("overwrite").partitionBy("crawl_job_id").parquet(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings in ranges of the phrase, sorted: a prefix filter then skips files and row groups."""
    postings.repartitionByRange("phrase").sortWithinPartitions("phrase").write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Settings:
    """What a crawl's processing depends on; a job's own settings replace single fields."""

    max_depth: int = 5
    max_pages: int = 0
    max_retries: int = 3
    respect_robots: bool = True
    skip_content_duplicates: bool = True
    extract_words: bool = True
    semantic_search: bool = False
    save_text: bool = True
    stemming: bool = False
    language: str = "en"

    @staticmethod
    def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
        """Defaults, then "name: value" lines of a file, then LOOMCORPUS_<NAME> variables; without the file only the defaults hold."""
        out = Settings()
        if path is None or not Path(path).exists():
            return out
        pairs = dict(line.split(":", 1) for line in Path(path).read_text().splitlines() if ":" in line and not line.lstrip().startswith("#"))
        env = os.environ if environment is None else environment
        for f in fields(Settings):
            text = env.get(f"LOOMCORPUS_{f.name.upper()}", pairs.get(f.name))
            if text is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: text.strip().lower() in ("1", "true", "yes") if kind is bool else kind(text.strip())})
        return out

    def merged(self, own: dict[str, object]) -> Settings:
        """With a job's settings: nulls and empty lists don't replace."""
        return replace(self, **{k: v for k, v in own.items() if v is not None and v != []})
