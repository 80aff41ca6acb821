"""The corpus pipeline: five stages over documents, each one of the operators of loomcorpus.llm.

Every stage but the last returns the columns of its documents, unchanged, whatever their names are, dots and clashes included (secret scans
change `text`, and `n_chars` with it). Every stage takes an empty table, and gives an empty one for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcorpus.llm import common, decontam, packing, quality, secrets, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents among docs and drops those that the classifier rejects.

    Rows with a null, empty or wordless text are rejected; a null doc_id, lang or source doesn't matter. Long texts are read whole.
    Repeated rows go or stay together. Without labels of both classes all rows with words stay or go alike.
    """
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Rows with a null doc_id and rows with a null, empty or wordless text are no one's duplicates and stay. Of rows that repeat a kept
    id the one with the least text stays. Long texts are read whole.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Rows with a null, empty or wordless text stay; rows with a null doc_id are treated like others. Repeated rows go or stay
    together. Long texts are searched whole. Without benchmark items all rows stay.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays.

    Null and empty texts stay as they are; rows with a null doc_id are treated like others, repeated rows alike. Long texts are scanned whole.
    """
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows over all that is left.

    Null, empty and blank texts fill nothing; rows with a null doc_id come first. Repeated rows are packed each. Long texts are cut.
    """
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: A trained model's decisions and a dynamic program can't be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
