"""Tables in the shared folder: where a plan's lineage is cut, or a result is used more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="loomcorpus-"))


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names with dots, names that differ in case only and names an operator uses itself do no harm."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


#: Rows of a table that may be broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for a broadcast join if it is counted to have at most so many rows; otherwise as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomcorpus/{what}-{uuid.uuid4().hex}"
    plain = numbered(df)
    plain.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._loomcorpus_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise made and nothing needs any more."""
    for df in tables:
        path = df._loomcorpus_path
        _written.remove((df.sparkSession, path))
        _delete(path, df.sparkSession)


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clean() -> None:
    """Removes this session's tables from the shared folder."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            _delete(path, spark)
