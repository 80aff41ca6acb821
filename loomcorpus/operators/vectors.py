"""Embeddings: exact inner-product search, codecs, and what is embedded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, in order of dimensions."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(page_id, score): the k vectors of greatest inner product with the one row `query` (q); ties by id. Each task keeps k rows."""
    rows = vectors.crossJoin(F.broadcast(query))  # one row
    return rows.select("page_id", "crawl_job_id", inner_product(F.col("embedding"), F.col("q")).alias("score")).orderBy(F.desc("score"), "page_id").limit(k)


def modal_dimension(vectors: DataFrame) -> DataFrame:
    """The vectors of the most frequent length; of equally frequent lengths the larger. Empty vectors don't count."""
    full = vectors.filter(F.size("embedding") > 0).withColumn("dim", F.size("embedding"))
    mode = full.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).select("dim")
    return full.join(F.broadcast(mode), "dim", "left_semi")


def encode(vectors: DataFrame, column: str, to: str) -> DataFrame:
    """vectors with a column `to`: float32, little endian; a null stays null, and nulls in a vector become NaN."""
    schema = StructType([*vectors.schema.fields]).add(to, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b[column].cast(pa.list_(pa.float32()))
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), "<f4")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
            off = np.concatenate([[0], 4 * np.cumsum(size, dtype=np.int64)]).astype(np.int32)
            valid = pc.is_valid(v)
            blob = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(off), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(valid, blob, None)], names=[*b.schema.names, to])

    return vectors.mapInArrow(run, schema)


def decode(blobs: DataFrame, column: str, to: str) -> DataFrame:
    """The reverse of encode; null where the length isn't a multiple of four."""
    schema = StructType([*blobs.schema.fields]).add(to, T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.binary_length(b[column])
            good = pc.fill_null(pc.equal(pc.bit_wise_and(size, 3), 0), False)
            whole = pc.if_else(good, b[column], b"").cast(pa.binary())
            off = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
            data = whole.buffers()[2]
            flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<f4") if data is not None else np.zeros(0, "<f4")
            lists = pa.ListArray.from_arrays(pa.array((off - off[0]) // 4, pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(good, lists, None)], names=[*b.schema.names, to])

    return blobs.mapInArrow(run, schema)


def embed_input(title: Column, text: Column, model: str, query: bool = False, most: int = 1000) -> Column:
    """What an embedding model is given for a page: title and the first words of the text, with the prefix that E5 models expect."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    body = F.concat_ws(" ", F.slice(words, F.lit(1), F.lit(most)))
    full = F.when(title != "", F.concat(title, F.lit(". "), body)).otherwise(body)
    prefix = ("query: " if query else "passage: ") if "/e5-" in model.lower() or "-e5-" in model.lower() else ""
    return F.concat(F.lit(prefix), full)
