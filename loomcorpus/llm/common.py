"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, materialise, numbered, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Words", "column", "discard", "field", "free", "materialise", "mix", "numbered", "per_text", "place", "raw", "shared_dir", "spans", "tune", "word_hashes"]

#: Rows and bytes of an Arrow batch, at most: Python workers hold one batch at a time, whatever the input and however long its texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that the vectorised tokeniser handles at once.
SLICE = 1 << 18


def tune(spark: SparkSession) -> None:
    """Small Arrow batches. All operators set the same values, so no plan is run with those of another."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(df: DataFrame, name: str, kind: str) -> Column:
    """df's column, or a null of that type where it is missing."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def place(df: DataFrame, name: str) -> str | None:
    """What numbered(df) calls df's column of that name; None where there is none."""
    return f"c{df.columns.index(name)}" if name in df.columns else None


def field(df: DataFrame, name: str, kind: str) -> Column:
    """A column of numbered(df) by its name in df, or a null of that type where it is missing."""
    at = place(df, name)
    return F.lit(None).cast(kind) if at is None else F.col(at).cast(kind)


def free(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other salts give independent hashes."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, each followed by a newline, and the offsets of each; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in the set, which is without the newline that ends a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, computed over slices of bytes so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        a, b = starts[i], ends[j - 1]
        length = (ends[i:j] - starts[i:j]).astype(np.int32)
        first = np.cumsum(length, dtype=np.int32) - length
        number = np.arange(first[-1] + length[-1], dtype=np.int32)
        part = _BYTE[data[a:b][number + np.repeat((starts[i:j] - a).astype(np.int32) - first, length)]]
        part *= _PLACE[(number - np.repeat(first, length)) & 1023]
        out[i:j] = np.add.reduceat(part, first)
        i = j
    return mix(out)


class Words:
    """Lower-cased words (runs of letters, digits and non-ASCII bytes) of a batch of texts: hash, length in bytes, text number; `at` has where each text's words begin."""

    def __init__(self, texts: pa.Array, places: bool = False) -> None:
        data, off = raw(texts, lower=True)
        starts, ends = spans(data, _WORD)
        self.hash = word_hashes(data, starts, ends)
        self.length = ends - starts
        self.at = np.searchsorted(starts, off)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        if places:
            self.data, self.start, self.off = data, starts, off


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum for each text of values given for its words; rows without words give 0."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[some], axis=0)
    return out
