"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): the pairwise part costs one pass
over a document's features. It is trained in numpy on a sample of labelled rows whose size is the parameter
`sample_rows`; scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, column, field, free, mix, numbered, per_text, raw, spans, tune

WORDS, META, FACTORS = 1 << 15, 256, 8
STATS = 14
SIZE = WORDS + META + STATS
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 6000

_LINE = np.ones(256, bool)
_LINE[10] = False
_CLASS = np.zeros((256, 6), np.uint64)
_CLASS[65:91, 0] = 1  # capitals
_CLASS[48:58, 1] = 1  # digits
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c, 2] = 1  # marks
for _c in b"#$%&*|<>{}[]\\^~=_@":
    _CLASS[_c, 3] = 1  # marks that prose seldom has
for _c in b"!?":
    _CLASS[_c, 4] = 1
for _c in b" \t\n\r":
    _CLASS[_c, 5] = 1
#: Two counters of 32 bits in each number.
_PAIRS = [_CLASS[:, k] + (_CLASS[:, k + 1] << np.uint64(32)) for k in (0, 2, 4)]


def features(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, feature numbers, values, words of each text); each feature of a text occurs once."""
    n = len(texts)
    w = Words(texts)
    key = (w.doc.astype(np.uint64) << np.uint64(15)) | (w.hash >> np.uint64(49))
    key, times = np.unique(key, return_counts=True)
    doc, bucket = (key >> np.uint64(15)).astype(np.int64), (key & np.uint64(WORDS - 1)).astype(np.int64)
    at = np.searchsorted(doc, np.arange(n + 1))
    most = np.zeros(n)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        most[some] = np.maximum.reduceat(times, at[some])
    count = np.maximum(w.count, 1)
    data, off = raw(texts)
    size = np.maximum(np.diff(off) - 1, 1)
    stats = np.zeros((n, STATS), np.float32)
    for k, pair in enumerate(_PAIRS):
        total = np.add.reduceat(pair[data], off[:-1]) if n else np.zeros(0, np.uint64)
        stats[:, 2 * k] = (total & np.uint64(2**32 - 1)) / size
        stats[:, 2 * k + 1] = (total >> np.uint64(32)) / size
    stats[:, 6] = per_text(w.length.astype(np.float64), w.at) / count / 10
    stats[:, 7] = np.diff(at) / count
    stats[:, 8] = most / count
    stats[:, 9] = np.log1p(w.count) / 10
    starts, _ = spans(data, _LINE)
    line_at = np.searchsorted(starts, off)
    stats[:, 10] = np.diff(line_at) / count
    stats[:, 11] = np.sqrt(stats[:, 3])
    stats[:, 12] = np.diff(at) / np.sqrt(count) / 20
    stats[:, 13] = stats[:, 4] ** 0.5
    meta = [(_text_hash(langs) % 64).astype(np.int64), (64 + _text_hash(sources) % 192).astype(np.int64)]
    idx = np.concatenate([bucket, *(WORDS + m for m in meta), np.tile(WORDS + META + np.arange(STATS), n)])
    val = np.concatenate([times / np.sqrt(count * most.clip(1))[doc], np.full(2 * n, 0.3), stats.ravel() * 2]).astype(np.float32)
    row = np.concatenate([doc, np.arange(n), np.arange(n), np.repeat(np.arange(n), STATS)])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(n + 1)), idx[order], val[order], w.count


def _text_hash(values: pa.Array) -> np.ndarray:
    """One number for each text, the same in all processes."""
    data, off = raw(values)
    out = np.zeros(len(values), np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
        out[some] = np.add.reduceat((data + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2654435761) + np.uint64(97)), off[:-1][some])
    return mix(out)


class Machine:
    """The parameters: bias, weights, factors."""

    def __init__(self, seed: int = 7) -> None:
        self.bias = 0.0
        self.w = np.zeros(SIZE, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)

    def raw_score(self, at: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[idx] * val[:, None]
        s = per_text(vx, at)
        return self.bias + per_text(self.w[idx] * val, at) + 0.5 * (s**2 - per_text(vx**2, at)).sum(1), s

    def fit(self, at: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.02, l2: float = 2e-5, batch: int = 200, seed: int = 7) -> Machine:
        """Adam on the logistic loss; classes count alike."""
        rng = np.random.default_rng(seed)
        share = np.array([max((y == k).mean(), 1e-3) for k in (0, 1)])
        weight = (0.5 / share)[y.astype(int)].clip(0.2, 5)
        state = [np.zeros((SIZE, FACTORS + 1), np.float32) for _ in range(2)]
        step = 0
        bias_m = bias_s = 0.0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                lens = at[rows + 1] - at[rows]
                cut = np.concatenate([[0], np.cumsum(lens)])
                pick = np.repeat(at[rows] - cut[:-1], lens) + np.arange(cut[-1])
                i, x = idx[pick], val[pick]
                score, s = self.raw_score(cut, i, x)
                g = ((1 / (1 + np.exp(-score.clip(-30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                ge = np.repeat(g, lens) * x
                grad = np.empty((SIZE, FACTORS + 1), np.float32)
                grad[:, 0] = np.bincount(i, ge, SIZE)
                se = np.repeat(s, lens, axis=0) - self.v[i] * x[:, None]
                for f in range(FACTORS):
                    grad[:, f + 1] = np.bincount(i, ge * se[:, f], SIZE)
                grad[:, 0] += l2 * self.w
                grad[:, 1:] += l2 * self.v
                step += 1
                state[0] = 0.9 * state[0] + 0.1 * grad
                state[1] = 0.999 * state[1] + 0.001 * grad**2
                move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
                self.w -= move[:, 0]
                self.v -= move[:, 1:]
                bias_m, bias_s = 0.9 * bias_m + 0.1 * g.sum(), 0.999 * bias_s + 0.001 * g.sum() ** 2
                self.bias -= float(rate * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_s / (1 - 0.999**step)) + 1e-8))
        return self

    def scores(self, texts: pa.Array, langs: pa.Array, sources: pa.Array) -> np.ndarray:
        """Probability of good quality; 0 for a text without words."""
        at, idx, val, words = features(texts, langs, sources)
        p = 1 / (1 + np.exp(-self.raw_score(at, idx, val)[0].clip(-30, 30)))
        return np.where(words > 0, p, 0.0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Machine:
    """Fits the machine on at most sample_rows labelled rows, those with the smallest hashes of their ids.

    Rows of labels with a null id or quality are left out, as are labelled documents without text; with none left, or of one class
    only, the machine is neutral (every score about 0.5). Of rows that repeat an id one counts for each label it has, the one whose text has
    the smallest hash, so however often an id occurs no more than sample_rows rows reach the driver.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows)
    # the sample is bounded by sample_rows, so it may be broadcast whatever the size of the tables
    rows = docs.select(F.col("doc_id").alias("_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang"), column(docs, "source", "string").alias("source")).join(F.broadcast(chosen), "_id").filter("text IS NOT NULL").withColumn("_h", F.xxhash64("text", "lang", "source"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, idx, val, _ = features(b["text"], b["lang"], b["source"])
            yield pa.record_batch({"id": b["_id"], "y": b["_y"], "h": b["_h"], "idx": pa.ListArray.from_arrays(at.astype(np.int32), idx.astype(np.int32)), "val": pa.ListArray.from_arrays(at.astype(np.int32), val)})

    each = rows.mapInArrow(extract, "id long, y int, h long, idx array<int>, val array<float>")
    table = each.groupBy("id", "y").agg(F.min_by(F.struct("idx", "val"), "h").alias("x")).select("id", "y", "x.idx", "x.val").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    model = Machine(seed)
    if not table.num_rows or len(set(table["y"].to_pylist())) < 2:
        return model
    idx, val = (table[c].combine_chunks() for c in ("idx", "val"))
    return model.fit(idx.offsets.to_numpy().astype(np.int64) - idx.offsets[0].as_py(), idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy(), table["y"].to_numpy().clip(0, 1).astype(np.float32), seed=seed)


def _scored(docs: DataFrame, model: Machine, threshold: float, only_kept: bool) -> DataFrame:
    plain = numbered(docs)
    names = plain.columns
    full = plain.withColumns({"_text": field(docs, "text", "string"), "_lang": field(docs, "lang", "string"), "_source": field(docs, "source", "string")})
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))  # 1.2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.__new__(Machine)
        m.bias, m.w, m.v = sent.value
        for b in batches:
            p = m.scores(b["_text"], b["_lang"], b["_source"])
            own = b.select(names)
            if only_kept:
                yield own.filter(pa.array(p >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p, pa.float64()), pa.array(p >= threshold)], names=[*names, "_score", "_keep"])

    schema = plain.schema
    return full.mapInArrow(run, schema if only_kept else T.StructType([*schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_keep", T.BooleanType())]))


def score(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """docs with `quality_score` (double) and `keep` (score >= threshold); where docs has columns of these names, which stay, an underscore is put behind.

    Null, empty and wordless texts score 0 and aren't kept. Repeated rows each get the same score. A null or missing lang or source
    counts as a value of its own. A text of any length is scored whole. An empty table gives an empty result.
    """
    return _scored(docs, model, threshold, False).toDF(*docs.columns, free(docs, "quality_score"), free(docs, "keep"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """Trains on the labelled documents and scores all of them; see train and score."""
    tune(docs.sparkSession)
    return score(docs, train(docs, labels, sample_rows), threshold)


def drop_rejected(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score under the threshold; see train and score. Columns are those of docs, and none is changed."""
    tune(docs.sparkSession)
    return _scored(docs, train(docs, labels, sample_rows), threshold, True).toDF(*docs.columns)
