"""Sharding by sampled splitters.

Records are ordered by (key, doc_id). A sample drawn with chances in proportion to size is sorted by ranges, and its quantiles are the
boundaries of ranges of about TARGET bytes; the ranges' true sizes are then summed, and each that holds more than OVERFULL times
the target is sampled again, more finely, and subdivided, until none is overfull that holds two different (key, doc_id). Records
then move once, straight to the partition of their range.

Samples stay distributed; the driver holds the boundaries alone, a key and a number for each shard. There are at most MAX_SHARDS
(beyond, shards get larger), so boundaries are a few megabytes whatever the input.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, field, free, materialise, numbered, tune

TARGET, OVERFULL, OVERSAMPLE = 64 << 20, 1.5, 32
#: Shards at most, and so boundaries that are broadcast: 100 TB give shards of 1 GB.
MAX_SHARDS = 100_000

Key = tuple[str, int]
_LEAST = -(2**63)


def _key(key: str | None, doc_id: float | None) -> Key:
    """Nulls come first."""
    return ("" if key is None else "\x01" + key, _LEAST if doc_id is None or doc_id != doc_id else int(doc_id))


class Bounds:
    """Sorted boundaries: range k holds what lies from boundary k - 1, included, to boundary k."""

    def __init__(self, bounds: list[Key]) -> None:
        self.keys = [k for k, _ in bounds]
        self.ids = np.array([i for _, i in bounds], np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, keys: pd.Series, ids: pd.Series) -> np.ndarray:
        """The range of each (key, id): keys are looked up once each, ids by binary search all at once."""
        codes, distinct = pd.factorize(keys, use_na_sentinel=False)
        own = ids.fillna(_LEAST).astype("int64").to_numpy()
        out = np.empty(len(own), np.int32)
        order = np.argsort(codes, kind="stable")
        cut = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
        for c, key in enumerate(distinct):
            rows = order[cut[c] : cut[c + 1]]
            name = "" if pd.isna(key) else "\x01" + key
            lo, hi = bisect_left(self.keys, name), bisect_right(self.keys, name)
            out[rows] = lo + np.searchsorted(self.ids[lo:hi], own[rows], "right")
        return out


def _ranges(df: DataFrame, bounds: Bounds, name: str) -> DataFrame:
    """df with the number of each row's range, by its columns _key and _id."""
    sent = df.sparkSession.sparkContext.broadcast(bounds)  # at most MAX_SHARDS boundaries, and some more for overfull ranges

    @F.pandas_udf(T.IntegerType())
    def number(key: pd.Series, doc_id: pd.Series) -> pd.Series:
        return pd.Series(sent.value.number(key, doc_id.astype("Int64")))

    return df.withColumn(name, number(F.col("_key"), F.col("_id")))


def _sample(sizes: DataFrame, step: float, salt: int, *by: str) -> DataFrame:
    """(by, _key, _id, _n): each record counts size / step times, the fraction by chance of a hash; records of one key and id together."""
    chance = F.pmod(F.xxhash64("_key", "_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return sizes.withColumn("_n", F.floor(F.col("_size") / step + chance)).filter("_n > 0").groupBy(*by, "_key", "_id").agg(F.sum("_n").alias("_n"))


def _quantiles(n: np.ndarray, before: int, total: int, parts: int, wide: bool = False) -> tuple[np.ndarray, bool]:
    """(rows that begin a part, whether the last row ended one): `before` of `total` sample points come before these rows.

    A row begins a part if a quantile falls into it, and if two fell into the row before, which is so large that it ends its part.
    """
    cum = before + np.cumsum(n)
    number = np.ceil(cum * parts / total).astype(np.int64)  # quantiles 0 .. parts - 1 below cum
    first = int(np.ceil(before * parts / total))
    held = np.diff(np.concatenate([[first], number]))
    return (held > 0) | np.concatenate([[wide], held[:-1] > 1]), bool(len(held)) and held[-1] > 1


def _first_bounds(sizes: DataFrame, step: float, parts: int) -> list[Key]:
    """About `parts` quantiles of a sample that is sorted by ranges; only they come to the driver."""
    key = [F.col("_key").asc_nulls_first(), F.col("_id").asc_nulls_first()]
    ordered = _sample(sizes, step, 0).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id())
    ordered = materialise(ordered, "sample")
    held = {r["_part"]: r.n for r in ordered.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}  # a number for each range of the sort
    before = dict(zip(sorted(held), np.cumsum([0, *(held[k] for k in sorted(held))]).tolist()))
    total = sum(held.values())

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_key(k, i) for k, i in zip(pdf["_key"], pdf["_id"])]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        pdf = pdf.iloc[order]
        chosen, _ = _quantiles(pdf["_n"].to_numpy(), before[int(pdf["_part"].iloc[0])], total, parts)
        return pdf.loc[chosen, ["_key", "_id"]].astype({"_id": "Int64"})

    rows = ordered.groupBy("_part").applyInPandas(pick, "_key string, _id long").toArrow() if total else None
    discard(ordered)
    # the first quantile is the least record, which begins the first range
    return sorted({_key(k, i) for k, i in zip(rows["_key"].to_pylist(), rows["_id"].to_pylist())})[1:] if rows else []


def _divide(parts: dict[int, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of a range's sample: the records that begin its parts, but for the first."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_key(k, i) for k, i in zip(pdf["_key"], pdf["_id"])]
        pdf = pdf.iloc[sorted(range(len(keys)), key=keys.__getitem__)]
        n = pdf["_n"].to_numpy()
        chosen, _ = _quantiles(n, 0, int(n.sum()), max(2, parts[int(pdf["_range"].iloc[0])]))
        chosen[0] = False
        return pdf.loc[chosen, ["_key", "_id"]].astype({"_id": "Int64"})

    return pick


def boundaries(sizes: DataFrame, target: int = TARGET, overfull: float = OVERFULL, max_shards: int = MAX_SHARDS) -> list[Key]:
    """The bounds of the ranges of sizes (_key, _id, _size)."""
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    target = max(target, -(-total // max_shards))
    bounds = _first_bounds(sizes, target / OVERSAMPLE, max(1, -(-total // target)))
    salt, step = 0, target / OVERSAMPLE
    h = F.xxhash64("_key", "_id")  # numbers, so that the sums below need no sort
    while True:
        # a range can be divided if its records differ, that is if not all their hashes are one
        measured = _ranges(sizes, Bounds(bounds), "_range").groupBy("_range").agg(F.sum("_size").alias("s"), (F.min(h) < F.max(h)).alias("mixed"))
        big = {r["_range"]: r.s for r in measured.filter(F.col("mixed") & (F.col("s") > overfull * target)).collect()}
        if not big:
            return bounds
        # the step falls below the smallest record in the end: then every record is in the sample, and every such range is divided
        salt, step = salt + 1, step / 4
        parts = {k: -(-s // target) for k, s in big.items()}

        inside = _ranges(sizes, Bounds(bounds), "_range").filter(F.col("_range").isin(list(big)))
        rows = _sample(inside, step, salt, "_range").groupBy("_range").applyInPandas(_divide(parts), "_key string, _id long").toArrow()
        bounds = sorted({*bounds, *(_key(k, i) for k, i in zip(rows["_key"].to_pylist(), rows["_id"].to_pylist()))})


def sharded(docs: DataFrame, key: str = "source", target: int = TARGET, overfull: float = OVERFULL) -> DataFrame:
    """docs with `shard` (int), each shard in a partition of its own, in order of (key, doc_id).

    A null key or doc_id sorts first, a null text has size 0 (every record counts one byte besides). Records of one key and
    doc_id share a shard, however large they are together, as does one very long text. Where docs has a column of that name, which stays,
    the new one is called shard_. A missing key or doc_id column counts as null. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    name = free(docs, "shard")
    plain = numbered(docs)
    keyed = plain.withColumns({"_key": field(docs, key, "string"), "_id": field(docs, "doc_id", "long")})
    sizes = materialise(keyed.select("_key", "_id", (F.coalesce(F.octet_length(field(docs, "text", "string")), F.lit(0)) + 1).cast("long").alias("_size")), "sizes")
    bounds = Bounds(boundaries(sizes, target, overfull))
    discard(sizes)
    out = _ranges(keyed, bounds, "_shard").select(*plain.columns, "_shard")
    return out.repartitionById(len(bounds) + 1, F.col("_shard")).toDF(*docs.columns, name)
