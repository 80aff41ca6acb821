"""Benchmark decontamination: a prefix-filtered set join with exact verification over item-sized windows.

An item is the set of its word shingles (SHINGLE words). A document is contaminated by an item if some window of as many
words as the item holds at least ceil(CONTAINMENT * |set|) of its shingles. Steps:

1. one pass over the corpus counts in how many documents each benchmark shingle occurs;
2. each item's shingles are ordered by that count, rarest first. A window may miss |set| - needed shingles, so it must
   hold one of the first |set| - needed + 1: the item's prefix;
3. a second pass looks document shingles up among the prefix shingles. Bounds: a text with fewer shingles than needed is
   skipped (length); a hit at place p is in no other windows than those that start within an item's length before it, whatever
   the order of its shingles there, and the hits of one item together with the places around them have to hold as many
   of its distinct shingles as are needed (position);
4. every window left is checked by counting the item's distinct shingles in it.

Only the benchmark travels to the executors, in slices of at most SLICE_WORDS words, each built, used and dropped before the next;
a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, discard, field, materialise, mix, numbered, tune

SHINGLE, CONTAINMENT = 3, 0.7
#: Words of the benchmark that are broadcast at once, about 40 bytes each.
SLICE_WORDS = 500_000
_BITS = 22


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each shingle of a batch; a place is the number of its first word in the batch."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = (h + w.hash[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))
    place = np.flatnonzero(w.doc[: n - size + 1] == w.doc[size - 1 :])
    return mix(h[place]), place


class Lookup:
    """Sorted hashes behind a bit table: most hashes that aren't in it cost one read."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.sorted >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, numbers in self.sorted) of the hashes that are in it."""
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(self.sorted):
            return maybe[:0], maybe[:0]
        at = np.searchsorted(self.sorted, h[maybe]).clip(max=len(self.sorted) - 1)
        ok = self.sorted[at] == h[maybe]
        return maybe[ok], at[ok]


@dataclass
class Item:
    """One benchmark item: words, its distinct shingle hashes in order, how many of them are needed."""

    item_id: int
    words: int
    distinct: np.ndarray
    needed: int


def read_items(benchmark: DataFrame, size: int, containment: float) -> list[Item]:
    """The items of a slice; those with a null id or text, or fewer than `size` words, have no shingles and can't match."""
    rows = benchmark.select(column(benchmark, "item_id", "long").alias("i"), column(benchmark, "text", "string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t").collect()
    w = Words(pa.array([r.t for r in rows], pa.string()))
    h, place = shingles(w, size)
    at = np.searchsorted(place, w.at)
    sets = [np.unique(h[at[k] : at[k + 1]]) for k in range(len(rows))]
    return [Item(r.i, int(w.count[k]), sets[k], max(1, int(np.ceil(containment * len(sets[k]) - 1e-9)))) for k, r in enumerate(rows) if len(sets[k])]


def shingle_counts(docs: DataFrame, items: list[Item], size: int) -> dict[int, int]:
    """In how many documents each shingle of the items occurs; at most one row for each benchmark shingle comes back."""
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([i.distinct for i in items])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(sent.value)
        total = np.zeros(len(table.sorted), np.int64)
        for b in batches:
            w = Words(b["text"])
            h, place = shingles(w, size)
            where, number = table.find(h)
            pairs = np.unique(w.doc[place[where]] * len(table.sorted) + number)
            total += np.bincount(pairs % len(table.sorted), minlength=len(table.sorted))
        some = np.flatnonzero(total)
        yield pa.record_batch({"h": table.sorted[some].view(np.int64), "c": total[some]})

    rows = docs.select(column(docs, "text", "string").alias("text")).filter("text IS NOT NULL").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).collect()
    return {r.h & (2**64 - 1): r.c for r in rows}


class Index:
    """Prefix shingles of a slice of the benchmark."""

    def __init__(self, items: list[Item], counts: dict[int, int], size: int) -> None:
        self.items, self.size = items, size
        entries = []
        for k, item in enumerate(items):
            rare = sorted(item.distinct.tolist(), key=lambda x: (counts.get(x, 0), x))[: len(item.distinct) - item.needed + 1]
            entries += [(x, k) for x in rare]
        entries.sort()
        self.hash = np.array([e[0] for e in entries], np.uint64)
        self.item = np.array([e[1] for e in entries], np.int64)
        self.needed = np.array([i.needed for i in items])
        self.lookup = Lookup(self.hash)
        self.lo = np.searchsorted(self.hash, self.lookup.sorted)
        self.hi = np.searchsorted(self.hash, self.lookup.sorted, "right")

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text number, item number, first word, words, containment) of the best window of each contaminated pair."""
        w = Words(texts)
        h, place = shingles(w, self.size)
        where, number = self.lookup.find(h)
        if not len(where):
            return []
        times = self.hi[number] - self.lo[number]
        entry = np.repeat(self.lo[number] - np.cumsum(times) + times, times) + np.arange(times.sum())
        at = np.repeat(place[where], times)
        doc, item = w.doc[at], self.item[entry]
        long_enough = w.count[doc] - self.size + 1 >= self.needed[item]
        todo = np.unique(np.stack([doc, item, at - w.at[doc]], 1)[long_enough], axis=0)
        begin = np.searchsorted(place, w.at)
        out = []
        # the hits of one text and item: runs of places that windows of the item's length around them can reach
        first = np.flatnonzero(np.concatenate([[True], (todo[1:, :2] != todo[:-1, :2]).any(1)])) if len(todo) else np.zeros(0, np.int64)
        for rows in np.split(todo, first[1:]) if len(todo) else []:
            d, k = rows[0, :2].tolist()
            it, hits = self.items[k], rows[:, 2]
            width = it.words - self.size + 1  # shingles of a window of as many words as the item
            last = int(w.count[d]) - self.size + 1
            best, best_at = 0, 0
            for run in np.split(hits, np.flatnonzero(np.diff(hits) >= 2 * width - 1) + 1):
                lo, hi = max(0, int(run[0]) - width + 1), min(last, int(run[-1]) + width)
                mine = h[begin[d] + lo : begin[d] + hi]
                number = np.searchsorted(it.distinct, mine).clip(max=len(it.distinct) - 1)
                number = np.where(it.distinct[number] == mine, number, -1)
                if len(np.unique(number[number >= 0])) < max(it.needed, best + 1):
                    continue
                n, where = _best_window(number, width, len(it.distinct))
                if n >= it.needed and n > best:
                    best, best_at = n, lo + where
            if best:
                out.append((d, k, best_at, min(it.words, int(w.count[d]) - best_at), best / len(it.distinct)))
        return out


def _best_window(number: np.ndarray, width: int, distinct: int) -> tuple[int, int]:
    """(most distinct numbers >= 0 in a run of `width` places, where the first such run begins)."""
    seen = [0] * distinct
    now = best = best_at = 0
    values = number.tolist()
    for j, x in enumerate(values):
        if x >= 0:
            seen[x] += 1
            now += seen[x] == 1
        if j >= width and values[j - width] >= 0:
            seen[values[j - width]] -= 1
            now -= seen[values[j - width]] == 0
        if now > best:
            best, best_at = now, max(0, j - width + 1)
    return best, best_at


def slices_of(benchmark: DataFrame, slice_words: int) -> list[DataFrame]:
    """The benchmark, in as many slices as its words need."""
    n = benchmark.select(F.coalesce(F.sum(F.length(column(benchmark, "text", "string"))), F.lit(0))).first()[0]
    slices = max(1, int(np.ceil(n / 5 / slice_words)))
    return [benchmark] if slices == 1 else [benchmark.filter(F.pmod(F.xxhash64(column(benchmark, "item_id", "long")), F.lit(slices)) == k) for k in range(slices)]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, containment): the best window, of equal ones the first, of every contaminated (document, item) pair.

    Null or wordless texts and items match nothing, nor do items of fewer words than a shingle. Rows with a null doc_id
    are reported with a null doc_id; repeated rows are reported each. Of items that repeat an id each text counts by itself.
    Texts of any length are searched whole. Empty tables give an empty result. Other columns don't matter.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).filter("text IS NOT NULL")
    schema = "doc_id long, item_id long, first_word int, n_words int, containment double"
    out = spark.createDataFrame([], schema)
    slices = slices_of(benchmark, slice_words)
    for part in slices:
        items = read_items(part, size, containment)
        if not items:
            continue
        sent = spark.sparkContext.broadcast(Index(items, shingle_counts(docs, items, size), size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                found = sent.value.matches(b["text"])
                ids = b["doc_id"].take(pa.array([m[0] for m in found], pa.int64()))
                yield pa.record_batch({"doc_id": ids, "item_id": pa.array([sent.value.items[m[1]].item_id for m in found], pa.int64()), "first_word": pa.array([m[2] for m in found], pa.int32()), "n_words": pa.array([m[3] for m in found], pa.int32()), "containment": pa.array([m[4] for m in found], pa.float64())})

        found = rows.mapInArrow(run, schema)
        if len(slices) > 1:  # one slice's index at a time
            found = materialise(found, "contaminated")
            sent.destroy()
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs without the contaminated rows, in one pass for each slice of the benchmark, without a shuffle; columns are those of docs.

    What is contaminated is said at contaminated(). Rows with a null, empty or wordless text stay, as do rows with a null doc_id that
    aren't contaminated; of repeated rows all go or all stay. No column is changed, whatever its name.
    """
    spark = docs.sparkSession
    tune(spark)
    names = docs.columns
    kept = numbered(docs)
    plain, fields = kept.columns, kept.schema
    before = None
    slices = slices_of(benchmark, slice_words)
    for part in slices:
        items = read_items(part, size, containment)
        if not items:
            continue
        sent = spark.sparkContext.broadcast(Index(items, shingle_counts(kept.toDF(*names).select(column(docs, "text", "string").alias("text")), items, size), size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in sent.value.matches(b["text"])]] = False
                yield b.select(plain).filter(pa.array(keep))

        kept = kept.withColumn("text", field(docs, "text", "string")).mapInArrow(run, fields)
        if len(slices) > 1:
            kept = materialise(kept, "clean")
            sent.destroy()
            if before is not None:
                discard(before)
            before = kept
    return kept.toDF(*names)
