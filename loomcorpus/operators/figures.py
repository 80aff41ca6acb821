"""Figures of every phrase of an index, in order, with phrases moved in Arrow blocks instead of rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import materialise
from .search import chunks, distinct, grams, joined, postings

#: Bytes of text whose phrases are counted at once before they are moved; of text whose phrases make a range of the alphabet, which a worker has in memory.
TEXT_AT_ONCE, RANGE_BYTES = 2 << 20, 8 << 20
#: Rows of a block; about as many of a part of the result.
BLOCK_ROWS, PART_ROWS = 100_000, 1_000_000
#: Match counts from here on share a class with others of as many bits.
MANY = 4096
#: Phrases sampled for the bound of each range, on the average.
SAMPLES = 50

_COUNTED = pa.schema([("phrase", pa.string()), ("match_count", pa.int64()), ("page_count", pa.int64()), ("entered", pa.int64())])


def _blocks(rows: pa.RecordBatch, **at: int) -> Iterator[pa.RecordBatch]:
    """rows as serialised blocks, with the numbers that say where they belong."""
    for piece, a in enumerate(range(0, rows.num_rows, BLOCK_ROWS)):
        part = rows.slice(a, BLOCK_ROWS)
        block = part.serialize()
        numbers = {k: pa.array([v], pa.int32()) for k, v in {**at, "piece": piece, "n_rows": part.num_rows, "size": block.size}.items()}
        yield pa.RecordBatch.from_pydict({**numbers, "block": pa.array([pa.compress(block, "zstd", asbytes=True)], pa.binary())})


def _unpacked(blocks: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
    for size, block in zip(blocks["size"].to_pylist(), blocks["block"]):
        yield pa.ipc.read_record_batch(pa.decompress(block.as_buffer(), size, "zstd"), _COUNTED)


def _class(n: np.ndarray) -> np.ndarray:
    """Rising with n: n itself where it is under MANY, and beyond a number for as many bits."""
    return np.where(n < MANY, n, MANY + np.frexp(n.astype(float))[1]).astype(np.int16)


def _splits(pages: DataFrame) -> list[bytes]:
    """Phrases that divide the alphabet into ranges, each with the phrases of about RANGE_BYTES of text. Only the ranges' sizes depend on the sample."""
    size, n = pages.agg(F.sum(F.octet_length("text_content")), F.count("text_content")).first()
    ranges = -(-(size or 0) // RANGE_BYTES)
    if ranges < 2:
        return []
    some = pages.filter(F.rand(1) < max(2000, 2 * ranges) / n)
    per_page = 0.32 * size / n
    kept = postings(some).filter(F.rand(2) < SAMPLES * ranges / (per_page * min(n, max(2000, 2 * ranges)))).select("phrase")
    phrases = sorted(r.phrase.encode() for r in kept.collect())
    return sorted({phrases[len(phrases) * k // ranges] for k in range(1, ranges)}) if phrases else []


def phrase_figures(pages: DataFrame, entered: DataFrame) -> DataFrame:
    """(phrase, extracted, match_count, page_count) of every phrase of the pages' index and of each of `entered` (phrase), most matches first, then by phrase.

    Each row of pages has to be one page. A phrase that is in the index and entered has two rows. Phrases are counted by pieces of text, go
    to their range of the alphabet and are added up there; the sums are stored, and go in order once it is known how many there are of each
    match count. All of it moves as blocks of rows.
    """
    spark = pages.sparkSession
    splits = _splits(pages)

    def ranged(phrases: pa.Array, *figures: pa.Array) -> Iterator[pa.RecordBatch]:
        """Blocks of phrases, which are in order, by their range."""
        rows = pa.RecordBatch.from_arrays([phrases, *figures], schema=_COUNTED)
        at = [0, *(bisect_left(range(len(phrases)), s, key=lambda i: phrases[i].as_py().encode()) for s in splits), len(phrases)]
        for k, (a, e) in enumerate(zip(at, at[1:])):
            yield from _blocks(rows.slice(a, e - a), range=k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text_content", TEXT_AT_ONCE):
                words, page, gram = grams(T.token_lists(b["text_content"]))
                (*gram, _), n = distinct([*gram, page], [len(words) + 1] * 3 + [b.num_rows])
                if len(n):
                    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([g[1:] != g[:-1] for g in gram])])
                    figures = np.add.reduceat(n, new), np.diff(np.r_[new, len(n)]), np.zeros(len(new), np.int64)
                    yield from ranged(joined(words, [g[new] for g in gram]), *map(pa.array, figures))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            phrases = b["phrase"].take(pc.sort_indices(b["phrase"]))
            none = pa.array(np.zeros(len(phrases), np.int64))
            yield from ranged(phrases, none, none, pa.array(np.ones(len(phrases), np.int64)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a range, by class and phrase."""
        parts, at = [], 0
        for b in batches:
            parts += _unpacked(b)
            at = b["range"][0].as_py() if b.num_rows else at
        if not parts:
            return
        every = pa.concat_batches(parts)
        parts.clear()
        every = every.take(pc.sort_indices(every["phrase"]))
        new = np.flatnonzero(np.r_[True, pc.not_equal(every["phrase"][1:], every["phrase"][:-1]).to_numpy(zero_copy_only=False)])
        figures = [np.add.reduceat(every[c].to_numpy(), new) for c in _COUNTED.names[1:]]
        kind = _class(figures[0])
        order = np.argsort(kind, kind="stable")
        kind, rows = kind[order], pa.RecordBatch.from_arrays([every["phrase"].take(pa.array(new[order])), *(pa.array(f[order]) for f in figures)], schema=_COUNTED)
        del every
        new = np.r_[np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]), len(kind)]
        for a, e in zip(new, new[1:]):
            yield from _blocks(rows.slice(a, e - a), kind=int(kind[a]), range=at)

    block = "piece int, n_rows int, size int, block binary"
    found = pages.select("text_content").filter("text_content IS NOT NULL").mapInArrow(count, f"range int, {block}")
    marks = entered.select("phrase").filter("phrase IS NOT NULL").mapInArrow(enter, f"range int, {block}")
    moved = found.unionByName(marks).repartitionById(len(splits) + 1, "range")
    sums = materialise(moved.mapInArrow(add, f"kind int, range int, {block}"), "figures")

    # each class in parts of whole ranges, as many as its rows need; classes with few rows share a part
    sizes = sums.groupBy("kind").agg(F.sum("n_rows").alias("n")).orderBy(F.desc("kind")).collect()
    firsts, parts, room = {}, 0, 0
    for kind, n in sizes:
        if n > room or kind >= MANY:
            parts, room = parts + 1, PART_ROWS
        many = 1 if kind >= MANY else -(-n // PART_ROWS)
        firsts[kind] = (parts - 1, min(many, len(splits) + 1))
        parts, room = parts + firsts[kind][1] - 1, (room - n if firsts[kind][1] == 1 else 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's rows in order: its blocks are, but for classes of several counts."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        blocks = pa.Table.from_batches(got).sort_by([("kind", "descending"), ("range", "ascending"), ("piece", "ascending")])
        mixed = blocks["kind"][0].as_py() >= MANY
        if mixed:
            rows = pa.Table.from_batches(_unpacked(blocks))
            rows = rows.take(pc.sort_indices(rows, [("match_count", "descending"), ("phrase", "ascending")])).to_batches()
        for b in rows if mixed else _unpacked(blocks):
            known, entered_ = (pc.greater(b[c], 0).to_numpy(zero_copy_only=False) for c in ("page_count", "entered"))
            twice = np.repeat(np.arange(b.num_rows), known.astype(int) + entered_)
            extracted = known[twice]
            extracted[np.flatnonzero(np.r_[twice[1:] == twice[:-1], False])] = False
            own = b.select(["phrase", "match_count", "page_count"]).take(pa.array(twice))
            yield pa.RecordBatch.from_arrays([own["phrase"], pa.array(extracted), own["match_count"], own["page_count"]], names=["phrase", "extracted", "match_count", "page_count"])

    # a few thousand classes at most
    places = spark.createDataFrame([(k, *v) for k, v in firsts.items()], "kind int, first int, parts int")
    place = (F.col("first") + F.floor(F.col("range").cast("long") * F.col("parts") / (len(splits) + 1))).cast("int")
    placed = sums.join(F.broadcast(places), "kind").withColumn("place", place)
    return placed.repartitionById(max(parts, 1), "place").mapInArrow(listed, "phrase string, extracted boolean, match_count long, page_count long")
