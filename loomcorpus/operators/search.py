"""The inverted index and boosted TF-IDF search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions import text as T
from ..shared import materialise, small

#: Bytes of text whose n-grams are in memory at once, if it isn't one page.
TEXT_AT_ONCE = 1 << 19


def chunks(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with up to `most` bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, e - a)
        a = e


def grams(toks: pa.Array, prefixes: list[str] | None = None) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """(words, page number, three numbers) of the n-grams of one to three words of each page's tokens.

    words are the distinct ones in order. A number is a word's place in words, plus one; 0 is no word. With prefixes, n-grams whose first word may begin one.
    """
    coded, page = toks.flatten().dictionary_encode(), pc.list_parent_indices(toks).to_numpy().astype(np.uint64)
    order = pc.sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(order), np.empty(len(order), np.uint64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.uint64)
    word = rank[coded.indices.to_numpy()]
    first = np.arange(len(word))
    if prefixes is not None:  # a phrase begins with a prefix only if its first word begins with the prefix's, or is it
        begins = [pc.starts_with(words, g.split(" ")[0]).to_numpy(zero_copy_only=False) for g in prefixes]
        first = np.flatnonzero(np.r_[False, np.logical_or.reduce(begins)][word]) if begins else first[:0]
    pages, numbers = [], []
    for n in (1, 2, 3):
        if n > 1:
            first = first[first + n - 1 < len(word)]
            first = first[page[first + n - 1] == page[first]]
        pages.append(page[first])
        numbers.append([word[first + k] if k < n else np.zeros(len(first), np.uint64) for k in range(3)])
    return words, np.concatenate(pages), [np.concatenate(x) for x in zip(*numbers)]


def distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns, in order, and how often each occurs; a column's numbers are under its size."""
    if math.prod(sizes) < 1 << 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c, s in zip(columns, sizes):
            key = key * np.uint64(s) + c
        key.sort()
        new = np.flatnonzero(np.r_[[True] * bool(len(key)), key[1:] != key[:-1]])
        left, out = key[new], []
        for s in reversed(sizes):
            left, c = np.divmod(left, np.uint64(s)) if s > 1 else (left, np.zeros(len(left), np.uint64))
            out.insert(0, c)
    else:
        order = np.lexsort(columns[::-1])
        rows = [c[order] for c in columns]
        new = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in rows])])
        out = [c[new] for c in rows]
    return out, np.diff(np.r_[new, len(columns[0])]).astype(np.int64)


def joined(words: pa.Array, gram: list[np.ndarray]) -> pa.Array:
    """The phrases of n-grams given by numbers as grams() has them."""
    parts = [words.take(pa.array(g.astype(np.int64) - 1, mask=g == 0)) for g in gram]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _counted(toks: pa.Array, prefixes: list[str] | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(page number, phrase, occurrences) of the n-grams of one to three words of each page's tokens."""
    words, page, gram = grams(toks, prefixes)
    (page, *gram), n = distinct([page, *gram], [len(toks)] + [len(words) + 1] * 3)
    page, phrase, n = page.astype(np.int64), joined(words, gram), pa.array(n, pa.int32())
    if prefixes:
        ok = pc.starts_with(phrase, prefixes[0])
        for g in prefixes[1:]:
            ok = pc.or_(ok, pc.starts_with(phrase, g))
        page, phrase, n = page[ok.to_numpy(zero_copy_only=False)], phrase.filter(ok), n.filter(ok)
    return page, phrase, n


def postings(pages: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """(page_id, url, crawl_job_id, phrase, occurrences, match_type, found_at): the n-gram index of pages, each row of which is a page.

    A page's phrases are counted where the page is, in Arrow batches, so building the index moves nothing. With prefixes, only
    phrases that start with one of them; words that can't begin one are left out before phrases are made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text_content", TEXT_AT_ONCE):
                page, phrase, n = _counted(T.token_lists(b["text_content"]), prefixes)
                own = b.select(["page_id", "url", "crawl_job_id", "crawled_at"]).take(pa.array(page))
                yield pa.RecordBatch.from_arrays([*own.columns, phrase, n], names=[*own.schema.names, "phrase", "occurrences"])

    rows = pages.select("page_id", "url", "crawl_job_id", "crawled_at", "text_content").filter("text_content IS NOT NULL")
    schema = StructType([f for f in rows.schema if f.name != "text_content"]).add("phrase", StringType()).add("occurrences", IntegerType())
    counted = rows.mapInArrow(run, schema)
    return counted.select("page_id", "url", "crawl_job_id", "phrase", "occurrences", F.lit("content").alias("match_type"), F.col("crawled_at").alias("found_at"))


def scored(matches: DataFrame, total: DataFrame, ngrams: list[str]) -> DataFrame:
    """matches with df, idf, tf, boosts and score; `total` is one row with n, the number of pages in scope. matches are used twice: pass stored ones."""
    df = matches.groupBy("phrase").agg(F.countDistinct("page_id").alias("df"))
    out = matches.join(df, "phrase").crossJoin(F.broadcast(total))  # one row
    return out.withColumns(
        {
            "tf": F.when(F.col("occurrences") > 1, 1 + F.log10(F.col("occurrences"))).otherwise(F.lit(1.0)),
            "idf": F.greatest(F.log10(F.greatest(F.col("n"), F.lit(1)) / F.greatest(F.col("df"), F.lit(1))), F.lit(0.0)),
            "match_boost": F.when(F.col("match_type") == "url", 2.0).when(F.col("match_type") == "anchor", 1.5).otherwise(1.0),
            "exact_boost": F.when(F.col("phrase").isin(*ngrams), 3.0).otherwise(1.0),
        }
    ).withColumn("score", F.col("tf") * F.col("idf") * F.col("match_boost") * F.col("exact_boost"))


def phrase_level(rows: DataFrame, ngrams: list[str]) -> DataFrame:
    """One row for each (url, phrase, match_type), with rounded figures as a result lists them."""
    by = rows.groupBy("url", "phrase", "match_type").agg(
        F.sum("occurrences").cast("int").alias("occurrences"),
        F.round(F.sum("tf"), 3).alias("tf"),
        F.round(F.max("idf"), 3).alias("idf"),
        F.round(F.sum(F.col("tf") * F.col("idf")), 3).alias("tfidf"),
        F.max("match_boost").alias("match_boost"),
        F.max("exact_boost").alias("exact_boost"),
        F.round(F.sum("score"), 3).alias("phrase_score"),
    )
    return by


#: Phrases whose automaton is in a worker's memory at once.
PHRASES_AT_ONCE = 50_000


def detect(rows: DataFrame, phrases: DataFrame, text: str, width: int = 100) -> DataFrame:
    """rows with (phrase_id, phrase, occurrences, context) for every phrase that occurs in the normalised text, whatever the case.

    occurrences doesn't count overlaps; context is `width` characters on either side of the first place, ... marks a cut side. One
    pass of an automaton over each text finds all phrases of a slice; more than PHRASES_AT_ONCE take more passes. Empty
    phrases occur nowhere.
    """
    phrases = phrases.filter("length(phrase) > 0").select("phrase_id", "phrase")
    slices = max(1, -(-phrases.count() // PHRASES_AT_ONCE))
    names = rows.columns
    clean = rows.withColumn("_clean", T.phrase_text(F.col(text)))
    schema = StructType([*rows.schema.fields, *phrases.schema.fields]).add("occurrences", IntegerType()).add("context", StringType())
    out = None
    for k in range(slices):
        part = phrases.filter(F.pmod(F.xxhash64("phrase_id"), F.lit(slices)) == k).collect()  # about PHRASES_AT_ONCE
        entries = [(r["phrase_id"], r["phrase"]) for r in part]
        sent = rows.sparkSession.sparkContext.broadcast(entries)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import ahocorasick

            automaton = ahocorasick.Automaton()
            same: dict[str, list[int]] = {}
            for i, (_, phrase) in enumerate(sent.value):
                same.setdefault(phrase.lower(), []).append(i)
            for low, which in same.items():
                automaton.add_word(low, (low, which))
            automaton.make_automaton()
            for b in batches:
                found = []
                for row, t in enumerate(b["_clean"].to_pylist() if same else []):
                    low = (t or "").lower()
                    for word, which in {w: i for _, (w, i) in automaton.iter(low)}.items():
                        at, n = low.find(word), low.count(word)
                        a, e = max(at - width, 0), min(at + len(word) + width, len(t))
                        context = ("..." if a else "") + t[a:e].strip(" ") + ("..." if e < len(t) else "")
                        found += [(row, i, n, context) for i in which]
                row, i, n, context = zip(*found) if found else ((), (), (), ())
                own = b.select(names).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([sent.value[x][c] for x in i], kind) for c, kind in enumerate(kinds)), pa.array(n, pa.int32()), pa.array(context, pa.string())], schema=target)

        target = to_arrow_schema(schema)
        kinds = [target.field(len(names)).type, target.field(len(names) + 1).type]
        hits = clean.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def page_level(rows: DataFrame, ngrams: list[str]) -> DataFrame:
    """One row for each url: score with the bonus for matching several query n-grams, their number, and the summed rounded phrase scores."""
    tagged = rows.withColumn("hit", F.filter(F.array(*(F.lit(n) for n in ngrams)), lambda n: F.col("phrase").startswith(n)))
    pages = tagged.groupBy("url").agg(
        F.sum("score").alias("plain"),
        F.max("found_at").alias("found_at"),
        F.min_by("crawl_job_id", F.struct("found_at", "page_id")).alias("crawl_job_id"),
        F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("matched_terms"),
        F.sum("occurrences").alias("occurrences"),
    )
    bonus = F.when(F.col("matched_terms") > 1, 1 + 0.5 * (F.col("matched_terms") - 1)).otherwise(F.lit(1.0))
    return pages.withColumn("multi_term_bonus", bonus).withColumn("total", F.col("plain") * bonus)


def search(pages: DataFrame, jobs: DataFrame, words: list[str], limit: int | None = None, offset: int = 0, matches: DataFrame | None = None) -> DataFrame:
    """Keyword search: (url, domain, crawl_job_id, found_at, score, score_percent, matched_terms, occurrences), best first.

    Without words or matches the result is empty. limit and offset page through it. `matches` replaces the content index, as with
    postings read from a store that is sorted by phrase (see sources.tables). What a search finds is stored once for its two uses.
    """
    ngrams = T.query_ngrams(words)
    live = pages.filter(~F.col("is_archived"))
    found = postings(live, ngrams) if matches is None else matches
    if not ngrams:
        found = found.filter("false")
    rows = scored(materialise(found, "matches"), live.agg(F.count("*").alias("n")), ngrams)
    result = materialise(page_level(rows, ngrams), "result")
    top = result.agg(F.max("total").alias("top"))
    out = result.crossJoin(F.broadcast(top)).join(small(jobs.select(F.col("id").alias("crawl_job_id"), "domain")), "crawl_job_id", "left")
    out = out.select(
        "url",
        F.coalesce("domain", F.lit("")).alias("domain"),
        "crawl_job_id",
        F.date_format("found_at", "yyyy-MM-dd HH:mm:ss").alias("found_at"),
        F.round("total", 3).alias("score"),
        F.round(F.when(F.col("top") > 0, F.col("total") / F.col("top") * 100).otherwise(F.lit(0.0)), 1).alias("score_percent"),
        F.col("matched_terms").cast("int").alias("matched_terms"),
        F.col("occurrences").cast("int").alias("occurrences"),
    ).orderBy(F.desc("score"), F.desc("found_at"), "url")
    if limit is not None:
        out = out.offset(offset).limit(limit)
    return out
