"""Queries over texts: tokens, the n-gram index, keyword search, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hooks
from ..functions import text as T
from ..functions.lexicon import STOP_WORDS
from ..operators import search as S
from ..operators.figures import phrase_figures
from ..shared import materialise, small
from ..tables import JOBS_SQL, PAGES_SQL, crawl_jobs, crawled_pages, read, sql_values, values
from .registry import register

#: The words of the queries' search.
WORDS = ["attion", "erble"]
NGRAMS = T.query_ngrams(WORDS)

_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + ")"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: strlen(t) >= 2 AND t NOT IN {_STOP_SQL} AND NOT regexp_full_match(t, '\\p{{Nd}}+'))"


def grams_sql(t: str) -> str:
    two = f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    three = f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2])"
    return f"list_concat(list_concat({t}, {two}), {three})"


TOKENS_SQL = f"tokens_ AS (SELECT *, {tokens_sql('text_content')} AS toks FROM pages_)"
#: Postings of phrases that begin with one of the search's n-grams.
POSTINGS_SQL = f"""{TOKENS_SQL},
grams_ AS (SELECT page_id, url, crawl_job_id, crawled_at, unnest({grams_sql('toks')}) AS phrase FROM tokens_),
postings_ AS (
  SELECT page_id, url, crawl_job_id, phrase, count(*)::INTEGER AS occurrences, 'content' AS match_type, crawled_at AS found_at
  FROM grams_ WHERE {' OR '.join(f"starts_with(phrase, '{n}')" for n in NGRAMS)} GROUP BY ALL)"""
_BASE = f"WITH {PAGES_SQL}, {JOBS_SQL}, {POSTINGS_SQL}"


@register("tokenize", f"WITH {PAGES_SQL}, {TOKENS_SQL} SELECT page_id, array_to_string(toks, ' ') AS tokens, len(toks)::INTEGER AS n_tokens FROM tokens_")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text_content"))
    return crawled_pages(spark, sf_dir).select("page_id", t.alias("t")).select("page_id", F.concat_ws(" ", "t").alias("tokens"), F.size("t").alias("n_tokens"))


@register("ngram_counts", f"WITH {PAGES_SQL}, {TOKENS_SQL}, g AS (SELECT page_id, unnest({grams_sql('toks')}) AS phrase FROM tokens_) SELECT page_id, phrase, count(*)::INTEGER AS occurrences FROM g GROUP BY ALL")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(crawled_pages(spark, sf_dir)).select("page_id", "phrase", "occurrences")


#: Phrases entered by hand; they stay out of the word index.
MANUAL = [(1, "attion", True), (2, "of the", True), (3, "nicht", True), (4, "erble thing", False), (5, "und", True), (6, "thing", True)]
_MANUAL_SQL = sql_values(MANUAL, "id, phrase, is_active")
_MANUAL_SCHEMA = "id long, phrase string, is_active boolean"


@register("word_index", f"WITH {PAGES_SQL}, {TOKENS_SQL}, g AS (SELECT page_id, url, crawl_job_id, unnest({grams_sql('toks')}) AS phrase FROM tokens_) SELECT page_id, url, crawl_job_id, phrase, count(*)::INTEGER AS occurrences, 'content' AS match_type FROM g WHERE phrase NOT IN (SELECT phrase FROM {_MANUAL_SQL}) GROUP BY ALL")
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = values(spark, MANUAL, _MANUAL_SCHEMA)
    rows = S.postings(crawled_pages(spark, sf_dir)).join(small(manual), "phrase", "left_anti")
    return rows.select("page_id", "url", "crawl_job_id", "phrase", "occurrences", "match_type")


@register("new_phrases", f"WITH {PAGES_SQL}, {TOKENS_SQL}, g AS (SELECT DISTINCT unnest(toks) AS phrase FROM tokens_) SELECT phrase FROM g EXCEPT SELECT phrase FROM {_MANUAL_SQL}")
def new_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = crawled_pages(spark, sf_dir).select(F.explode(T.tokens(F.col("text_content"))).alias("phrase")).distinct()
    return words.join(small(values(spark, MANUAL, _MANUAL_SCHEMA)), "phrase", "left_anti")


@register("phrase_df", f"{_BASE} SELECT phrase, count(DISTINCT page_id) AS df FROM postings_ GROUP BY phrase")
def phrase_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(crawled_pages(spark, sf_dir), NGRAMS).groupBy("phrase").agg(F.countDistinct("page_id").alias("df"))


_SCORED_SQL = f"""{_BASE},
df_ AS (SELECT phrase, count(DISTINCT page_id) AS df FROM postings_ GROUP BY phrase),
n_ AS (SELECT greatest(count(*), 1) AS n FROM pages_ WHERE NOT is_archived),
scored_ AS (
  SELECT *, tf * idf * match_boost * exact_boost AS score FROM (
    SELECT p.*, n, df, CASE WHEN occurrences > 1 THEN 1 + log10(occurrences) ELSE 1.0::DOUBLE END AS tf, greatest(log10(n / greatest(df, 1)::DOUBLE), 0.0) AS idf,
           CASE match_type WHEN 'url' THEN 2.0::DOUBLE WHEN 'anchor' THEN 1.5 ELSE 1.0 END AS match_boost,
           CASE WHEN phrase IN ({', '.join(f"'{n}'" for n in NGRAMS)}) THEN 3.0::DOUBLE ELSE 1.0 END AS exact_boost
    FROM postings_ p JOIN df_ USING (phrase) CROSS JOIN n_))"""
_HITS = " + ".join(f"max(CASE WHEN starts_with(phrase, '{n}') THEN 1 ELSE 0 END)" for n in NGRAMS)
_RESULT_SQL = f"""
pages2_ AS (
  SELECT url, sum(score) AS plain, max(found_at) AS found_at, arg_min(crawl_job_id, page_id) AS crawl_job_id, ({_HITS})::INTEGER AS matched_terms, sum(occurrences)::INTEGER AS occurrences
  FROM scored_ GROUP BY url),
result_ AS (SELECT *, plain * (1 + 0.5 * (matched_terms - 1)) AS total FROM pages2_)
"""
_SEARCH_SQL = """
SELECT url, coalesce(domain, '') AS domain, crawl_job_id, strftime(found_at, '%Y-%m-%d %H:%M:%S') AS found_at, round(total, 3) AS score,
       round(CASE WHEN max(total) OVER () > 0 THEN total / max(total) OVER () * 100 ELSE 0.0 END, 1) AS score_percent, matched_terms, occurrences
FROM result_ r LEFT JOIN jobs_ j ON j.id = r.crawl_job_id
"""


@register("tf_idf", f"{_SCORED_SQL} SELECT page_id, phrase, round(tf, 4) AS tf, round(idf, 4) AS idf, round(tf * idf, 4) AS tfidf FROM scored_")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled_pages(spark, sf_dir)
    rows = S.scored(materialise(S.postings(pages, NGRAMS), "matches"), pages.agg(F.count("*").alias("n")), NGRAMS)
    return rows.select("page_id", "phrase", F.round("tf", 4).alias("tf"), F.round("idf", 4).alias("idf"), F.round(F.col("tf") * F.col("idf"), 4).alias("tfidf"))


@register("keyword_search", f"{_SCORED_SQL}, {_RESULT_SQL} {_SEARCH_SQL}")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(crawled_pages(spark, sf_dir), crawl_jobs(spark, sf_dir), WORDS)


@register("keyword_search_job", f"{_SCORED_SQL}, {_RESULT_SQL} {_SEARCH_SQL}".replace("FROM documents)", "FROM documents WHERE source = 'src3')", 1))
def keyword_search_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled_pages(spark, sf_dir).filter(F.col("crawl_job_id") == "src3")
    return S.search(pages, crawl_jobs(spark, sf_dir), WORDS)


_TYPED_SQL = _SCORED_SQL.replace("'content' AS match_type", "CASE page_id % 10 WHEN 0 THEN 'url' WHEN 1 THEN 'anchor' ELSE 'content' END AS match_type")


def _typed(pages: DataFrame) -> DataFrame:
    """The index with some postings counted as found in URLs and anchors, so that all boosts occur."""
    kind = F.when(F.col("page_id") % 10 == 0, "url").when(F.col("page_id") % 10 == 1, "anchor").otherwise("content")
    return materialise(S.postings(pages, NGRAMS).withColumn("match_type", kind), "matches")


@register("keyword_search_phrases", f"{_TYPED_SQL} SELECT url, phrase, match_type, sum(occurrences)::INTEGER AS occurrences, round(sum(tf), 3) AS tf, round(max(idf), 3) AS idf, round(sum(tf * idf), 3) AS tfidf, max(match_boost) AS match_boost, max(exact_boost) AS exact_boost, round(sum(score), 3) AS phrase_score FROM scored_ GROUP BY url, phrase, match_type")
def keyword_search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled_pages(spark, sf_dir)
    return S.phrase_level(S.scored(_typed(pages), pages.agg(F.count("*").alias("n")), NGRAMS), NGRAMS)


@register(
    "keyword_search_detail",
    f"""{_TYPED_SQL}, {_RESULT_SQL}, ph_ AS (SELECT url, phrase, match_type, sum(occurrences) AS o, round(sum(score), 3) AS ps FROM scored_ GROUP BY ALL),
    best_ AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ps DESC, CASE WHEN phrase IN ({', '.join(f"'{n}'" for n in NGRAMS)}) THEN 0 ELSE 1 END, o DESC, phrase, match_type) AS k, sum(ps) OVER (PARTITION BY url) AS raw FROM ph_)
    SELECT url, n AS total_docs, matched_terms, 1 + 0.5::DOUBLE * (matched_terms - 1) AS multi_term_bonus, round(raw, 3) AS raw_score, round(total, 3) AS final_score, phrase, match_type, r.occurrences
    FROM result_ r JOIN best_ b USING (url) CROSS JOIN n_ WHERE k = 1""",
)
def keyword_search_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score's breakdown and the primary phrase of each page."""
    pages = crawled_pages(spark, sf_dir)
    n = pages.filter(~F.col("is_archived")).agg(F.count("*").alias("n"))
    rows = materialise(S.scored(_typed(pages), n, NGRAMS), "scored")
    exact = F.when(F.col("phrase").isin(*NGRAMS), 0).otherwise(1)
    phrases = S.phrase_level(rows, NGRAMS).groupBy("url").agg(
        F.round(F.sum("phrase_score"), 3).alias("raw_score"),
        F.min(F.struct((-F.col("phrase_score")).alias("s"), exact.alias("e"), (-F.col("occurrences")).alias("o"), "phrase", "match_type")).alias("best"),
    )
    joined = S.page_level(rows, NGRAMS).join(phrases, "url").crossJoin(F.broadcast(n))
    return joined.select("url", F.greatest("n", F.lit(1)).alias("total_docs"), F.col("matched_terms").cast("int").alias("matched_terms"), "multi_term_bonus", "raw_score", F.round("total", 3).alias("final_score"), "best.phrase", "best.match_type", F.col("occurrences").cast("int").alias("occurrences"))


@register("phrase_prefix_filter", f"{_BASE} SELECT DISTINCT phrase FROM postings_")
def phrase_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(crawled_pages(spark, sf_dir), NGRAMS).select("phrase").distinct()


_QUERIES = [(1, "Real-time, 2024 é x Été"), (2, "cat of dog"), (3, "The THING"), (4, "..."), (5, "attion erble attion")]


@register("query_tokens", f"SELECT id, array_to_string({tokens_sql('q')}, ' ') AS tokens FROM {sql_values(_QUERIES, 'id, q')}")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _QUERIES, "id int, q string").select("id", F.concat_ws(" ", T.tokens(F.col("q"))).alias("tokens"))


@register("query_ngrams", f"""WITH q_ AS (SELECT id, {tokens_sql('q')} AS toks FROM {sql_values([*_QUERIES, (6, 'river house stone tree')], 'id, q')}),
n_ AS (SELECT id, toks, unnest(range(1, len(toks) + 1)) AS n FROM q_), a_ AS (SELECT id, toks, n, unnest(range(1, len(toks) - n + 2)) AS a FROM n_),
g_ AS (SELECT id, array_to_string(toks[a:a + n - 1], ' ') AS ngram, min(struct_pack(x := -n, y := a)) AS k FROM a_ GROUP BY ALL)
SELECT id, ngram, row_number() OVER (PARTITION BY id ORDER BY k)::INTEGER AS rank FROM g_""")
def query_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of each query, longest first, each once; the same as functions.text.query_ngrams gives for one query."""
    rows = values(spark, [*_QUERIES, (6, "river house stone tree")], "id int, q string")
    return rows.select("id", F.posexplode(T.ngrams_of_query(T.tokens(F.col("q")))).alias("k", "ngram")).select("id", "ngram", (F.col("k") + 1).alias("rank"))


@register("word_context", f"WITH {PAGES_SQL} SELECT page_id, trim(substring(lower(text_content), greatest(instr(lower(text_content), 'thing') - 60, 1), instr(lower(text_content), 'thing') + 65 - greatest(instr(lower(text_content), 'thing') - 60, 1))) AS context FROM pages_ WHERE instr(lower(text_content), 'thing') > 0")
def word_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled_pages(spark, sf_dir).filter(F.lower("text_content").contains("thing"))
    return pages.select("page_id", T.word_context(F.col("text_content"), F.lit("thing")).alias("context"))


# phrases

PHRASES = [(1, "of the"), (2, "und die"), (3, "que"), (4, "thing"), (5, "The And"), (6, "src1 example"), (7, "real-time")]
_PHRASES_SQL = sql_values(PHRASES, "phrase_id, phrase")
_MARKS_SQL = r"""[,،;؛.·•:!?/\\|()\[\]{}<>@#$%^&*_=+~`"''«»‹›—–\-\x{200c}\x{200d}\x{00ad}\x{2000}-\x{200a}]+"""


def normal_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{_MARKS_SQL}', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')"


def _detect_sql(source: str, key: str, text: str) -> str:
    return f"""WITH {PAGES_SQL}, c_ AS (SELECT {key} AS k, {normal_sql(text)} AS c FROM {source}),
    h_ AS (SELECT k, c, phrase_id, phrase, instr(lower(c), lower(phrase)) AS a FROM c_, {_PHRASES_SQL})
    SELECT k AS {key}, phrase_id, phrase, ((length(lower(c)) - length(replace(lower(c), lower(phrase), ''))) // length(phrase))::INTEGER AS occurrences,
      CASE WHEN greatest(a - 100, 1) > 1 THEN '...' ELSE '' END || trim(substring(c, greatest(a - 100, 1), least(a + length(phrase) - 1 + 100, length(c)) - greatest(a - 100, 1) + 1)) || CASE WHEN a + length(phrase) - 1 + 100 < length(c) THEN '...' ELSE '' END AS context
    FROM h_ WHERE a > 0"""


@register("phrase_detect_content", _detect_sql("pages_", "page_id", "text_content"))
def phrase_detect_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.detect(crawled_pages(spark, sf_dir).select("page_id", "text_content"), values(spark, PHRASES, "phrase_id int, phrase string"), "text_content")
    return hits.select("page_id", "phrase_id", "phrase", "occurrences", "context")


@register("phrase_detect_url", _detect_sql("pages_", "page_id", "url"))
def phrase_detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.detect(crawled_pages(spark, sf_dir).select("page_id", "url"), values(spark, PHRASES, "phrase_id int, phrase string"), "url")
    return hits.select("page_id", "phrase_id", "phrase", "occurrences", "context")


_ANCHORS_SQL = "(SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>'), lambda a: regexp_extract(a, '>([^<]*)<', 1)), ' | ') AS anchor FROM pages) a_"


@register("phrase_detect_anchor", _detect_sql(_ANCHORS_SQL, "page_id", "anchor").replace("SELECT k AS page_id", "SELECT k AS page_id, 'Anchor: ' || context AS context, phrase_id, phrase, occurrences FROM (SELECT k") + ")")
def phrase_detect_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat_ws(" | ", links).alias("anchor"))
    hits = S.detect(rows, values(spark, PHRASES, "phrase_id int, phrase string"), "anchor")
    return hits.select("page_id", F.concat(F.lit("Anchor: "), "context").alias("context"), "phrase_id", "phrase", "occurrences")


@register("phrase_context", f"SELECT page_id, phrase, context FROM ({_detect_sql('pages_', 'page_id', 'text_content')}) WHERE phrase_id = 4")
def phrase_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_detect_content(spark, sf_dir).filter("phrase_id = 4").select("page_id", "phrase", "context")


#: The phrases of the whole index, whatever they begin with, and the ones entered by hand.
_WHOLE_SQL = f"""WITH {PAGES_SQL}, {TOKENS_SQL},
grams_ AS (SELECT url, crawl_job_id, unnest({grams_sql('toks')}) AS phrase FROM tokens_ WHERE NOT is_archived),
phrases_ AS (SELECT DISTINCT phrase, TRUE AS extracted FROM grams_ UNION SELECT phrase, FALSE FROM {_MANUAL_SQL})"""


@register("phrase_stats", f"{_WHOLE_SQL}, s_ AS (SELECT phrase, count(*) AS match_count, count(DISTINCT url) AS page_count FROM grams_ GROUP BY phrase) SELECT phrase, extracted, coalesce(match_count, 0)::BIGINT AS match_count, coalesce(page_count, 0)::BIGINT AS page_count FROM phrases_ LEFT JOIN s_ USING (phrase)")
def phrase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every phrase of the index, and of the ones entered by hand."""
    pages = crawled_pages(spark, sf_dir).filter(~F.col("is_archived"))
    return phrase_figures(pages, values(spark, MANUAL, _MANUAL_SCHEMA).select("phrase"))


@register("extracted_phrases", f"{_WHOLE_SQL} SELECT DISTINCT phrase FROM phrases_ WHERE contains(lower(phrase), 'ing') AND phrase IN (SELECT phrase FROM grams_ WHERE crawl_job_id = 'src3')")
def extracted_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases with "ing" of a job's pages; a phrase of its pages is in the table by that."""
    pages = crawled_pages(spark, sf_dir).filter("crawl_job_id = 'src3' AND NOT is_archived")
    return S.postings(pages).filter(F.lower("phrase").contains("ing")).select("phrase").distinct()


@register("recent_phrases", "SELECT item_id AS id, text AS phrase FROM benchmark ORDER BY item_id DESC LIMIT 10")
def recent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest phrases."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("phrase")).orderBy(F.desc("id")).limit(10)


@register("phrase_exists", f"SELECT q.phrase, EXISTS (SELECT 1 FROM {_MANUAL_SQL} WHERE lower(t.phrase) = lower(q.phrase)) AS found FROM (VALUES ('ATTION'), ('missing'), ('Of The')) AS q(phrase)")
def phrase_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = values(spark, [("ATTION",), ("missing",), ("Of The",)], "phrase string")
    known = values(spark, MANUAL, _MANUAL_SCHEMA).select(F.lower("phrase").alias("low")).distinct()
    return asked.join(known, F.lower("phrase") == F.col("low"), "left").select("phrase", F.col("low").isNotNull().alias("found"))


_STORED = [(1, "alpha", None, True), (2, "beta", "job1", False), (3, "gamma", "job2", True), (4, "delta", None, False)]
_STORED_SCHEMA = "id long, phrase string, crawl_job_id string, is_active boolean"


@register("manual_phrases", f"SELECT id, phrase FROM {sql_values(_STORED, 'id, phrase, crawl_job_id, is_active')} WHERE is_active AND crawl_job_id IS NULL")
def manual_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _STORED, _STORED_SCHEMA).filter("is_active AND crawl_job_id IS NULL").select("id", "phrase")


_ADDED = [("beta",), ("alpha",), ("omega",)]


@register(
    "phrase_promote",
    f"""WITH s AS (SELECT * FROM {sql_values(_STORED, 'id, phrase, crawl_job_id, is_active')}), a AS (SELECT * FROM {sql_values(_ADDED, 'phrase')})
    SELECT id, phrase, CASE WHEN phrase IN (SELECT phrase FROM a) THEN NULL ELSE crawl_job_id END AS crawl_job_id, CASE WHEN phrase IN (SELECT phrase FROM a) AND crawl_job_id IS NOT NULL THEN TRUE ELSE is_active END AS is_active FROM s
    UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY phrase), phrase, NULL, TRUE FROM a WHERE phrase NOT IN (SELECT phrase FROM s)""",
)
def phrase_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding a phrase makes one that a crawl had extracted a manual, active one; an unknown one is inserted."""
    stored, added = values(spark, _STORED, _STORED_SCHEMA), values(spark, _ADDED, "phrase string").withColumn("asked", F.lit(True))
    merged = stored.join(added, "phrase", "left").select(
        "id",
        "phrase",
        F.when(F.col("asked").isNull(), F.col("crawl_job_id")).alias("crawl_job_id"),
        F.when(F.col("asked") & F.col("crawl_job_id").isNotNull(), True).otherwise(F.col("is_active")).alias("is_active"),
    )
    top = stored.agg(F.max("id").alias("top"))
    from pyspark.sql import Window

    new = added.join(stored, "phrase", "left_anti").crossJoin(top)
    number = F.row_number().over(Window.partitionBy("top").orderBy("phrase"))
    return merged.unionByName(new.select((F.col("top") + number).alias("id"), "phrase", F.lit(None).cast("string").alias("crawl_job_id"), F.lit(True).alias("is_active")))


_LANG_ROWS = [(1, "hello world"), (2, "سلام دنیا"), (3, "سلام hello"), (4, ""), (5, "abcdefgh س")]


@register("lang_detect", f"WITH {PAGES_SQL}, u AS (SELECT page_id, text_content AS t FROM pages_ UNION ALL SELECT -id, t FROM {sql_values(_LANG_ROWS, 'id, t')}), s AS (SELECT page_id, regexp_replace(t, '\\s', '', 'g') AS s FROM u) SELECT page_id, CASE WHEN length(regexp_replace(s, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) > 0.3 * length(s) THEN 'fa' ELSE 'en' END AS lang FROM s")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled_pages(spark, sf_dir).select("page_id", F.col("text_content").alias("t"))
    more = values(spark, _LANG_ROWS, "page_id long, t string").select((-F.col("page_id")).alias("page_id"), "t")
    return pages.unionByName(more).select("page_id", T.language(F.col("t")).alias("lang"))


@register("stem_english")
def stem_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every distinct token of each language: English ones by Porter2, others as they are unless a stemmer is plugged in."""
    words = read(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("lang", "token", hooks.stemmed(F.col("token"), F.col("lang")).alias("stem"))
