"""Queries over the page store, the frontier, vectors and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators import pages as P
from ..operators import vectors as V
from ..shared import materialise
from ..tables import JOBS_SQL, PAGES_SQL, crawl_jobs, crawled_pages, read, sql_values, values
from .html_queries import _LINKS_SQL, TEXT_SQL, links
from .registry import register
from .url_queries import BASE_SQL, HOST_SQL, normal_sql

_HOST = HOST_SQL.format(u="url")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled_pages(spark, sf_dir).withColumns({"doc_hash": F.sha2("text_content", 256), "is_shell": H.unrendered(F.col("text_content"))})


@register("content_dedup", f"WITH {PAGES_SQL} SELECT min(page_id) AS page_id, crawl_job_id, sha256(text_content) AS doc_hash FROM pages_ GROUP BY ALL")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.content_dedup(_stored(spark, sf_dir)).select("page_id", "crawl_job_id", "doc_hash")


@register("page_url_dedup", f"WITH n_ AS (SELECT page_id, {_HOST} AS h, normal FROM {normal_sql('pages')}) SELECT min(page_id) AS page_id, {BASE_SQL.format(h='h')} AS crawl_job_id, sha256(normal) AS url_hash FROM n_ GROUP BY ALL")
def page_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", U.base_domain(U.host(F.col("url"))).alias("crawl_job_id"), F.sha2(U.normalise(F.col("url")), 256).alias("url_hash"))
    return P.first_of(p, ["crawl_job_id", "url_hash"], ["page_id"]).select("page_id", "crawl_job_id", "url_hash")


_FETCHES = [
    (1, 10, "j", "h1", 503, 100, "HTTP 503", "", None), (2, 11, "j", "h1", 200, 90, "", "T", "body"), (3, 12, "j", "h1", 200, 80, "", "U", "small"), (4, 13, "j", "h1", 200, 200, "", "", None),
    (1, 20, "j", "h2", 200, 50, "", "A", "a"), (2, 21, "j", "h2", 500, 60, "HTTP 500", "B", "b"), (3, 22, "j", "h2", 200, 10, "", "C", "c"), (1, 30, "k", "h1", 200, 5, "", "x", "y"),
]
_FETCH_NAMES = "seq, page_id, crawl_job_id, url_hash, status_code, content_length, error, title, text"
_FETCH_SCHEMA = "seq int, page_id long, crawl_job_id string, url_hash string, status_code int, content_length int, error string, title string, text string"


@register(
    "page_merge",
    f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY crawl_job_id, url_hash ORDER BY seq) AS n FROM {sql_values(_FETCHES, _FETCH_NAMES)}),
    r AS (SELECT crawl_job_id, url_hash, page_id, status_code, content_length, error, title, text, n FROM f WHERE n = 1 UNION ALL
      SELECT r.crawl_job_id, r.url_hash, r.page_id, CASE WHEN b THEN x.status_code ELSE r.status_code END, CASE WHEN b THEN x.content_length ELSE r.content_length END, CASE WHEN b THEN x.error ELSE r.error END,
        CASE WHEN b AND coalesce(x.title, '') <> '' THEN x.title ELSE r.title END, CASE WHEN b AND coalesce(x.text, '') <> '' THEN x.text ELSE r.text END, x.n
      FROM r JOIN f x ON x.crawl_job_id = r.crawl_job_id AND x.url_hash = r.url_hash AND x.n = r.n + 1, LATERAL (SELECT x.content_length > r.content_length OR x.error = '' AND r.error <> '' AS b) z)
    SELECT crawl_job_id, url_hash, page_id, status_code, content_length, error, title, text FROM r QUALIFY row_number() OVER (PARTITION BY crawl_job_id, url_hash ORDER BY n DESC) = 1""",
)
def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_fetches(values(spark, _FETCHES, _FETCH_SCHEMA))


_STATUS_SQL = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END"
_FRONTIER_SQL = f"fr_ AS (SELECT event_id AS id, user_id AS crawl_job_id, {_STATUS_SQL} AS status, (event_id % 4)::INTEGER AS retries, value AS response_time FROM events)"


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "error", "failed").otherwise("completed")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("crawl_job_id"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("retries"), F.col("value").alias("response_time"))


@register("frontier_dedup", f"""WITH {_LINKS_SQL}, c_ AS (SELECT DISTINCT {BASE_SQL.format(h=f"({HOST_SQL.format(u='base')})")} AS crawl_job_id, sha256(link) AS url_hash FROM r_),
done_ AS (SELECT {BASE_SQL.format(h=f"({HOST_SQL.format(u='url')})")} AS crawl_job_id, sha256(normal) AS url_hash, page_id FROM {normal_sql('pages')})
SELECT * FROM c_ WHERE (crawl_job_id, url_hash) NOT IN (SELECT (crawl_job_id, url_hash) FROM done_ WHERE url_hash IS NOT NULL) AND substr(url_hash, 1, 1) <> '0'""")
def frontier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are neither fetched nor waiting; those whose hash begins with 0 stand for the waiting ones."""
    found = links(spark, sf_dir).select(U.base_domain(U.host(F.col("base"))).alias("crawl_job_id"), F.sha2("link", 256).alias("url_hash"))
    found = materialise(found.distinct(), "links")  # used twice: links are extracted once
    done = read(spark, sf_dir, "pages").select(U.base_domain(U.host(F.col("url"))).alias("crawl_job_id"), F.sha2(U.normalise(F.col("url")), 256).alias("url_hash"))
    return P.new_urls(found, done, found.filter("url_hash LIKE '0%'"))


@register("frontier_claim", f"WITH {_FRONTIER_SQL} SELECT id, crawl_job_id, 'processing' AS status, retries FROM fr_ WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY crawl_job_id ORDER BY sha256('0:' || id), id) <= 2")
def frontier_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.claim(_frontier(spark, sf_dir), 2).select("id", "crawl_job_id", "status", "retries")


@register("frontier_retry", f"WITH {_FRONTIER_SQL} SELECT id, retries + 1 AS retries, CASE WHEN retries < 3 THEN 'pending' ELSE 'failed' END AS status FROM fr_ WHERE status = 'processing'")
def frontier_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.failed(_frontier(spark, sf_dir).filter("status = 'processing'")).select("id", "retries", "status")


@register("frontier_reset", f"WITH {_FRONTIER_SQL} SELECT id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM fr_")
def frontier_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir).select("id", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")).alias("status"))


@register("frontier_stats", f"WITH {_FRONTIER_SQL} SELECT crawl_job_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM fr_ GROUP BY 1")
def frontier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "failed", "completed")]
    return _frontier(spark, sf_dir).groupBy("crawl_job_id").agg(*each, F.count("*").alias("total"))


_EDGES_SQL = "e_ AS (SELECT DISTINCT l_orderkey AS src, l_partkey % 2000 AS dst FROM lineitem)"


@register("bfs_depth", f"""WITH RECURSIVE {_EDGES_SQL}, b AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e_ e ON e.src = b.url WHERE b.depth < 3) SELECT url, min(depth)::INTEGER AS depth FROM b GROUP BY url""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first growth to depth 3 over a graph of keys."""
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") % 2000).alias("dst")).distinct()
    return P.breadth_first(edges, spark.range(1, 2).withColumnRenamed("id", "url"), 3)


_OUTCOMES = [(1, 200, 5000, ""), (2, 503, 10, ""), (3, 200, 2000, "timeout"), (4, 200, 1024, "timeout"), (5, 0, 0, "refused"), (6, 429, 9, ""), (7, 404, 9, "")]


@register("fetch_outcome", f"SELECT id, CASE WHEN err <> '' AND NOT (status = 200 AND size > 1024) THEN 'error' WHEN status IN (429, 502, 503) THEN 'retry' WHEN status BETWEEN 200 AND 299 THEN 'index' ELSE 'links_only' END AS outcome, CASE WHEN status IN (429, 502, 503) THEN 'HTTP ' || status ELSE err END AS error FROM {sql_values(_OUTCOMES, 'id, status, size, err')}")
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a fetch: an error, a retry, indexing, or links only."""
    s = F.col("status")
    hard = (F.col("err") != "") & ~((s == 200) & (F.col("size") > 1024))
    retry = s.isin(429, 502, 503)
    rows = values(spark, _OUTCOMES, "id int, status int, size int, err string")
    return rows.select("id", F.when(hard, "error").when(retry, "retry").when(s.between(200, 299), "index").otherwise("links_only").alias("outcome"), F.when(retry, F.concat(F.lit("HTTP "), s)).otherwise(F.col("err")).alias("error"))


# vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("label").alias("crawl_job_id"), "embedding")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


_DOT_SQL = "v_ AS (SELECT e.vec_id AS page_id, e.label AS crawl_job_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@register("semantic_topk", f"WITH {_DOT_SQL} SELECT page_id, round(s, 6) AS score FROM v_ ORDER BY s DESC, page_id LIMIT 20")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 20).select("page_id", F.round("score", 6).alias("score"))


@register("semantic_topk_job", f"WITH {_DOT_SQL} SELECT page_id, round(s, 6) AS score FROM v_ WHERE crawl_job_id = 3 ORDER BY s DESC, page_id LIMIT 20")
def semantic_topk_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_vectors(spark, sf_dir).filter("crawl_job_id = 3"), _query(spark, sf_dir), 20).select("page_id", F.round("score", 6).alias("score"))


@register("semantic_enriched", f"WITH {_DOT_SQL}, {PAGES_SQL}, {JOBS_SQL}, t_ AS (SELECT page_id, s FROM v_ ORDER BY s DESC, page_id LIMIT 20) SELECT t.page_id, round(s, 3) AS score, round(s, 3) * 100 AS score_percent, p.url, coalesce(j.domain, '') AS domain FROM t_ t JOIN pages_ p USING (page_id) LEFT JOIN jobs_ j ON j.id = p.crawl_job_id")
def semantic_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 20).drop("crawl_job_id")
    pages = crawled_pages(spark, sf_dir).select("page_id", "url", "crawl_job_id")
    rows = pages.join(F.broadcast(top), "page_id").join(crawl_jobs(spark, sf_dir).withColumnRenamed("id", "crawl_job_id"), "crawl_job_id", "left")  # twenty rows
    return rows.select("page_id", F.round("score", 3).alias("score"), (F.round("score", 3) * 100).alias("score_percent"), "url", F.coalesce("domain", F.lit("")).alias("domain")).orderBy(F.desc("score"), "page_id")


@register("semantic_stats", "SELECT label AS crawl_job_id, count(*) AS embeddings FROM embeddings GROUP BY label UNION ALL SELECT NULL, count(*) FROM embeddings")
def semantic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of each job, and of all (a null job)."""
    return _vectors(spark, sf_dir).rollup("crawl_job_id").agg(F.count("*").alias("embeddings"))


@register("embedding_dim_filter", "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:32] WHEN vec_id % 11 = 0 THEN [] ELSE embedding END AS v FROM embeddings) SELECT vec_id AS page_id, len(v)::INTEGER AS dim FROM e WHERE len(v) = (SELECT len(v) FROM e WHERE len(v) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)")
def embedding_dim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("page_id") % 7 == 0, F.slice("embedding", 1, 32)).when(F.col("page_id") % 11 == 0, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))
    return V.modal_dimension(_vectors(spark, sf_dir).withColumn("embedding", cut)).select("page_id", "dim")


@register("embedding_upsert", "SELECT page_id, arg_max(vec_id, vec_id) AS vec_id, arg_max(label, vec_id) AS label FROM (SELECT vec_id % 100 AS page_id, * FROM embeddings) GROUP BY page_id")
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last embedding written for each page."""
    rows = read(spark, sf_dir, "embeddings").withColumn("page_id", F.col("vec_id") % 100)
    return rows.groupBy("page_id").agg(F.max("vec_id").alias("vec_id"), F.max_by("label", "vec_id").alias("label"))


@register("embed_text", f"""WITH {PAGES_SQL}, h_ AS (SELECT page_id, trim(text_content) AS t FROM pages_), x_ AS (SELECT page_id, 'passage: Page ' || page_id || '. ' || array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')[1:1000], ' ') AS input FROM h_) SELECT page_id, sha256(input) AS text_hash, length(input)::INTEGER AS n FROM x_ WHERE page_id % 5 <> 0""")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of pages that aren't embedded yet; every fifth is."""
    rows = crawled_pages(spark, sf_dir).select("page_id", V.embed_input(F.format_string("Page %d", "page_id"), F.col("text_content"), "intfloat/multilingual-e5-large").alias("input"))
    rows = rows.select("page_id", F.sha2("input", 256).alias("text_hash"), F.length("input").alias("n"))
    return rows.join(rows.filter("page_id % 5 = 0").select("page_id", "text_hash"), ["page_id", "text_hash"], "left_anti")


@register("vector_codec", "SELECT vec_id AS page_id, 4 * len(embedding)::INTEGER AS bytes, TRUE AS same, TRUE AS odd_is_null FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector through the binary codec and back."""
    blob = V.encode(_vectors(spark, sf_dir).select("page_id", "embedding"), "embedding", "blob")
    cut = V.decode(V.decode(blob.withColumn("odd", F.substring("blob", 1, 3)), "blob", "back"), "odd", "none")
    return cut.select("page_id", F.length("blob").alias("bytes"), (F.col("back") == F.col("embedding").cast("array<float>")).alias("same"), F.col("none").isNull().alias("odd_is_null"))


# jobs

_ORDERS_SQL = "jb_ AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'paused' END AS status, o_orderdate AS created_at FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "O", "running").when(s == "F", "completed").otherwise("paused").alias("status"), F.col("o_orderdate").alias("created_at"))


def page_of(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page of rows in an order; beyond the end it is empty."""
    return rows.orderBy(*order).offset(offset).limit(limit)


@register("jobs_page", f"WITH {_ORDERS_SQL} SELECT id, status, (SELECT count(*) FROM jb_) AS total FROM jb_ ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return page_of(jobs, [F.desc("created_at"), "id"], 20, 40).crossJoin(F.broadcast(jobs.agg(F.count("*").alias("total")))).select("id", "status", "total")


@register("job_lookup", f"WITH {_ORDERS_SQL} SELECT id, status FROM jb_ WHERE id = 7")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).filter("id = 7").select("id", "status")


@register("matches_page", f"WITH {PAGES_SQL} SELECT page_id, url FROM pages_ ORDER BY crawled_at DESC, page_id LIMIT 50 OFFSET 10")
def matches_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_of(crawled_pages(spark, sf_dir), [F.desc("crawled_at"), "page_id"], 50, 10).select("page_id", "url")


@register("crawled_pages_by_job", f"WITH {PAGES_SQL} SELECT page_id, url, content_length FROM pages_ WHERE crawl_job_id = 'src5' AND NOT is_archived ORDER BY crawled_at DESC LIMIT 20")
def crawled_pages_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawled_pages(spark, sf_dir).filter("crawl_job_id = 'src5' AND NOT is_archived")
    return page_of(rows, [F.desc("crawled_at"), "page_id"], 20, 0).select("page_id", "url", "content_length")


@register("job_stats", f"WITH {_FRONTIER_SQL} SELECT crawl_job_id, count(*) AS urls, count(*) FILTER (status = 'completed') AS pages, count(*) FILTER (status = 'failed') AS errors, round(coalesce(avg(response_time) FILTER (response_time > 0), 0), 4) AS avg_response_time FROM fr_ GROUP BY 1")
def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    avg = F.avg(F.when(F.col("response_time") > 0, F.col("response_time")))
    return _frontier(spark, sf_dir).groupBy("crawl_job_id").agg(F.count("*").alias("urls"), F.count_if(F.col("status") == "completed").alias("pages"), F.count_if(F.col("status") == "failed").alias("errors"), F.round(F.coalesce(avg, F.lit(0.0)), 4).alias("avg_response_time"))


@register("stale_jobs", f"WITH {_ORDERS_SQL} SELECT id, 'cancelled' AS status, 'interrupted by a restart' AS message FROM jb_ WHERE status IN ('running', 'paused')")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a restart left running or paused, as cancelled."""
    return _jobs(spark, sf_dir).filter(F.col("status").isin("running", "paused")).select("id", F.lit("cancelled").alias("status"), F.lit("interrupted by a restart").alias("message"))


@register("cascade_delete", f"WITH {PAGES_SQL} SELECT 'pages' AS kind, crawl_job_id::VARCHAR AS job, count(*) AS left_ FROM pages_ WHERE crawl_job_id <> 'src2' GROUP BY ALL UNION ALL SELECT 'embeddings', label::VARCHAR, count(*) FROM embeddings WHERE vec_id NOT IN (SELECT page_id FROM pages_ WHERE crawl_job_id = 'src2') GROUP BY ALL")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of pages and embeddings after a job is deleted."""
    pages = crawled_pages(spark, sf_dir)
    gone = pages.filter("crawl_job_id = 'src2'").select("page_id")
    kept = pages.join(gone, "page_id", "left_anti").select(F.lit("pages").alias("kind"), F.col("crawl_job_id").alias("job"))
    vectors = _vectors(spark, sf_dir).join(gone, "page_id", "left_anti").select(F.lit("embeddings").alias("kind"), F.col("crawl_job_id").cast("string").alias("job"))
    return kept.unionByName(vectors).groupBy("kind", "job").agg(F.count("*").alias("left_"))


_SETTINGS = [(1, None, 7, None), (2, 3, None, "x"), (3, None, None, "")]


@register("settings_merge", f"SELECT id, coalesce(max_depth, 5) AS max_depth, coalesce(workers, 10) AS workers, CASE WHEN coalesce(ext, '') = '' THEN '.pdf' ELSE ext END AS ext FROM {sql_values(_SETTINGS, 'id, max_depth, workers, ext')}")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's own settings over the defaults; empty lists don't replace."""
    s = values(spark, _SETTINGS, "id int, max_depth int, workers int, ext string")
    return s.select("id", F.coalesce("max_depth", F.lit(5)).alias("max_depth"), F.coalesce("workers", F.lit(10)).alias("workers"), F.when(F.coalesce("ext", F.lit("")) == "", ".pdf").otherwise(F.col("ext")).alias("ext"))


_PLACES = [(1, 10), (10, 10), (2, 3), (5, 9), (1, 1)]


@register("page_window", f"SELECT cur, total, unnest(range(greatest(1, least(cur - 2, total - 4)), least(total, greatest(1, least(cur - 2, total - 4)) + 4) + 1)) AS page FROM {sql_values(_PLACES, 'cur, total')}")
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five page links around the current page."""
    first = F.greatest(F.lit(1), F.least(F.col("cur") - 2, F.col("total") - 4))
    return values(spark, _PLACES, "cur long, total long").select("cur", "total", F.explode(F.sequence(first, F.least(F.col("total"), first + 4))).alias("page"))


_ENTRIES = [("t1",), ("t2",), ("t3",), ("t4",), (None,)]
_ANSWERS = [("t1", None, None), ("t2", "09", "s"), ("t3", "09", None), ("t9", None, None)]


@register("job_reconcile", f"SELECT e.token, EXISTS (SELECT 1 FROM {sql_values(_ANSWERS, 'token, phone, code').replace('AS t(', 'AS a(')} WHERE a.token = e.token AND (a.phone IS NULL OR a.code IS NOT NULL)) AS processed FROM {sql_values(_ENTRIES, 'token').replace('AS t(', 'AS e(')}")
def job_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which collected entries an answer settles: those without a phone, or with phone and code."""
    done = values(spark, _ANSWERS, "token string, phone string, code string").filter("phone IS NULL OR code IS NOT NULL").select("token").distinct().withColumn("hit", F.lit(True))
    return values(spark, _ENTRIES, "token string").join(done, "token", "left").select("token", F.coalesce("hit", F.lit(False)).alias("processed"))


@register("corpus_text", f"SELECT page_id, length({TEXT_SQL})::INTEGER AS n_chars, sha256({TEXT_SQL}) AS doc_hash FROM pages")
def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned into texts, as the page store keeps them."""
    t = read(spark, sf_dir, "pages").select("page_id", H.text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("doc_hash"))
