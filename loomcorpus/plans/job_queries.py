"""Queries over jobs, settings, seeds, agents and hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hooks, templates
from ..functions import html as H
from ..functions import urls as U
from ..operators import jobs as J
from ..operators import pages as P
from ..tables import PAGES_SQL, crawled_pages, read, sql_values, values
from .html_queries import _LINKS_SQL, links
from .page_queries import _EDGES_SQL, _FRONTIER_SQL, _frontier
from .registry import register
from .url_queries import HOST_SQL

_STATES = ["pending", "running", "paused", "completed", "failed", "cancelled"]
_ACTIONS = ["start", "stop", "pause", "resume", "complete"]
_CASES = [(s, a, o) for s in _STATES for a in _ACTIONS for o in (True, False)]


@register(
    "job_transitions",
    f"""SELECT status, action, other_runs, CASE WHEN action = 'start' AND NOT other_runs AND status <> 'running' OR action = 'resume' AND status = 'paused' AND NOT other_runs THEN 'running'
    WHEN action = 'stop' AND status IN ('running', 'paused') THEN 'cancelled' WHEN action = 'pause' AND status = 'running' THEN 'paused' WHEN action = 'complete' AND status = 'running' THEN 'completed' END AS next
    FROM {sql_values(_CASES, 'status, action, other_runs')}""",
)
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action does to a job in each state; null where it is refused."""
    c = values(spark, _CASES, "status string, action string, other_runs boolean")
    return c.withColumn("next", J.transition(F.col("status"), F.col("action"), F.col("other_runs")))


_JOBS_SQL = "jb_ AS (SELECT o_orderkey::VARCHAR AS id, 'https://h' || o_custkey || '.example.com' AS target_url, 'h' || o_custkey || '.example.com' AS domain, (o_orderkey % 5)::INTEGER AS max_depth, CASE WHEN o_orderkey % 3 = 0 THEN '{\"max_pages\": ' || o_orderkey || '}' END AS settings, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'running' END AS status, 'https://seed' AS seed_urls, 7 AS crawled_urls FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    host = F.concat(F.lit("h"), F.col("o_custkey"), F.lit(".example.com"))
    return read(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("https://"), host).alias("target_url"),
        host.alias("domain"),
        (k % 5).cast("int").alias("max_depth"),
        F.when(k % 3 == 0, F.concat(F.lit('{"max_pages": '), k, F.lit("}"))).alias("settings"),
        F.when(s == "O", "pending").when(s == "F", "completed").otherwise("running").alias("status"),
        F.lit("https://seed").alias("seed_urls"),
        F.lit(7).alias("crawled_urls"),
    )


@register("job_duplicate", f"WITH {_JOBS_SQL} SELECT id || '-copy' AS id, target_url, domain, max_depth, settings, 'pending' AS status, NULL::VARCHAR AS seed_urls, 0 AS crawled_urls FROM jb_")
def job_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.duplicate(_jobs(spark, sf_dir), F.concat("id", F.lit("-copy")))


@register("settings_update", f"WITH {_JOBS_SQL} SELECT id, status, CASE WHEN id::BIGINT % 2 = 0 AND status = 'pending' THEN CASE WHEN id::BIGINT % 4 = 0 THEN '{{}}' END ELSE settings END AS settings, id::BIGINT % 2 = 0 AND status = 'pending' AS updated FROM jb_")
def settings_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings are changed, or reset to null, for pending jobs only."""
    jobs, n = _jobs(spark, sf_dir), F.col("id").cast("long")
    return J.update_settings(jobs.select("id", "status", "settings"), jobs.filter(n % 2 == 0).select("id", F.when(n % 4 == 0, "{}").alias("settings")))


_BODIES = [(1, '{"max_depth": 3, "skip_extensions": [".pdf"]}'), (2, '{"reset": true, "max_depth": 3}'), (3, "{}"), (4, '{"skip_extensions": [], "user_agent": null}'), (5, '{"respect_robots_txt": false}'), (6, '{"user_agent": "", "reset": false}'), (7, "no json"), (8, None)]


@register(
    "settings_codec",
    f"""WITH b AS (SELECT id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM {sql_values(_BODIES, 'id, body')}),
    k AS (SELECT id, j, coalesce((j->>'$.reset')::BOOLEAN, FALSE) AS reset, (SELECT count(*) FROM unnest(json_keys(j)) AS u(name) WHERE name <> 'reset' AND json_type(j, '$.' || name) NOT IN ('NULL', 'ARRAY') OR json_type(j, '$.' || name) = 'ARRAY' AND json_array_length(j, '$.' || name) > 0) AS given FROM b)
    SELECT id, NOT reset AND coalesce(given, 0) > 0 AND j IS NOT NULL AS kept, CASE WHEN NOT reset AND given > 0 THEN (j->>'$.max_depth')::INTEGER END AS max_depth, CASE WHEN NOT reset AND given > 0 THEN (j->>'$.respect_robots_txt')::BOOLEAN END AS respect_robots_txt, CASE WHEN NOT reset AND given > 0 THEN j->>'$.user_agent' END AS user_agent FROM k""",
)
def settings_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read from JSON: a reset, or a body without any, gives none."""
    s = values(spark, _BODIES, "id int, body string").select("id", J.settings_of(F.col("body")).alias("s"))
    return s.select("id", F.col("s").isNotNull().alias("kept"), "s.max_depth", "s.respect_robots_txt", "s.user_agent")


_LINKED = [("a", None), ("b", "d1"), ("c", "d2"), ("d", ""), ("d1", None), ("e", "missing")]
_FOUND = [("d1", "x.example.com"), ("d1", "y.example.com"), ("c", "own.example.com"), ("d2", "z.example.com")]


@register(
    "subdomains_of_job",
    f"""WITH j AS (SELECT * FROM {sql_values(_LINKED, 'id, discovery_job_id')}), s AS (SELECT * FROM {sql_values(_FOUND, 'discovery_job_id, subdomain')})
    SELECT j.id AS job_id, subdomain FROM j JOIN s ON s.discovery_job_id = j.id UNION ALL SELECT j.id, subdomain FROM j JOIN s USING (discovery_job_id) WHERE j.id NOT IN (SELECT discovery_job_id FROM s)""",
)
def subdomains_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.subdomains_of(values(spark, _LINKED, "id string, discovery_job_id string"), values(spark, _FOUND, "discovery_job_id string, subdomain string"))


_AGENTS = [("Mozilla/5.0 (X11)",), ("curl/8.0",), ("OPERA/9",), ("my edg/1 bot",), ("",), ("chrome",)]


@register("browser_agent", f"SELECT agent, regexp_matches(lower(agent), 'mozilla/|chrome/|firefox/|safari/|edg/|opera/') AS is_browser FROM {sql_values(_AGENTS, 'agent')}")
def browser_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _AGENTS, "agent string").select("agent", F.lower("agent").rlike("(?:mozilla|chrome|firefox|safari|edg|opera)/").alias("is_browser"))


_SITE_FILES = ["https://{}", "https://{}/robots.txt", "https://{}/sitemap.xml", "https://{}/sitemap_index.xml", "https://www.{}", "https://www.{}/robots.txt", "https://www.{}/sitemap.xml"]
_SITES = [("https://www.Example.com:8080/x",), ("example.org",)]


@register("default_seeds", f"WITH d AS (SELECT lower(trim(string_split(string_split(regexp_replace(regexp_replace(regexp_replace(site, '^http://', ''), '^https://', ''), '^www\\.', ''), '/')[1], ':')[1])) AS domain FROM {sql_values(_SITES, 'site')}) " + " UNION ALL ".join(f"SELECT domain, {k}::INTEGER AS n, replace('{p}', '{{}}', domain) AS url FROM d" for k, p in enumerate(_SITE_FILES)))
def default_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = values(spark, _SITES, "site string").select(U.clean_domain(F.col("site")).alias("domain"))
    urls = F.array(*(F.replace(F.lit(p), F.lit("{}"), F.col("domain")) for p in _SITE_FILES))
    return d.select("domain", F.posexplode(urls).alias("n", "url"))


@register("links_same_host", f"WITH {_LINKS_SQL} SELECT DISTINCT page_id, link FROM r_ WHERE ({HOST_SQL.format(u='link')}) = ({HOST_SQL.format(u='base')})")
def links_same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).filter(U.host(F.col("link")) == U.host(F.col("base"))).select("page_id", "link").distinct()


@register("bfs_max_pages", f"""WITH RECURSIVE {_EDGES_SQL}, b AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e_ e ON e.src = b.url WHERE b.depth < 3)
SELECT url, min(depth)::INTEGER AS depth FROM b GROUP BY url ORDER BY 2, 1 LIMIT 12""")
def bfs_max_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth that stops at so many pages; the limit is the feature."""
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") % 2000).alias("dst")).distinct()
    return P.breadth_first(edges, spark.range(1, 2).withColumnRenamed("id", "url"), 3, max_pages=12)


_GRAPH_SQL = "g AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS link FROM lineitem)"


@register("random_surfer", f"""WITH {_GRAPH_SQL}, b AS (SELECT page, arg_min(link, sha256('5:' || page || ':' || link)) AS link FROM g GROUP BY page), t AS (SELECT *, ('0x' || substr(sha256('5t:' || page), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15 AS teleports FROM b)
SELECT page, CASE WHEN NOT teleports THEN link END AS next, teleports FROM t""")
def random_surfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("link")).distinct()
    return J.surf(g, 0.15, 5)


@register("seen_set", "SELECT l_partkey AS url, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY 1")
def seen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that weren't seen before, each at its first place."""
    urls = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return J.unseen(urls, read(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("url")), "place")


@register("live_counters", f"WITH {_FRONTIER_SQL} SELECT count(*) FILTER (status IN ('completed', 'failed')) AS crawled, sum(CASE WHEN status = 'completed' THEN retries ELSE 0 END)::BIGINT AS matches, count(*) FILTER (status = 'pending') AS pending, count(*) AS total FROM fr_")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor shows of a running crawl; retries stand for matches."""
    s = F.col("status")
    return _frontier(spark, sf_dir).agg(F.count_if(s.isin("completed", "failed")).alias("crawled"), F.sum(F.when(s == "completed", F.col("retries")).otherwise(0)).alias("matches"), F.count_if(s == "pending").alias("pending"), F.count("*").alias("total"))


_LETTERS_SQL = ", ".join(f"length(text_content) - length(replace(text_content, '{c}', ''))" for c in "abcdefgh")


@register("embed_texts", f"WITH {PAGES_SQL}, v AS (SELECT page_id, list_transform([{_LETTERS_SQL}], lambda x: x::DOUBLE) AS v FROM pages_), n AS (SELECT page_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM v) SELECT page_id, round(v[1] / greatest(s, 1e-300), 2) AS first, round(v[8] / greatest(s, 1e-300), 2) AS last, s > 0 AS any_letter FROM n")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded by a model that is plugged in: here one that counts letters."""
    rows = crawled_pages(spark, sf_dir).select("page_id", hooks.embed(F.col("text_content"), hooks.letter_profile).alias("v"))
    d = lambda k: F.round(F.col("v")[k].cast("double"), 2)
    return rows.select("page_id", d(0).alias("first"), d(7).alias("last"), F.exists("v", lambda x: x > 0).alias("any_letter"))


#: Words with their stems by the published algorithm's rules, worked out by hand.
_STEMS = [("running", "run"), ("runs", "run"), ("cities", "citi"), ("ties", "tie"), ("caresses", "caress"), ("gas", "gas"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("plastered", "plaster"), ("happily", "happili"), ("nationally", "nation"), ("rational", "ration"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controlling", "control"), ("generate", "generat"), ("skies", "sky"), ("dying", "die"), ("by", "by"), ("sensational", "sensat"), ("relational", "relat")]


@register("stem_pairs", f"SELECT word, stem FROM {sql_values(_STEMS, 'word, stem')}")
def stem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = values(spark, [(w,) for w, _ in _STEMS], "word string")
    return words.select("word", hooks.stemmed(F.col("word"), F.lit("en")).alias("stem"))


_PERSIAN = [("رفتم", "رفت#رو"), ("کتاب‌ها", "کتاب"), ("آب", "آب")]
_PERSIAN_WORDS = [("رفتم", "fa"), ("کتاب‌ها", "fa"), ("آب", "fa"), ("ناشناس", "fa"), ("running", "en"), ("laufen", "de")]


@register("stem_languages", f"WITH l AS (SELECT * FROM {sql_values(_PERSIAN, 'word, lemma')}) SELECT w.word, lang, CASE WHEN lang = 'fa' THEN coalesce(string_split(lemma, '#')[1], w.word) WHEN w.word = 'running' THEN 'run' ELSE w.word END AS stem FROM {sql_values(_PERSIAN_WORDS, 'word, lang').replace('AS t(', 'AS w(')} LEFT JOIN l ON l.word = w.word")
def stem_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lemmatiser for Persian is plugged in; without one, words of the language stay as they are."""
    lemmas = dict(_PERSIAN)
    hooks.register_stemmer("fa", lambda words: [hooks.lemma_base(lemmas.get(w, w)) for w in words])
    rows = values(spark, _PERSIAN_WORDS, "word string, lang string")
    return rows.withColumn("stem", hooks.stemmed(F.col("word"), F.col("lang")))


_SHELLS = [
    (1, "j", "<div ng-app=x>{{a}}</div>"),
    (2, "j", "<div ng-app=x>{{a}}</div>"),
    (3, "j", "<div ng-app=x class=ng-scope>done</div>"),
    (4, "j", "<div ng-app=x class=ng-scope>done</div>"),
    (5, "k", "<div ng-app=x class=ng-scope>done</div>"),
    (6, "j", "plain"),
    (7, "j", "plain"),
]


@register("content_dedup_shells", f"""WITH s AS (SELECT *, contains(html, 'ng-app=') AND NOT contains(html, 'ng-scope') AS is_shell FROM {sql_values(_SHELLS, 'page_id, crawl_job_id, html')})
SELECT min(page_id) AS page_id, crawl_job_id, FALSE AS is_shell FROM s WHERE NOT is_shell GROUP BY crawl_job_id, html UNION ALL SELECT page_id, crawl_job_id, TRUE FROM s WHERE is_shell""")
def content_dedup_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shells of applications that never ran look alike and are no duplicates of each other."""
    pages = values(spark, _SHELLS, "page_id int, crawl_job_id string, html string").withColumns({"doc_hash": F.sha2("html", 256), "is_shell": H.unrendered(F.col("html"))})
    return P.content_dedup(pages).select("page_id", "crawl_job_id", "is_shell")


#: Addresses with escapes, user info, ports and IPv6, and how they are normalised.
_ANY = [
    ("HTTP://User:pw@Example.COM:80/a%20b//c/?b=2&a=1&utm_source=x#top", "http://User:pw@example.com/a%20b/c?a=1&b=2"),
    ("https://[2001:DB8::1]:8443/x/", "https://[2001:db8::1]:8443/x"),
    ("//example.org/%7Euser", "https://example.org/~user"),
    ("https://example.org/#/route", "https://example.org/#/route"),
    ("ftp://example.org/", None),
    ("https://", None),
    ("https://example.org:99999/", None),
    ("", None),
]
_JOINED = [("../c?q=1", "https://example.org/a/b/d", "https://example.org/a/c?q=1"), ("mailto:a@b.c", "https://example.org/", None), ("?x=%41", "https://example.org/p/", "https://example.org/p?x=A"), ("//h.example.net", "https://example.org/", "https://h.example.net/"), ("", "https://example.org/", None)]


@register("url_normalize_any", f"SELECT * FROM {sql_values(_ANY, 'url, normal')}")
def url_normalize_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(u,) for u, _ in _ANY], "url string").select("url", U.normalise_any("url").alias("normal"))


@register("url_resolve_any", f"SELECT * FROM {sql_values(_JOINED, 'href, base, normal')}")
def url_resolve_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [r[:2] for r in _JOINED], "href string, base string").select("href", "base", U.resolve_any("href", "base").alias("normal"))


_CELLS = [(1, 7.0, 2.0, "short"), (2, 1.0, 0.0, "a longer text"), (3, 0.0, 3.0, ""), (4, 9.0, 4.0, "exactly8"), (5, 1.0, 3.0, "\u00e9\u00e9\u00e9\u00e9x")]


@register("template_helpers", f"SELECT id, CASE WHEN b = 0 THEN 0.0 ELSE round(a / b, 6) END AS ratio, (a + b)::INTEGER AS total, (a - b)::INTEGER AS difference, (SELECT max(substring(t, 1, r.n)) FROM (SELECT unnest(range(0, 9)) AS n) r WHERE strlen(substring(t, 1, r.n)) <= 8) AS cut FROM {sql_values(_CELLS, 'id, a, b, t')}")
def template_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = values(spark, _CELLS, "id int, a double, b double, t string")
    return rows.select("id", F.round(templates.ratio(a, b), 6).alias("ratio"), (a + b).cast("int").alias("total"), (a - b).cast("int").alias("difference"), templates.cut(F.col("t"), 8).alias("cut"))


def _upper_titles():  # noqa: ANN202
    import json

    return lambda entries: [json.dumps({"title": t.upper()}) if (t := json.loads(e).get("title")) else None for e in entries]


_PAGES = [(1, '{"title": "one"}'), (2, '{"title": ""}'), (3, "{}"), (4, None)]


@register("after_page_hook", f"SELECT id, CASE WHEN coalesce(entry::JSON->>'$.title', '') <> '' THEN '{{\"title\": \"' || upper(entry::JSON->>'$.title') || '\"}}' END AS result FROM {sql_values(_PAGES, 'id, entry')}")
def after_page_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook that is given each crawled page's entry."""
    return values(spark, _PAGES, "id int, entry string").select("id", hooks.after_page(F.col("entry"), _upper_titles).alias("result"))
