"""Queries over URLs, templates and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates as P
from ..functions import urls as U
from ..functions.lexicon import HOST_PREFIXES, SKIPPED_EXTENSIONS, TRACKING_PARAMETERS
from ..tables import read, sql_values, values
from .registry import register

_IN_TRACKING = "(" + ", ".join(f"'{t}'" for t in sorted(TRACKING_PARAMETERS)) + ")"
#: URLs that show each rule.
URLS = [
    (-1, "HTTP://Example.COM:80//a//b/?utm_source=x&b=2&a=1#top"),
    (-2, "https://m.x.example.com/es/12?page=2&ref=x"),
    (-3, "//Example.com"),
    (-4, "example.com/x"),
    (-5, "ftp://h/x"),
    (-6, ""),
    (-7, "https://example.com/#/search?q=foo"),
    (-8, "https://example.com/a#top"),
    (-9, "https://a.b.example.co.uk:443/x/?z=1&y=2&y=1&bare"),
    (-10, "http://192.168.1.1/a.PDF"),
    (-11, "https://www.example.com/a.b/c?gclid=9"),
    (-12, "https://example.com/img/pic.Jpeg?x=1"),
]
_URLS_SQL = sql_values(URLS, "page_id, url")
_ALL = f"u_ AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM {_URLS_SQL})"

HOST_SQL = "lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
PATH_SQL = "coalesce(nullif(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
BASE_SQL = "CASE WHEN len(string_split({h}, '.')) <= 2 THEN {h} WHEN string_split({h}, '.')[-2] IN ('co', 'com', 'net', 'org', 'edu', 'gov', 'ac') THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"
STRIP_SQL = f"array_to_string(list_transform(list_sort(list_transform(list_filter(list_zip(string_split({{q}}, '&'), range(len(string_split({{q}}, '&')))), lambda z: z[1] <> '' AND string_split(z[1], '=')[1] NOT IN {_IN_TRACKING}), lambda z: {{{{'k': string_split(z[1], '=')[1], 'i': z[2], 'p': CASE WHEN contains(z[1], '=') THEN z[1] ELSE z[1] || '=' END}}}})), lambda s: s.p), '&')"
QUERY_SQL = "regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
FRAGMENT_SQL = "regexp_extract({u}, '^[^#]*#(.*)$', 1)"
_ROUTE = "(starts_with({f}, '/') OR contains({f}, '?') OR contains({f}, '&'))"


def normal_sql(source: str, key: str = "page_id", url: str = "url") -> str:
    """SQL for (key, url, normal) of a table."""
    return f"""
  (SELECT {key}, url, CASE WHEN scheme IN ('http', 'https') AND auth <> '' THEN scheme || '://' || auth || CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END
      || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN {_ROUTE.format(f='f')} THEN '#' || f ELSE '' END END AS normal
   FROM (SELECT {key}, url, scheme, CASE scheme WHEN 'http' THEN regexp_replace(auth0, ':80$', '') ELSE regexp_replace(auth0, ':443$', '') END AS auth,
                regexp_replace({PATH_SQL.format(u='t')}, '/+', '/', 'g') AS p, {STRIP_SQL.format(q='q0')} AS q, {FRAGMENT_SQL.format(u='t')} AS f
         FROM (SELECT {key}, url, t, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS auth0, {QUERY_SQL.format(u='t')} AS q0
               FROM (SELECT {key}, {url} AS url, CASE WHEN starts_with(trim({url}), '//') THEN 'https:' || trim({url}) ELSE trim({url}) END AS t FROM {source}))))"""


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url").unionByName(values(spark, URLS, "page_id long, url string"))


@register("url_normalize", f"WITH {_ALL} SELECT page_id, normal AS url FROM {normal_sql('u_')}")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", U.normalise(F.col("url")).alias("url"))


@register("url_strip_tracking", f"WITH {_ALL} SELECT page_id, {STRIP_SQL.format(q='q')} AS query FROM (SELECT page_id, {QUERY_SQL.format(u='url')} AS q FROM u_)")
def url_strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", U.strip_tracking(U.query(F.col("url"))).alias("query"))


@register("url_hash", f"WITH {_ALL} SELECT page_id, sha256(normal) AS url_hash FROM {normal_sql('u_')}")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", F.sha2(U.normalise(F.col("url")), 256).alias("url_hash"))


@register("url_domain", f"WITH {_ALL} SELECT page_id, {HOST_SQL.format(u='url')} AS host FROM u_")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))


@register("url_base_domain", f"WITH {_ALL}, h_ AS (SELECT page_id, {HOST_SQL.format(u='url')} AS h FROM u_) SELECT page_id, {BASE_SQL.format(h='h')} AS base_domain FROM h_")
def url_base_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", U.base_domain(U.host(F.col("url"))).alias("base_domain"))


@register("url_path", f"WITH {_ALL} SELECT page_id, {PATH_SQL.format(u='url')} AS path FROM u_")
def url_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", U.path(F.col("url")).alias("path"))


@register("url_fragment", f"WITH {_ALL}, f_ AS (SELECT page_id, {FRAGMENT_SQL.format(u='url')} AS f FROM u_) SELECT page_id, f AS fragment, {_ROUTE.format(f='f')} AS meaningful FROM f_")
def url_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = U.fragment(F.col("url"))
    return all_urls(spark, sf_dir).select("page_id", f.alias("fragment"), U.meaningful(f).alias("meaningful"))


_EXT_SQL = "(" + ", ".join(f"'{e}'" for e in sorted(SKIPPED_EXTENSIONS)) + ")"


@register("url_skip_extension", f"WITH {_ALL} SELECT page_id, lower(regexp_extract({PATH_SQL.format(u='url')}, '(\\.[^./]*)$', 1)) IN {_EXT_SQL} AS skipped FROM u_")
def url_skip_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_urls(spark, sf_dir).select("page_id", U.skipped_extension(F.col("url")).alias("skipped"))


@register("url_include_exclude", f"WITH {_ALL} SELECT page_id, regexp_matches(url, '(?i)/ES/') OR regexp_matches(url, '(?i)blog\\.') AS included, NOT regexp_matches(url, '(?i)utm_') AS not_excluded, TRUE AS no_rules FROM u_")
def url_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return all_urls(spark, sf_dir).select("page_id", U.allowed(u, ("/ES/", r"blog\.", "("), ("http",)).alias("included"), U.allowed(u, (), ("utm_", "")).alias("not_excluded"), U.allowed(u, ("(",)).alias("no_rules"))


_NAMES = [("https://www.Example.com:8080/x",), ("WWW.example.com",), ("http://https://a.b",), (" example.com ",), ("example.com/path:1",), ("",)]


@register("clean_domain", f"SELECT name, lower(trim(string_split(string_split(regexp_replace(regexp_replace(regexp_replace(name, '^http://', ''), '^https://', ''), '^www\\.', ''), '/')[1], ':')[1])) AS domain FROM {sql_values(_NAMES, 'name')}")
def clean_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _NAMES, "name string").select("name", U.clean_domain(F.col("name")).alias("domain"))


_TARGETS = [("https://www.shop.example.co.uk/a",), ("www.Example.com/x",), ("http://example.org",), ("example.net:81",)]


@register(
    "job_target",
    f"""WITH t AS (SELECT target, {HOST_SQL.format(u='target')} AS h, lower(trim(string_split(string_split(regexp_replace(regexp_replace(regexp_replace(target, '^http://', ''), '^https://', ''), '^www\\.', ''), '/')[1], ':')[1])) AS c FROM {sql_values(_TARGETS, 'target')})
    SELECT target, CASE WHEN h <> '' THEN {BASE_SQL.format(h='h')} ELSE c END AS domain, CASE WHEN h <> '' THEN target ELSE 'https://' || c END AS target_url FROM t""",
)
def job_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's domain and first URL: from a full URL, or from a bare domain."""
    t, h = F.col("target"), U.host(F.col("target"))
    clean = U.clean_domain(t)
    return values(spark, _TARGETS, "target string").select("target", F.when(h != "", U.base_domain(h)).otherwise(clean).alias("domain"), F.when(h != "", t).otherwise(F.concat(F.lit("https://"), clean)).alias("target_url"))


_SEEDS = [("https://example.com",), ("https://example.org/",), ("https://example.net/a/b",), ("https://example.com/#/app",)]


@register(
    "seed_expansion",
    f"""WITH s AS (SELECT target, {PATH_SQL.format(u='target')} AS p, {FRAGMENT_SQL.format(u='target')} AS f, regexp_extract(target, '^([a-z]+://[^/?#]*)', 1) AS o FROM {sql_values(_SEEDS, 'target')})
    SELECT target AS url, 0 AS depth, '' AS parent_url FROM s UNION ALL
    SELECT o || x, 0, target FROM s, (VALUES ('/robots.txt'), ('/sitemap.xml'), ('/sitemap_index.xml')) AS v(x) WHERE p = '/' AND NOT {_ROUTE.format(f='f')}""",
)
def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's first URLs: its target and, for a site's root, the places where sites list their pages."""
    s = values(spark, _SEEDS, "target string")
    t = F.col("target")
    origin = F.regexp_extract(t, r"^([a-z]+://[^/?#]*)", 1)
    more = s.filter((U.path(t) == "/") & ~U.meaningful(U.fragment(t))).select(F.explode(F.array(*(F.concat(origin, F.lit(x)) for x in ("/robots.txt", "/sitemap.xml", "/sitemap_index.xml")))).alias("url"), F.lit(0).alias("depth"), t.alias("parent_url"))
    return s.select(t.alias("url"), F.lit(0).alias("depth"), F.lit("").alias("parent_url")).unionByName(more)


_TEMPLATES = [(1, "https://x.com/{{city}}/{{page}}/{{city}}"), (2, "plain"), (3, "{{a}}{{ b}}{{c_1}}")]


@register("template_vars", f"SELECT id, array_to_string(list_distinct_ordered, ',') AS vars, len(list_distinct_ordered) > 0 AS has_vars FROM (SELECT id, list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN list_position(m, m[i]) = i THEN m[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT id, regexp_extract_all(t.template, '\\{{\\{{(\\w+)\\}}\\}}', 1) AS m FROM {sql_values(_TEMPLATES, 'id, template')}))")
def template_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.variables(F.col("template"))
    return values(spark, _TEMPLATES, "id int, template string").select("id", F.concat_ws(",", v).alias("vars"), (F.size(v) > 0).alias("has_vars"))


_EXPRESSIONS = [(1, "1,hamster,5-10"), (2, "3-5"), (3, "hello"), (4, "10-8"), (5, "1-2-3"), (6, "01-03"), (7, "-5-3"), (8, "a, ,b"), (9, "1-20002")]


@register(
    "value_expr",
    f"""WITH i AS (SELECT id, trim(x) AS x, n FROM (SELECT id, unnest(string_split(expr, ',')) AS x, generate_subscripts(string_split(expr, ','), 1) AS n FROM {sql_values(_EXPRESSIONS, 'id, expr')}) WHERE trim(x) <> ''),
    r AS (SELECT id, n, x, try_cast(nullif(regexp_extract(x, '^(-?[0-9]+)-([0-9]+)$', 1), '') AS BIGINT) AS a, try_cast(nullif(regexp_extract(x, '^(-?[0-9]+)-([0-9]+)$', 2), '') AS BIGINT) AS b FROM i),
    e AS (SELECT id, n, CASE WHEN a IS NULL OR b - a > 10000 THEN [x] WHEN a <= b THEN list_transform(range(a, b + 1), lambda v: v::VARCHAR) ELSE list_transform(range(a, b - 1, -1), lambda v: v::VARCHAR) END AS v FROM r)
    SELECT id, array_to_string(flatten(list(v ORDER BY n)), ',') AS vals FROM e GROUP BY id""",
)
def value_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _EXPRESSIONS, "id int, expr string").select("id", F.concat_ws(",", P.expand_values(F.col("expr"))).alias("vals"))


@register("template_expand", "SELECT replace(replace('https://x.com/{{c}}/{{p}}', '{{c}}', c), '{{p}}', p::VARCHAR) AS url FROM (VALUES ('rome'), ('oslo')) AS a(c), range(1, 4) AS b(p)")
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.expand(spark, "https://x.com/{{c}}/{{p}}", {"c": "rome,oslo", "p": "1-3"})


_HOSTS_SQL = f"hosts_ AS (SELECT DISTINCT {HOST_SQL.format(u='url')} AS host FROM pages), doms_ AS (SELECT DISTINCT {BASE_SQL.format(h='host')} AS domain FROM hosts_)"
_PREFIX_SQL = "(VALUES " + ", ".join(f"('{p}')" for p in sorted(HOST_PREFIXES)) + ") AS p(prefix)"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host")).distinct()


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = _hosts(spark, sf_dir).select(U.base_domain(F.col("host")).alias("domain")).distinct()
    prefixes = values(spark, [(p,) for p in sorted(HOST_PREFIXES)], "prefix string")
    return domains.crossJoin(F.broadcast(prefixes)).select("domain", F.concat_ws(".", "prefix", "domain").alias("subdomain"))  # 126 prefixes


@register("subdomain_candidates", f"WITH {_HOSTS_SQL} SELECT domain, prefix || '.' || domain AS subdomain FROM doms_, {_PREFIX_SQL}")
def subdomain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


_FOUND_SQL = f"WITH {_HOSTS_SQL}, f_ AS (SELECT domain, domain AS subdomain FROM doms_ UNION SELECT domain, prefix || '.' || domain FROM doms_, {_PREFIX_SQL} WHERE prefix || '.' || domain IN (SELECT host FROM hosts_))"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _candidates(spark, sf_dir).join(_hosts(spark, sf_dir).withColumnRenamed("host", "subdomain"), "subdomain", "left_semi")
    own = _candidates(spark, sf_dir).select("domain", F.col("domain").alias("subdomain"))
    return hit.select("domain", "subdomain").unionByName(own).distinct()


@register("subdomain_discovered", f"{_FOUND_SQL} SELECT domain, count(*) AS found FROM f_ GROUP BY domain")
def subdomain_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names of each domain exist, the domain itself included."""
    return _found(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("found"))


@register("subdomains_sorted", f"{_FOUND_SQL} SELECT domain, subdomain, row_number() OVER (PARTITION BY domain ORDER BY subdomain)::INTEGER AS place FROM f_")
def subdomains_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _found(spark, sf_dir).select("domain", "subdomain", F.row_number().over(Window.partitionBy("domain").orderBy("subdomain")).alias("place"))
