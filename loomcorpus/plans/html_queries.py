"""Queries over pages' HTML, sitemaps, robots rules and embedded JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..tables import html_pages, sql_values, values
from .registry import register
from .url_queries import BASE_SQL, HOST_SQL, PATH_SQL, normal_sql

WS = "[ \\t\\n\\f\\r]+"


def decoded_sql(t: str) -> str:
    for a, b in H._ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return t


_STRIPPED = "html"
for _tag in ("script", "style", "noscript"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
TEXT_SQL = f"trim(regexp_replace({decoded_sql(f'''regexp_replace(regexp_replace({_STRIPPED}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[!/a-zA-Z][^>]*>', '', 'g')''')}, '{WS}', ' ', 'g'))"


@register("html_text", f"SELECT page_id, {TEXT_SQL} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages(spark, sf_dir).select("page_id", H.text(F.col("html")).alias("text"))


@register("html_title", f"SELECT page_id, trim({decoded_sql('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages(spark, sf_dir).select("page_id", H.title(F.col("html")).alias("title"))


_LINKS_SQL = f"""a_ AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 1) AS n FROM pages),
l_ AS (SELECT page_id, base, n, trim({decoded_sql("regexp_extract(a, '(?is)href=" + '"([^"]*)"' + "', 1)")}) AS href, trim(regexp_replace({decoded_sql("regexp_replace(a, '(?s)<[^>]*>', '', 'g')")}, '{WS}', ' ', 'g')) AS anchor FROM a_),
o_ AS (SELECT *, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin FROM l_),
t_ AS (SELECT page_id, base, n, anchor, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^([A-Za-z]+:)', 1) || href WHEN starts_with(href, '#') THEN origin || '/' || href
   WHEN starts_with(href, '?') THEN origin || {PATH_SQL.format(u='base')} || href WHEN starts_with(href, '/') THEN origin || href ELSE origin || regexp_extract({PATH_SQL.format(u='base')}, '^(.*/)', 1) || href END AS target
   FROM o_ WHERE href <> '' AND NOT regexp_matches(href, '^(javascript|mailto|tel|data):') AND NOT (starts_with(href, '#') AND NOT (starts_with(href[2:], '/') OR contains(href, '?') OR contains(href, '&')))),
k_ AS (SELECT row_number() OVER () AS rid, * FROM t_),
r_ AS (SELECT page_id, base, n, anchor, normal AS link FROM k_ JOIN {normal_sql('k_', 'rid', 'target')} USING (rid) WHERE normal IS NOT NULL)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, base, n, anchor, link): each link's normalised target, in order."""
    rows = html_pages(spark, sf_dir).select("page_id", F.col("url").alias("base"), F.posexplode(H.anchors(F.col("html"))).alias("n", "a"))
    return rows.select("page_id", "base", "n", "a.anchor", U.resolve(F.col("a.href"), F.col("base")).alias("link")).filter("link IS NOT NULL")


@register("links_resolved", f"WITH {_LINKS_SQL} SELECT DISTINCT page_id, link FROM r_")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("page_id", "link").distinct()


@register("links_with_anchors", f"""WITH {_LINKS_SQL}, g_ AS (SELECT page_id, link, list(anchor ORDER BY n) AS ts FROM r_ GROUP BY ALL)
SELECT page_id, link, list_reduce(list_concat([''], ts), lambda acc, t: CASE WHEN t = '' OR contains(acc, t) THEN acc WHEN acc = '' THEN t ELSE acc || ' | ' || t END) AS anchor FROM g_""")
def links_with_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = links(spark, sf_dir).groupBy("page_id", "link").agg(F.sort_array(F.collect_list(F.struct("n", "anchor"))).alias("ts"))
    return by.select("page_id", "link", H.joined_anchors(F.col("ts.anchor")).alias("anchor"))


def _base_of(u: str) -> str:
    return f"(SELECT {BASE_SQL.format(h='h')} FROM (SELECT {HOST_SQL.format(u=u)} AS h))"


@register("links_same_domain", f"WITH {_LINKS_SQL} SELECT DISTINCT page_id, link FROM r_ WHERE {_base_of('link')} = {_base_of('base')}")
def links_same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = U.base_domain(U.host(F.col("link"))) == U.base_domain(U.host(F.col("base")))
    return links(spark, sf_dir).filter(same).select("page_id", "link").distinct()


_MARKUP = [
    (1, '<html><head><link rel="canonical" href="/c"><script src="/s.js"></script></head><body><img src="/i.png"><iframe src="https://x.org/f"></iframe><form action="/go"></form><div data-href="/d1" data-url="/d2"></div></body></html>'),
    (2, '<meta http-equiv="Refresh" content="5; URL=/next"><meta property="og:image" content="https://x.org/o.png"><meta name="twitter:site" content="@x"><img srcset="/a.png 1x, /b.png 2x"><script>var a = "https://x.org/api?q=1"; go("http://y.org/z.");</script>'),
    (3, "<p>nothing</p>"),
]
_MARKUP_SCHEMA = "id int, html string"


def _parsed(spark: SparkSession) -> DataFrame:
    rows = values(spark, _MARKUP, _MARKUP_SCHEMA).select("id", H.parse("html").alias("p"))
    return rows.select("id", F.explode("p.links").alias("l")).select("id", "l.kind", "l.href")


def _kinds(spark: SparkSession, kinds: tuple[str, ...]) -> DataFrame:
    return _parsed(spark).filter(F.col("kind").isin(*kinds))


def _tag_sql(tag: str, attribute: str, kind: str | None = None) -> str:
    return f"""SELECT id, '{kind or tag}' AS kind, unnest(regexp_extract_all(html, '<{tag}[^>]*\\s{attribute}="([^"]*)"', 1)) AS href FROM m_"""


_M = f"WITH m_ AS (SELECT * FROM {sql_values(_MARKUP, 'id, html')})"


@register("links_resources", f"{_M} " + " UNION ALL ".join([_tag_sql("img", "src"), _tag_sql("script", "src"), _tag_sql("iframe", "src"), _tag_sql("link", "href"), _tag_sql("form", "action"), *(_tag_sql("[a-z]+", d, d) for d in H._DATA)]))
def links_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, ("img", "script", "iframe", "link", "form", *H._DATA))


@register("links_meta", f"""{_M} SELECT id, 'refresh' AS kind, unnest(regexp_extract_all(html, '(?i)http-equiv="refresh" content="[^"]*url=([^"]*)"', 1)) AS href FROM m_ UNION ALL SELECT id, 'meta', unnest(regexp_extract_all(html, '<meta (?:property|name)="(?:og|twitter):[^"]*" content="(http[^"]*)"', 1)) FROM m_""")
def links_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, ("refresh", "meta"))


@register("links_srcset", f"""{_M}, s AS (SELECT id, unnest(regexp_extract_all(html, 'srcset="([^"]*)"', 1)) AS s FROM m_) SELECT id, 'srcset' AS kind, string_split(trim(x), ' ')[1] AS href FROM (SELECT id, unnest(string_split(s, ',')) AS x FROM s)""")
def links_srcset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, ("srcset",))


@register("links_script", f"""{_M}, s AS (SELECT id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS s FROM m_) SELECT id, 'inline' AS kind, regexp_replace(u, '[.,;:!?)\\]}}]+$', '') AS href FROM (SELECT id, unnest(regexp_extract_all(s, 'https?://[^\\s"''<>\\\\`]+')) AS u FROM s)""")
def links_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, ("inline",))


#: Links and text that only a parser reads: quotes of all kinds or none, entities, upper case, unclosed elements, scripts with markup.
_ODD = [
    (1, "<p>Caf&eacute; &#233; &hellip; a&lt;b</p><A HREF='/one'>One</A> <a href=/two>Two <b>bold</b></a><a class=x href = \"/three?x=1&amp;y=2\">3</a>"),
    (2, "<script>var s = '<a href=\"/no\">no</a></p>';</script><style>p {}</style><noscript>none</noscript>text<!-- <a href='/c'>c</a> --> after <a name=x>no target</a><a href='/open'>unclosed"),
    (3, ""),
]
_ODD_LINKS = [(1, 0, "/one", "One"), (1, 1, "/two", "Two bold"), (1, 2, "/three?x=1&y=2", "3"), (2, 0, "/open", "unclosed")]
_ODD_TEXTS = [(1, "Caf\u00e9 \u00e9 \u2026 a<bOne Two bold3"), (2, "text after no targetunclosed"), (3, "")]


@register("html_odd_links", f"SELECT * FROM {sql_values(_ODD_LINKS, 'id, n, href, anchor')}")
def html_odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, _ODD, "id int, html string").select("id", F.posexplode(H.anchors(F.col("html"))).alias("n", "a"))
    return rows.select("id", "n", "a.href", "a.anchor")


@register("html_odd_text", f"SELECT * FROM {sql_values(_ODD_TEXTS, 'id, text')}")
def html_odd_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _ODD, "id int, html string").select("id", H.text(F.col("html")).alias("text"))


_MAPS = [(1, "<urlset><url><loc> https://X.com/a </loc></url><url><loc>https://x.com/b?utm_source=q</loc></url></urlset>"), (2, "<sitemapindex><sitemap><loc>https://x.com/s2.xml</loc></sitemap></sitemapindex>"), (3, "<urlset><url><loc><![CDATA[https://x.com/c]]></loc></url></urlset>"), (4, "")]
_MAPS_SQL = sql_values(_MAPS, "id, xml")


@register("sitemap_urls", f"""WITH x AS (SELECT id, 'page' AS kind, unnest(regexp_extract_all(xml, '(?is)<url>(.*?)</url>', 1)) AS b FROM {_MAPS_SQL} UNION ALL SELECT id, 'sitemap', unnest(regexp_extract_all(xml, '(?is)<sitemap>(.*?)</sitemap>', 1)) FROM {_MAPS_SQL}),
k AS (SELECT row_number() OVER () AS rid, id, kind, trim(regexp_extract(b, '(?is)<loc>([^<]*)</loc>', 1)) AS loc FROM x)
SELECT id, kind, normal AS url FROM k JOIN {normal_sql('k', 'rid', 'loc')} USING (rid) WHERE normal IS NOT NULL""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, _MAPS, "id int, xml string").select("id", F.explode(H.sitemap(F.col("xml"))).alias("s"))
    return rows.select("id", "s.kind", U.normalise(F.col("s.loc")).alias("url")).filter("url IS NOT NULL")


_ROBOTS = [
    (1, "# hello\nDisallow: /early\nUser-agent: bot\nDisallow: /bot\nSitemap: https://x.com/s.xml\nUser-Agent: *\nDisallow: /a\nAllow: /a\nAllow: /a/x\nDisallow:\n"),
    (2, "User-agent: *\nDisallow: /\nAllow: /open\n"),
    (3, ""),
]
_ROBOTS_SQL = f"""rl_ AS (SELECT id, trim(unnest(string_split(body, chr(10)))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM {sql_values(_ROBOTS, 'id, body')}),
rp_ AS (SELECT id, n, lower(trim(string_split(line, ':')[1])) AS directive, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS value FROM rl_ WHERE NOT starts_with(line, '#') AND contains(line, ':')),
ra_ AS (SELECT *, last_value(CASE WHEN directive = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS agent FROM rp_),
rules_ AS (SELECT id, directive, value FROM ra_ WHERE value <> '' AND (directive = 'sitemap' OR directive IN ('allow', 'disallow') AND coalesce(agent, '*') = '*'))"""


def _rules(spark: SparkSession) -> DataFrame:
    return values(spark, _ROBOTS, "id int, body string").select("id", H.robots(F.col("body")).alias("rules"))


@register("robots_parse", f"WITH {_ROBOTS_SQL} SELECT * FROM rules_")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark).select("id", F.explode("rules").alias("r")).select("id", "r.directive", "r.value")


_PATHS = [("/",), ("/a",), ("/a/x/1",), ("/early/b",), ("/bot",), ("/open/1",), ("/b",)]


@register("robots_allowed", f"""WITH {_ROBOTS_SQL}, ids AS (SELECT id FROM {sql_values(_ROBOTS, 'id, body')}),
b AS (SELECT i.id, p.path, coalesce(max(CASE WHEN directive = 'disallow' THEN length(value) END), 0) AS no, coalesce(max(CASE WHEN directive = 'allow' THEN length(value) END), 0) AS yes
 FROM ids i CROSS JOIN {sql_values(_PATHS, 'path').replace('AS t(', 'AS p(')} LEFT JOIN rules_ r ON r.id = i.id AND starts_with(p.path, r.value) GROUP BY ALL) SELECT id, path, no = 0 OR yes > no AS allowed FROM b""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _rules(spark).crossJoin(values(spark, _PATHS, "path string"))
    return pairs.select("id", "path", H.robots_allows(F.col("rules"), F.col("path")).alias("allowed"))


_TYPES = [("",), ("text/html; charset=utf-8",), ("IMAGE/PNG",), ("Application/JSON",), ("application/pdf",), ("application/atom+xml",)]


@register("content_type_filter", f"SELECT kind, kind = '' OR regexp_matches(lower(kind), 'text/html|application/xhtml\\+xml|application/xml|text/xml|text/plain|application/json|application/rss\\+xml|application/atom\\+xml') AS ok FROM {sql_values(_TYPES, 'kind')}")
def content_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _TYPES, "kind string").select("kind", T.content_type_ok(F.col("kind")).alias("ok"))


_BODIES = [
    (1, 403, "x"), (2, 200, "Just a moment..."), (3, 200, "<title>Error</title>"), (4, 200, "z" * 1600 + "just a moment"), (5, 200, "y" * 2000 + " 503 Service Temporarily Unavailable openresty"), (6, 200, "fine page"),
    (7, 200, '<div ng-app="x">'), (8, 200, '<div ng-app="x" class="ng-scope">'), (9, 200, "<app-root><!-- c --> </app-root>"), (10, 200, "<app-root>" + "w" * 60 + "</app-root>"), (11, 200, "{{a}}" * 11), (12, 200, "<script>" + "{{a}}" * 11 + "</script>"), (13, 200, "<app-root>"),
]
_BODIES_SQL = sql_values(_BODIES, "id, status, html")
_BODIES_SCHEMA = "id int, status int, html string"


@register("page_challenge", f"SELECT id, status IN (403, 503) OR length(html) < 1500 AND regexp_matches(lower(html), 'service temporarily unavailable|service unavailable|just a moment|checking your browser|arvan|ddos protection|access denied|enable javascript and cookies') OR contains(lower(html), 'service temporarily unavailable') AND contains(lower(html), 'openresty') OR length(html) < 500 AND contains(lower(html), '<title>') AND regexp_matches(lower(html), '503|502|403|error|unavailable|blocked|denied') AS challenge FROM {_BODIES_SQL}")
def page_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _BODIES, _BODIES_SCHEMA).select("id", H.challenge(F.col("html"), F.col("status")).alias("challenge"))


@register("page_spa_shell", f"SELECT id, CASE WHEN contains(html, 'ng-app=') THEN NOT contains(html, 'ng-scope') WHEN contains(html, '<app-root') THEN regexp_matches(html, '(?s)<app-root[^>]*>.*?</app-root>') AND length(trim(regexp_replace(trim(regexp_extract(html, '(?s)<app-root[^>]*>(.*?)</app-root>', 1)), '(?s)<!--.*?-->', '', 'g'))) < 50 WHEN contains(html, '{{{{') AND length(html) < 50000 THEN len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '\\{{\\{{[^}}]+\\}}\\}}')) > 10 ELSE FALSE END AS shell FROM {_BODIES_SQL}")
def page_spa_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _BODIES, _BODIES_SCHEMA).select("id", H.unrendered(F.col("html")).alias("shell"))


_STATES = [(1, 'x window.__STATE__ = {"a": {"b": "}\\""}, "c": [1, 2]}; more'), (2, "no state"), (3, "window.__STATE__ = {broken"), (4, None)]


@register("json_state", f"SELECT id, CASE WHEN json_valid(x) THEN json(x)::VARCHAR END AS state FROM (SELECT id, nullif(regexp_extract(body, 'window\\.__STATE__ = (\\{{.*\\}});', 1), '') AS x FROM {sql_values(_STATES, 'id, body')})")
def json_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object that a page embeds after a marker."""
    return values(spark, _STATES, "id int, body string").select("id", H.json_state("body", F.lit("window.__STATE__")).alias("state"))


_ADS = [
    (1, '{"token":"t1","city":{"name":"Rome","id":"7","slug":"rome","parent":"1"},"seo":{"title":"S","webInfo":{"title":"W","district_persian":"D"},"breadcrumbs":[{"name":"A"},{"name":""},{"name":"B"}]},"analytics":{"cat1":"c1","cat2":"c2"},"rows":[{"title":"قیمت","value":"۱۲٬۳۰۰ x"},{"title":"وضعیت","value":"new"},{"title":"k","value":""}],"images":["u1","u2"],"webengage":{"price":55}}'),
    (2, '{"token":"t2","city":{},"seo":{"title":"Only","webInfo":{"city_persian":"P"},"breadcrumbs":[]},"analytics":{"cat1":"z"},"rows":[],"images":[],"webengage":{"price":0}}'),
]
_AD_TYPE = "struct<token:string,city:struct<name:string,id:string,slug:string,parent:string>,seo:struct<title:string,webInfo:struct<title:string,city_persian:string,district_persian:string>,breadcrumbs:array<struct<name:string>>>,analytics:struct<cat1:string,cat2:string,cat3:string>,rows:array<struct<title:string,value:string>>,images:array<string>,webengage:struct<price:bigint>>"
_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"


@register(
    "json_ad_projection",
    f"""SELECT id, j->>'$.token' AS token, coalesce(nullif(j->>'$.seo.webInfo.title', ''), j->>'$.seo.title') AS title, coalesce(j->>'$.city.name', j->>'$.seo.webInfo.city_persian') AS city, coalesce(j->>'$.analytics.cat2', j->>'$.analytics.cat1') AS category_slug,
    array_to_string(list_filter(j->>'$.seo.breadcrumbs[*].name', lambda x: x <> ''), '>') AS breadcrumbs, pr AS price, cond AS condition, coalesce(try_cast(nullif(regexp_replace(translate(pr, '{_DIGITS}', '01234567890123456789'), '[^0-9]', '', 'g'), '') AS BIGINT), nullif((j->>'$.webengage.price')::BIGINT, 0)) AS price_value, len(j->>'$.images[*]')::INTEGER AS n_images
    FROM (SELECT id, j, list_filter(from_json(j->'$.rows', '[{{"title":"VARCHAR","value":"VARCHAR"}}]'), lambda r: r.title = 'قیمت')[1].value AS pr, list_filter(from_json(j->'$.rows', '[{{"title":"VARCHAR","value":"VARCHAR"}}]'), lambda r: r.title = 'وضعیت')[1].value AS cond FROM (SELECT id, body::JSON AS j FROM {sql_values(_ADS, 'id, body')}))""",
)
def json_ad_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advert's fields from its JSON, with fallbacks; the price's digits may be Persian or Arabic."""
    j = values(spark, _ADS, "id int, body string").select("id", F.from_json("body", _AD_TYPE).alias("j"))
    fields = F.map_from_entries(F.filter("j.rows", lambda r: (r["title"] != "") & (r["value"] != "")))
    price = F.try_element_at(fields, F.lit("قیمت"))
    digits = F.regexp_replace(F.translate(price, _DIGITS, "01234567890123456789"), "[^0-9]", "")
    return j.select(
        "id",
        F.col("j.token").alias("token"),
        F.coalesce(F.nullif(F.col("j.seo.webInfo.title"), F.lit("")), F.col("j.seo.title")).alias("title"),
        F.coalesce("j.city.name", "j.seo.webInfo.city_persian").alias("city"),
        F.coalesce("j.analytics.cat2", "j.analytics.cat1").alias("category_slug"),
        F.concat_ws(">", F.filter(F.col("j.seo.breadcrumbs.name"), lambda n: n != "")).alias("breadcrumbs"),
        price.alias("price"),
        F.try_element_at(fields, F.lit("وضعیت")).alias("condition"),
        F.coalesce(digits.try_cast("long"), F.nullif(F.col("j.webengage.price"), F.lit(0))).alias("price_value"),
        F.size("j.images").alias("n_images"),
    )
