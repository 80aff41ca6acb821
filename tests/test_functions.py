"""Rules by worked examples."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcorpus.functions import html as H
from loomcorpus.functions import stem, templates
from loomcorpus.functions import text as T
from loomcorpus.functions import urls as U


def one(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80//a//b/?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2"),
        ("https://m.x.example.com/es/12?page=2&ref=x", "https://m.x.example.com/es/12?page=2"),
        ("//Example.com", "https://example.com/"),
        ("https://example.com/#/search?q=foo", "https://example.com/#/search?q=foo"),
        ("https://example.com/a#top", "https://example.com/a"),
        ("example.com/x", None),
        ("ftp://h/x", None),
        (" ", None),
    ],
)
def test_normalise(spark, url, want):
    assert one(spark, U.normalise(F.col("u")), u=url) == want
    assert U.normalise_one(url) == want


def test_percent_encoding():
    assert U.normalise_one("https://x.com/a%20b/%7Ec?q=a%20b&k") == "https://x.com/a%20b/~c?k=&q=a+b"
    assert U.normalise_one("https://[::1") is None


@pytest.mark.parametrize(("host", "want"), [("a.b.example.co.uk", "example.co.uk"), ("www.example.com", "example.com"), ("192.168.1.1", "1.1"), ("localhost", "localhost"), ("co.uk", "co.uk")])
def test_base_domain(spark, host, want):
    assert one(spark, U.base_domain(F.col("h")), h=host) == want


@pytest.mark.parametrize(("name", "want"), [("https://www.Example.com:8080/x", "example.com"), ("WWW.example.com", "www.example.com")])
def test_clean_domain(spark, name, want):
    assert one(spark, U.clean_domain(F.col("n")), n=name) == want


@pytest.mark.parametrize(("path", "want"), [("/a/b.PDF", True), ("/a.b/c", False), ("/x.html", False)])
def test_extension(spark, path, want):
    assert one(spark, U.skipped_extension(F.col("u")), u=f"https://x.com{path}?q=.pdf") is want


@pytest.mark.parametrize(("expr", "want"), [("1,x,5-7", "1 x 5 6 7"), ("10-8", "10 9 8"), ("1-2-3", "1-2-3"), ("01-03", "1 2 3"), ("-5--3", "-5--3"), ("0-10001", "0-10001"), (" a , ,b", "a b")])
def test_values(spark, expr, want):
    assert " ".join(one(spark, templates.expand_values(F.col("e")), e=expr)) == want


def test_template_errors(spark):
    with pytest.raises(ValueError):
        templates.expand(spark, "{{a}}", {})
    with pytest.raises(ValueError):
        templates.expand(spark, "{{a}}", {"a": "1-10"}, most=9)
    assert [r.url for r in templates.expand(spark, "{{a}}", {"a": "{{b}}", "b": "1"}).collect()] == ["{{b}}"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Real-time, 2024 é x Été") == ["real", "time", "é", "été"]
    assert one(spark, T.all_ngrams(T.tokens(F.col("t"))), t="cat of dog") == ["cat", "dog", "cat dog"]
    assert one(spark, T.all_ngrams(T.tokens(F.col("t"))), t="") == []
    assert T.query_ngrams(["a", "b", "c"]) == ["a b c", "a b", "b c", "a", "b", "c"]


def test_phrases(spark):
    assert one(spark, T.phrase_text(F.col("t")), t="real-time,\n\nx") == "real time x"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("relational", "relat"), ("generalization", "general"), ("hoping", "hope"), ("dying", "die"), ("news", "news"), ("by", "by"), ("controlling", "control"), ("happy", "happi")])
def test_porter2(word, want):
    assert stem.porter2(word) == want


def test_html_parser_and_expressions_agree(spark):
    page = "<html><head><title> A &amp; B </title><style>x{}</style></head><body><!-- c --><p>One<p>two <b>three</b><script>var a = '</p>';</script></body></html>"
    df = spark.createDataFrame([(page,)], ["h"])
    r = df.select(H.parse("h").alias("p"), H.text(F.col("h")).alias("t"), H.title(F.col("h")).alias("title")).first()
    assert r.p.text == r.t == "A & B Onetwo three" and r.p.title == r.title == "A & B"


def test_robots(spark):
    allowed = lambda body, path: one(spark, H.robots_allows(H.robots(F.col("b")), F.lit(path)), b=body)
    assert allowed("Disallow: /a\nAllow: /a", "/a/x") is False
    assert allowed("Disallow: /a\nAllow: /a/x", "/a/x") is True
    assert allowed("User-agent: bot\nDisallow: /", "/a") is True
    assert allowed("", "/a") is True


def test_json_state(spark):
    assert one(spark, H.json_state("b", F.lit("S =")), b='S = {"a": "}"} x') == '{"a":"}"}'
    assert one(spark, H.json_state("b", F.lit("S =")), b="S = {a") is None


def test_tokens_in_arrow_equal_those_in_columns(spark):
    texts = ["Real-time, 2024 é x Été 12ab ٣٤ ab٣", "", None, "the THE and", "a b c", "…", "naïve/co-op_x 42", "ﬁne ½ Ⅷ x²"]
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts + more)], "k int, t string")
    want = {r.k: r.w for r in rows.select("k", T.tokens(F.col("t")).alias("w")).collect()}
    got = T.token_lists(pa.array(texts + more)).to_pylist()
    assert all((want[k] or []) == got[k] for k in want)
