"""Operators on tables, sources and sinks, streaming, and the registry against DuckDB."""

import datetime
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcorpus.operators import figures, pages, search, vectors
from loomcorpus.plans import registry
from loomcorpus.sources import tables as sources
from loomcorpus.streaming import ingest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    cur = duck.execute(registry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == cols
    place = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(tuple(canon(r[k]) for k in place) for r in cur.fetchall())
    assert sorted(tuple(canon(r[c]) for c in cols) for r in got) == want


@pytest.mark.parametrize("name", ["html_text", "html_title", "corpus_text", "links_resolved", "links_with_anchors"])
def test_references_without_a_semicolon_stay_as_the_sql_has_them(spark, duck, tmp_path, name):
    pages_ = [
        (1, "https://x.com/a", "<title>A &amp; B&amp;amp; C&amp</title><p>;One &copy &middot; &quot;x&quot<a href=\"/b?x=1&copy;y=2&amp\">Link&copy</a>"),
        (2, "https://x.com/b", "<title>no &am</title>&lt;b&gt; &#39;q&#39 \ue000 &"),
    ]
    spark.createDataFrame(pages_, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()[name](spark, str(tmp_path))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_phrase_figures_cover_the_whole_index(spark, tmp_path):
    rows = [(1, "One thing nicht, thing", "en", "src3", 9), (2, "nicht singing", "de", "src3", 9), (3, "thing ring", "en", "src1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    stats = {(r.phrase, r.extracted): (r.match_count, r.page_count) for r in registry.queries()["phrase_stats"](spark, str(tmp_path)).collect()}
    assert stats["thing", True] == stats["thing", False] == (3, 2) and stats["nicht", False] == (2, 2) and stats["attion", False] == (0, 0)
    found = {r.phrase for r in registry.queries()["extracted_phrases"](spark, str(tmp_path)).collect()}
    assert {"thing", "singing", "nicht singing"} <= found and "ring" not in found


def test_search_figures(spark):
    # N = 100, df = 10, occurrences 3, exact: 4.431; with a second term of idf 0: x 1.5
    t = datetime.datetime(2024, 1, 1)
    rows = [(k, f"u{k}", "j", "alpha", 3 if k == 0 else 1, "content", t) for k in range(10)] + [(k, f"u{k}", "j", "beta", 1, "content", t) for k in range(100)]
    matches = spark.createDataFrame(rows, "page_id long, url string, crawl_job_id string, phrase string, occurrences int, match_type string, found_at timestamp")
    rows = search.scored(matches, spark.range(1).select(F.lit(100).alias("n")), ["alpha", "beta"])
    top = search.page_level(rows, ["alpha", "beta"]).filter("url = 'u0'").first()
    assert round(top.plain, 3) == 4.431 and round(top.total, 3) == 6.647 and top.matched_terms == 2


def test_search_without_words_is_empty(spark):
    p = spark.createDataFrame([(1, "u", "j", "text", False, datetime.datetime(2024, 1, 1))], "page_id long, url string, crawl_job_id string, text_content string, is_archived boolean, crawled_at timestamp")
    jobs = spark.createDataFrame([("j", "d")], "id string, domain string")
    assert search.search(p, jobs, []).count() == 0
    assert search.search(p, jobs, ["text"], limit=5, offset=9).count() == 0


def test_codec(spark):
    rows = spark.createDataFrame([(1, [0.5, -2.0]), (2, []), (3, None), (4, [1.0])], "k int, v array<float>")
    coded = vectors.encode(rows, "v", "b")
    assert {r.k: r.b for r in coded.collect()} == {1: b"\x00\x00\x00?\x00\x00\x00\xc0", 2: b"", 3: None, 4: b"\x00\x00\x80?"}
    back = vectors.decode(coded, "b", "w")
    assert all(r.v == r.w for r in back.collect())
    odd = spark.createDataFrame([(b"abc",), (None,), (b"\x00\x00\x80?",)], "b binary")
    assert [r.v for r in vectors.decode(odd, "b", "v").collect()] == [None, None, [1.0]]


def test_stored_index_and_vectors(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    rows = [(k, f"u{k}", "j", when, f"alpha beta gamma{k % 3} alpha") for k in range(20)]
    pages_ = spark.createDataFrame(rows, "page_id long, url string, crawl_job_id string, crawled_at timestamp, text_content string").withColumn("is_archived", F.lit(False))
    sources.write_postings(search.postings(pages_), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p")).filter(F.col("phrase").startswith("alpha"))
    jobs = spark.createDataFrame([("j", "d")], "id string, domain string")
    one = search.search(pages_, jobs, ["alpha"], matches=stored).collect()
    assert one == search.search(pages_, jobs, ["alpha"]).collect() and len(one) == 20
    sources.write_vectors(spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "page_id long, crawl_job_id string, embedding array<float>"), str(tmp_path / "v"))
    assert [r.page_id for r in spark.read.parquet(str(tmp_path / "v")).filter("crawl_job_id = 'b'").collect()] == [2]


def test_sinks(spark, tmp_path):
    table = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    sources.insert_ignore(a, table, ["k"])
    sources.insert_ignore(spark.createDataFrame([(2, "x"), (3, "d")], "k int, v string"), table, ["k"])
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == [1, 2, 3]
    assert {r.v for r in sources.latest(a.withColumn("n", F.ascii("v")), ["k"], "n").collect()} == {"b", "c"}
    (tmp_path / "e.json").write_text('{"data": [{"token": "t1"}, {"token": "t2"}]}')
    entries = sources.read_entries(spark, str(tmp_path / "e.json"), "token string")
    assert entries.count() == 2
    sources.append_entries(entries, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("max_depth: 7\nrespect_robots: false\n# x: 1\n")
    s = sources.Settings.load(str(f), {"LOOMCORPUS_MAX_DEPTH": "9"})
    assert s.max_depth == 9 and s.respect_robots is False
    assert sources.Settings.load(str(tmp_path / "no"), {"LOOMCORPUS_MAX_DEPTH": "9"}).max_depth == 5
    assert s.merged({"max_pages": 3, "language": None, "max_retries": []}).max_pages == 3


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "https://x.com/a?utm_source=q", "<title>T</title>hi", t), (2, "https://x.com/a", "again", t), (3, "https://y.com/", "other", t)]
    spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.crawl_job_id for r in out) == ["x.com", "y.com"]


def test_frontier_rules(spark):
    f = spark.createDataFrame([(1, "j", "pending", 0), (2, "j", "processing", 2), (3, "j", "pending", 1)], "id long, crawl_job_id string, status string, retries int")
    assert pages.claim(f, 1).count() == 1
    assert {(r.retries, r.status) for r in pages.failed(f).collect()} == {(1, "pending"), (3, "pending"), (2, "pending")}


def test_the_library_works_without_the_llm_folders(tmp_path):
    code = (
        "import sys; sys.modules['loomcorpus.llm'] = None; sys.path.insert(0, %r)\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'keyword_search' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    ) % str(ROOT)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_llm_folder():
    for p in (ROOT / "loomcorpus").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()


def test_phrases_are_detected_in_one_pass_or_several(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "abcdefMIDghijkl"), (2, "AAAA aa"), (3, None), (4, ""), (5, "real-time, Real  TIME")], "k int, t string")
    phrases = spark.createDataFrame([(1, "mid"), (2, "aa"), (3, "real time"), (4, ""), (5, "AA"), (6, "none")], "phrase_id int, phrase string")
    want = {(1, 1, "mid", 1, "...defMIDghi..."), (2, 2, "aa", 3, "AAAA..."), (2, 5, "AA", 3, "AAAA..."), (5, 3, "real time", 2, "real time Re...")}
    for at_once in (50_000, 2):
        monkeypatch.setattr(search, "PHRASES_AT_ONCE", at_once)
        got = search.detect(rows, phrases, "t", 3).drop("t").collect()
        assert {tuple(r) for r in got} == want and len(got) == 4


def test_index_counts_like_a_loop(spark):
    texts = [(1, "One thing nicht, thing one thing"), (2, ""), (3, None), (4, "42 x yz yz 7b"), (5, "solo")]
    pages_ = spark.createDataFrame([(k, "u", "j", datetime.datetime(2024, 1, 1), t) for k, t in texts], "page_id long, url string, crawl_job_id string, crawled_at timestamp, text_content string")
    words = {1: "thing nicht thing thing".split(), 4: "yz yz 7b".split(), 5: ["solo"]}
    want = {}
    for k, w in words.items():
        for n in (1, 2, 3):
            for a in range(len(w) - n + 1):
                g = " ".join(w[a : a + n])
                want[k, g] = want.get((k, g), 0) + 1
    got = {(r.page_id, r.phrase): r.occurrences for r in search.postings(pages_).collect()}
    assert got == want
    for prefixes in (["thing"], ["thing ni", "y"], ["nope"], []):
        some = {(r.page_id, r.phrase): r.occurrences for r in search.postings(pages_, prefixes).collect()}
        assert some == {k: v for k, v in want.items() if any(k[1].startswith(p) for p in prefixes)}


def test_stems_of_all_tokens_equal_a_loop(spark):
    from loomcorpus.functions import stem

    rows = registry.queries()["stem_english"](spark, SF).collect()
    assert len({r.lang for r in rows}) == 4 and len({(r.lang, r.token) for r in rows}) == len(rows)
    assert all(r.stem == (stem.porter2(r.token) if r.lang == "en" else r.token) for r in rows)


def test_phrase_figures_are_in_order_over_ranges_and_parts(spark, duck, monkeypatch):
    for name, value in {"RANGE_BYTES": 50_000, "TEXT_AT_ONCE": 20_000, "BLOCK_ROWS": 500, "PART_ROWS": 5000, "MANY": 20}.items():
        monkeypatch.setattr(figures, name, value)
    got = registry.queries()["phrase_stats"](spark, SF)
    assert "RangePartitioning" not in got._jdf.queryExecution().toString()
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['phrase_stats']}) ORDER BY match_count DESC, phrase, extracted").fetchall()
    assert [tuple(r) for r in got.collect()] == want


def test_phrases_are_counted_by_bytes_of_text_and_without_a_bound_on_words():
    batch = pa.record_batch([pa.array(["a" * 9, None, "b" * 30, "", "c" * 5, "d" * 5])], names=["t"])
    assert [b.num_rows for b in search.chunks(batch, "t", 10)] == [2, 1, 3]
    columns = [np.array([3, 1, 3, 1, 2], np.uint64), np.array([0, 5, 0, 4, 0], np.uint64)]
    for sizes in ([4, 6], [1 << 40, 1 << 40]):  # packed into one number, and too large for it
        rows, n = search.distinct(columns, sizes)
        assert [r.tolist() for r in rows] == [[1, 1, 2, 3], [4, 5, 0, 0]] and n.tolist() == [1, 1, 1, 2]
