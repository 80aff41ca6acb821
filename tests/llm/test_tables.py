"""SimHash, sharding, top-k and the pipeline against brute force; odd inputs."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomcorpus.llm import common, decontam, packing, quality, secrets, sharding, simhash, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed=1, groups=12, extra=150):
    """(texts, group of each): near copies that differ in a few words, and others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
    texts, group = [], []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(80, 300))]
        for _ in range(rng.randint(2, 9)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 30)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
            group.append(g)
    for k in range(extra):
        texts.append(" ".join(word() for _ in range(rng.randint(5, 300))))
        group.append(groups + k)
    return texts, group


def brute_pairs(h, n, radius, ratio):
    out = {}
    for i in range(len(h)):
        d = np.bitwise_count(h[i] ^ h[i + 1 :]).sum(1)
        for j in np.flatnonzero(d <= radius):
            k = i + 1 + int(j)
            if max(n[i], n[k]) <= ratio * min(n[i], n[k]) + 1e-9:
                out[i, k] = int(d[j])
    return out


def union(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def clustered(count=260, seed=3):
    """(fingerprints, feature counts): half are neighbours of the others, at 0 to 40 bits."""
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2**63, (count, 2), dtype=np.uint64) * np.uint64(2)
    for k in range(count // 2, count):
        h[k] = h[rng.integers(0, count // 2)]
        for bit in rng.choice(128, rng.integers(0, 40), replace=False):
            h[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return h, rng.integers(35, 60, count)


@pytest.mark.parametrize(("shard", "leaf"), [(100_000, 100_000), (100_000, 8), (16, 100_000), (40, 6)])
def test_pairs_equal_brute_force(spark, shard, leaf):
    h, n = clustered()
    w = np.random.default_rng(1).integers(1, 5, len(n))
    nodes = spark.createDataFrame([(int(i), int(a), int(b), int(c), int(e)) for i, ((a, b), c, e) in enumerate(zip(h.view(np.int64), n, w))], "id long, h1 long, h2 long, n int, w long")
    want = brute_pairs(h, n, 24, 1.25)
    assert len(want) > 40
    got = simhash.near_pairs(nodes, shard=shard, leaf=leaf)
    assert {(r.a, r.b): r.distance for r in got.collect()} == want and got.count() == len(want)
    rows = simhash.near_pairs(nodes, shard=shard, leaf=leaf, forest=True).collect()
    tree = [(r.a, r.b) for r in rows if r.b is not None]
    assert union(tree) == union(want) and set(tree) <= set(want)
    links = np.zeros(len(n), int)
    for r in rows:
        links[r.a] += r.links or 0
    plain = np.zeros(len(n), int)
    for i, j in want:
        plain[i] += w[j]
        plain[j] += w[i]
    assert links.tolist() == plain.tolist()
    small = simhash.near_pairs(nodes, radius=3, shard=shard, leaf=leaf)
    assert {(r.a, r.b) for r in small.collect()} == set(brute_pairs(h, n, 3, 1.25))


def test_triangle_bounds_prune_at_small_radii():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (12, 2), dtype=np.uint64) * np.uint64(2)
    h = centres[rng.integers(0, 12, 3000)]
    h[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    n = np.full(3000, 50)
    stats = {}
    pairs = sum(len(i) for i, _, _ in simhash.tree_pairs(h, n, h, n, 3, 1.25, leaf=64, stats=stats))
    assert pairs == 2 * len(brute_pairs(h, n, 3, 1.25)) + 3000
    assert stats["depth"] > 2 and stats["distances"] < 0.25 * 3000**2


def test_shards_part_a_band_evenly():
    h, _ = clustered(4000)
    tree = simhash.Tree(h[:500], 8, 24)
    at, shard, own = tree.visits(h)
    assert tree.leaves == 8 and own.sum() == 4000 and len(np.unique(at[own])) == 4000
    assert np.bincount(shard[own], minlength=8).max() < 4000 / 2
    alike = simhash.Tree(np.repeat(h[:1], 100, axis=0), 8, 24)  # nothing to part
    assert alike.leaves == 1


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long"))
    want = {k: v for k, v in union(p for p in pairs if p[0] != p[1]).items()}
    assert {r.id: r.root for r in got.collect()} == want


def test_near_copies_are_found_and_others_left(spark, monkeypatch):
    texts, group = near_copies()
    texts, group = [*texts, *texts[:3]], [*group, *group[:3]]  # exact copies too
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    want = {k: group.index(g) for k, g in enumerate(group) if group.count(g) > 1}
    h1, h2, n = simhash.fingerprints(pa.array(texts))
    links = Counter(k for pair in brute_pairs(np.stack([h1, h2], 1), n, simhash.RADIUS, simhash.RATIO) for k in pair)
    for shard in (simhash.SHARD, 30):
        rows = simhash.grouped(docs, shard=shard).collect()
        assert {r.doc_id: r.group_id for r in rows} == want and len(rows) == len(want)
        assert {r.doc_id: r.n_links for r in rows} == dict(links)
        assert all(r.group_size == group.count(group[r.doc_id]) for r in rows)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {group.index(g) for g in group}


def test_fingerprints_ignore_order_and_batching():
    texts = ["one two three four five", "five four three two one one", "", None, "a b c", "x" * 5000]
    whole = simhash.fingerprints(pa.array(texts))
    assert whole[0][0] == whole[0][1] and whole[2].tolist()[2:4] == [0, 0]
    for k in range(len(texts)):
        one = simhash.fingerprints(pa.array(texts[k : k + 1], pa.string()))
        assert [x[0] for x in one] == [x[k] for x in whole]


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["Some words, some more words " * 50, "x" * 3000 + " y"])
    want = common.Words(texts).hash.tolist()
    monkeypatch.setattr(common, "SLICE", 64)
    assert common.Words(texts).hash.tolist() == want


def test_simhash_odd_rows(spark):
    long = " ".join(f"word{k}" for k in range(40_000))
    rows = [(1, "same text of words", 0), (2, "same text of words", 0), (2, "same text of words", 1), (3, None, 0), (4, "", 0), (None, "same text of words", 0), (5, long, 0), (6, long + " more", 0), (7, None, 0), (8, "alone here, quite different", 0), (8, "alone here, quite different", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id int")
    for name in ("n", "band", "_id", "_text", "_place", "h1", "a.b"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = {(r.doc_id, r.group_id, r.group_size) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (5, 5, 2), (6, 5, 2)}
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "7", "8", "None"]
    assert {v for r in rows for v in r[3:]} == {"mine"}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


# sharding


def test_shards_are_ordered_ranges_of_bounded_size(spark):
    rng = random.Random(3)
    rows = [(k, "x" * int(rng.paretovariate(1.2) * 20), "hot" if rng.random() < 0.6 else f"s{rng.randrange(6)}", 7) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    out = sharding.sharded(docs, target=6000)
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 3000 and out.columns == ["doc_id", "text", "source", "shard", "shard_"] and {r.shard for r in got} == {7}
    by = {}
    for r in got:
        by.setdefault(r.shard_, []).append(r)
    assert len({(r.shard_, r.part) for r in got}) == len(by) == len({r.part for r in got})
    order = sorted(by)
    key = lambda r: (r.source, r.doc_id)
    for a, b in zip(order, order[1:]):
        assert max(map(key, by[a])) < min(map(key, by[b]))
    sizes = {k: sum(len(r.text) + 1 for r in v) for k, v in by.items()}
    largest = max(len(r.text) for r in got)
    assert max(sizes.values()) <= max(1.5 * 6000, largest + 1)
    assert len(by) < 2.5 * sum(sizes.values()) / 6000


def test_range_numbers_equal_plain_comparison():
    rng = random.Random(6)
    keys, ids = [None, "", "a", "b", "ab", "é", "zz"], [None, -5, 0, 3, 2**62, -(2**63)]
    bounds = sorted({sharding._key(rng.choice(keys), rng.choice(ids)) for _ in range(14)})
    rows = [(k, i) for k in [*keys, "c"] for i in [*ids, 1, -(2**62)]]
    rng.shuffle(rows)
    got = sharding.Bounds(bounds).number(pd.Series([k for k, _ in rows], dtype=object), pd.Series([i for _, i in rows], dtype="Int64"))
    assert got.tolist() == [sum(b <= sharding._key(k, i) for b in bounds) for k, i in rows]


def test_quantiles_equal_a_plain_count():
    rng = random.Random(8)
    for _ in range(200):
        n = np.array([rng.choice([1, 1, 2, 3, 30]) for _ in range(rng.randint(1, 40))])
        parts, total = rng.randint(1, 12), int(n.sum())
        points = [int(np.floor(total * q / parts)) if (total * q) % parts == 0 else total * q / parts for q in range(parts)]
        cum = np.cumsum(n)
        holds = [sum(c - k <= x < c for x in points) for c, k in zip(cum, n)]
        want = [h > 0 or (r > 0 and holds[r - 1] > 1) for r, h in enumerate(holds)]
        assert sharding._quantiles(n, 0, total, parts)[0].tolist() == want
        cut = rng.randint(0, len(n))  # the same from two pieces
        first, wide = sharding._quantiles(n[:cut], 0, total, parts)
        second, _ = sharding._quantiles(n[cut:], int(n[:cut].sum()), total, parts, wide)
        assert [*first.tolist(), *second.tolist()] == want


def test_sharding_odd_rows(spark):
    rows = [(1, "a" * 100_000, "s"), (1, "a", "s"), (1, "a", "s"), (None, "b", None), (2, None, "s"), (3, "", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_x", F.lit(1)).withColumn("_key", F.lit("mine")).withColumn("_id", F.lit("mine")).withColumn("_size", F.lit("mine")).withColumn("a.b", F.lit("mine"))
    out = sharding.sharded(docs, target=50)
    assert out.columns == [*docs.columns, "shard"]
    got = out.collect()
    assert len(got) == 7 and {(r["_key"], r["_id"], r["_size"], r["a.b"]) for r in got} == {("mine",) * 4}
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.sharded(docs.limit(0)).count() == 0
    assert len({r.shard for r in sharding.sharded(docs.select("text")).collect()}) == 1


@pytest.mark.parametrize("rows", [[(None, k, 100) for k in range(200)], [(f"s{k}", None, 100) for k in range(200)], [("s", k, 1) for k in range(4000)]])
def test_overfull_ranges_are_subdivided_whatever_the_first_sample(spark, monkeypatch, rows):
    monkeypatch.setattr(sharding, "_first_bounds", lambda sizes, step, parts: [])
    sizes = spark.createDataFrame(rows, "_key string, _id long, _size long")
    total = sum(r[2] for r in rows)
    target = total // 10
    bounds = sharding.boundaries(sizes, target=target)
    number = sharding.Bounds(bounds).number(pd.Series([r[0] for r in rows], dtype=object), pd.Series([r[1] for r in rows], dtype="Int64"))
    assert np.bincount(number, [r[2] for r in rows]).max() <= 1.5 * target


def test_shards_grow_beyond_their_greatest_number(spark):
    sizes = spark.createDataFrame([(f"s{k % 3}", k, 10) for k in range(1000)], "_key string, _id long, _size long")
    assert 3 <= len(sharding.boundaries(sizes, target=10, max_shards=5)) <= 9


# top-k


def brute_nearest(ids, x, k):
    out = set()
    for i, v in zip(ids, x):
        d = ((x.astype(float) - v.astype(float)) ** 2).sum(1)
        best = sorted((dd, j) for dd, j in zip(d, ids) if j != i)[:k]
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_nearest_equals_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 40))
    x = np.round(centres[rng.integers(0, 8, 300)] + spread * rng.normal(size=(300, 40)), 2).astype(np.float32)
    x[50:60] = x[40:50]  # ties
    ids = rng.permutation(1000)[:300].tolist()
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int")
    got = topk.nearest(table, k=7, query=F.lit(True), queries=64, candidates=128).collect()
    want = brute_nearest(ids, x, 7)
    assert {(r.vec_id, r.rank, r.neighbour_id) for r in got} == want and len(got) == 2100
    some = topk.nearest(table, k=7, query=F.col("id") % 7 == 0, queries=16, candidates=50).collect()
    assert {(r.vec_id, r.rank, r.neighbour_id) for r in some} == {w for w in want if w[0] % 7 == 0} and len(some) == 7 * sum(i % 7 == 0 for i in ids)
    default = topk.nearest(table).collect()
    assert {r.vec_id for r in default} == {i for i in ids if i % 100 == 0}


@pytest.mark.parametrize(("offset", "scale"), [(0, 1), (1e7, 1), (-3e9, 10), (0, 1e20), (0, 1e-20), (1e3, 1e-3)])
def test_search_is_exact_wherever_the_vectors_lie(offset, scale):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 24))
    x = (centres[rng.integers(0, 5, 700)] + 0.3 * rng.normal(size=(700, 24))) * scale + offset
    x[:, 3] *= 100
    ids = np.arange(700)
    stats = {}
    i, j, d = topk.search(x[:90], ids[:90], x, ids, 5, dim_block=5, rows=16, tile=60, stats=stats)
    for k in range(90):
        all_d = ((x - x[k]) ** 2).sum(1)
        want = [v for v in np.lexsort((ids, all_d)).tolist() if v != k][:5]
        assert j[i == k].tolist() == want
    if scale == 1 and offset == 0:
        assert stats["reached"][-1] < 0.7 * stats["pairs"]


def test_repeated_ids_take_one_place_each():
    x = np.array([[0.0], [1.0], [1.1], [1.2], [3.0], [4.0]])
    xid = np.array([0, 1, 1, 1, 2, 3])
    i, j, d = topk.search(x[:1], xid[:1], x, xid, 2)
    assert xid[j].tolist() == [1, 2] and d.tolist() == [1.0, 9.0]


def test_topk_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None), (6, []), (7, [None, 1.0]), (None, [1.0, 2.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [0.0, float("-inf")])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("dim", F.lit("x")).withColumn("a.b", F.lit("x"))
    got = sorted((r.vec_id, r.rank, r.neighbour_id) for r in topk.nearest(table, k=5, query=F.lit(True)).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 2, 2)]
    assert topk.nearest(table.limit(0)).count() == 0


# pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    # the classifier on rows of its own
    both = docs.merge(labels.dropna(), on="doc_id").sort_values("doc_id")
    at, idx, val, _ = quality.features(*(pa.array(both[c]) for c in ("text", "lang", "source")))
    model = quality.Machine().fit(at, idx, val, both.quality.to_numpy(np.float32))
    p = model.scores(*(pa.array(docs[c]) for c in ("text", "lang", "source")))
    want = docs[p >= 0.5]
    first = pipeline.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert first.columns == docs.columns.tolist()
    assert sorted(r.doc_id for r in first.select("doc_id").collect()) == sorted(want.doc_id)
    # one of each group of near pairs
    h1, h2, n = simhash.fingerprints(pa.array(want.text))
    ids = want.doc_id.to_numpy()
    keep = {ids[k] for k in range(len(ids))}
    roots = union([(ids[i], ids[j]) for (i, j) in brute_pairs(np.stack([h1, h2], 1), n, simhash.RADIUS, simhash.RATIO) if n[i] and n[j]])
    keep -= {k for k, r in roots.items() if k != r}
    want = want[want.doc_id.isin(keep)]
    # no benchmark item, as exact word sequence or nearly so
    from tests.llm.test_matching import brute_contaminated

    dirty = {d for d, _ in brute_contaminated(list(zip(want.doc_id, want.text)), list(zip(bench.item_id, bench.text)), decontam.SHINGLE, decontam.CONTAINMENT)}
    want = want[~want.doc_id.isin(dirty)].sort_values("doc_id")
    texts = [secrets.redact(t, secrets.scan(t)) for t in want.text]
    at, lens = packing.sentence_lengths(pa.array(texts))
    rows, place = [], 0
    for pieces in packing.pack([lens[at[i] : at[i + 1]] for i in range(len(texts))]):
        rows.append((place, [int(want.doc_id.iloc[d]) for d, _, _ in pieces], [a for _, a, _ in pieces], [b for _, _, b in pieces]))
        place += sum(b - a for _, a, b in pieces)
    got = pipeline.run(spark, SF)
    assert sorted((r.first_word, r.doc_ids, r.first_words, r.end_words) for r in got.collect()) == rows
    assert [len(s) for s in pipeline.STAGES] == [2] * 5 and pipeline.ORACLE_SQL is None


def test_stages_keep_columns_and_take_odd_tables(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "plain words in a row", "en", "s", 20), (1, "plain words in a row", "en", "s", 20), (None, None, None, None, None), (2, "", "en", "s", 0)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).count()
        pipeline.STAGES[-1][1](spark, docs, SF).count()
