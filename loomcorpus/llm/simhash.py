"""SimHash near-duplicates: 128-bit fingerprints, searched exactly through vantage-point trees.

A document's features are its distinct words of more than three bytes (all its words where it has no such word). Two
documents are near duplicates if their fingerprints differ in at most RADIUS bits and their feature counts by a factor
of at most RATIO. Equal fingerprints are one node; only nodes are compared.

* Nodes are cut into bands by the logarithm of their feature count, as wide as the largest allowed difference: a node need
  only meet its own band and the next.
* Each band has a vantage-point tree. A tree's node has a vantage fingerprint of its own, chosen among some of the band for how well
  it parts the others, and a Hamming distance: what lies within it goes inside, the rest outside. A query visits
  the inside if its own distance is at most that plus RADIUS, the outside if it is more than that minus RADIUS
  (triangle inequality), so near a boundary it visits both.
* The tree's upper levels make shards of about SHARD nodes, whatever the band's size; they are laid out on the driver from at most SAMPLE
  nodes of the band (where the boundaries lie changes costs, never results). A shard's queries are cut into parts of about as many, and
  each (band, shard, part) is a task. Within it the tree goes on down to LEAF nodes.
* In a leaf, nodes lie sorted by feature count, and blocks of queries meet only their window.

Every pair within the radius is seen once, counted for both its nodes, and kept as an edge if it joins two trees of the task's
forest; edges give the connected components. See the README for how much triangle bounds prune at this radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, column, discard, field, materialise, mix, numbered, tune

RADIUS, RATIO = 24, 1.25
#: Pairs of a block, which stay in the cache.
BLOCK = 1 << 16
#: Nodes of a shard and queries of a part, about; nodes of a leaf; nodes of a band that its upper levels are laid out from.
SHARD, LEAF, SAMPLE = 1 << 17, 1024, 4096


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 64 bits, last 64 bits, number of features) of each text; a text without words has 0 features."""
    w = Words(texts)
    n = len(texts)
    long_words = w.length > 3
    has_long = np.bincount(w.doc[long_words], minlength=n) > 0
    use = long_words | ~has_long[w.doc]
    doc, h = w.doc[use], w.hash[use]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[first], h[first]
    at = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(at)
    ones = np.zeros((n, 128), np.int64)
    some = np.flatnonzero(count)
    step = 1 << 14
    for a in range(0, len(h), step):  # a slice of words at a time: 128 bytes for each
        b = min(len(h), a + step)
        bits = np.unpackbits(np.stack([mix(h[a:b], 1), mix(h[a:b], 2)], 1).astype(">u8").view(np.uint8), axis=1)
        i, j = np.searchsorted(some, doc[a]), np.searchsorted(some, doc[b - 1], "right")
        ones[some[i:j]] += np.add.reduceat(bits, np.maximum(at[some[i:j]], a) - a, axis=0, dtype=np.uint16)
    # an even split goes by the first feature's bit of a fixed pattern, here: to 1 at odd places
    twice = 2 * ones - count[:, None]
    out = np.packbits((twice > 0) | ((twice == 0) & (np.arange(128) % 2 == 1)), axis=1).view(">u8").astype(np.uint64)
    return out[:, 0], out[:, 1], count


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n) of the rows with a doc_id and at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, n = fingerprints(b["text"])
            ok = n > 0
            yield pa.record_batch({"doc_id": b["doc_id"].filter(pa.array(ok)), "h1": h1[ok].view(np.int64), "h2": h2[ok].view(np.int64), "n": n[ok].astype(np.int32)})

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, h1 long, h2 long, n int")


def distance(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (two words each) from one."""
    return np.bitwise_count(h[:, 0] ^ v[0]).astype(np.int16) + np.bitwise_count(h[:, 1] ^ v[1])


def vantage(h: np.ndarray, radius: int, tries: int = 6, among: int = 512) -> tuple[np.ndarray, int] | None:
    """(vantage fingerprint, distance) that part some fingerprints best: the fewest that both sides have to be asked about, and even sides; None if all are alike."""
    rng = np.random.default_rng(len(h))
    some = h if len(h) <= among else h[rng.choice(len(h), among, replace=False)]
    best = None
    for k in rng.choice(len(some), min(tries, len(some)), replace=False):
        d = np.sort(distance(some, some[k]))
        for mu in np.unique(d[[len(d) // 4, len(d) // 2, 3 * len(d) // 4]]).tolist():
            inside = np.searchsorted(d, mu, "right") / len(d)
            if inside == 1:
                mu = int(d[np.searchsorted(d, mu, "left") - 1]) if d[0] < mu else mu
                inside = np.searchsorted(d, mu, "right") / len(d)
                if inside == 1:
                    continue
            both = (np.searchsorted(d, mu + radius, "right") - np.searchsorted(d, mu - radius, "right")) / len(d)
            cost = both + abs(inside - 0.5)
            if best is None or cost < best[0]:
                best = cost, some[k].copy(), mu
    return best[1:] if best else None


class Tree:
    """The upper levels of a band's tree, as parallel arrays; a leaf has no children and a number."""

    def __init__(self, h: np.ndarray, shards: int, radius: int) -> None:
        self.radius = radius
        self.at: list[np.ndarray] = []
        self.mu: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self.number: list[int] = []
        self.leaves = 0
        self._grow(h, shards)

    def _grow(self, h: np.ndarray, shards: int) -> int:
        me = len(self.at)
        cut = vantage(h, self.radius) if shards > 1 and len(h) > 1 else None
        self.at.append(cut[0] if cut else np.zeros(2, np.uint64))
        self.mu.append(cut[1] if cut else 0)
        self.children.append(None)
        self.number.append(-1)
        if cut is None:
            self.number[me] = self.leaves
            self.leaves += 1
            return me
        inside = distance(h, cut[0]) <= cut[1]
        share = max(1, round(shards * inside.mean()))
        self.children[me] = self._grow(h[inside], share), self._grow(h[~inside], max(1, shards - share))
        return me

    def visits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether it is the row's own) of all shards that each fingerprint has to visit."""
        out = []
        todo = [(0, np.arange(len(h)), np.ones(len(h), bool))]
        while todo:
            k, rows, own = todo.pop()
            if not len(rows):
                continue
            if self.children[k] is None:
                out.append((rows, np.full(len(rows), self.number[k]), own))
                continue
            d = distance(h[rows], self.at[k])
            inside, outside = d <= self.mu[k] + self.radius, d > self.mu[k] - self.radius
            todo += [(self.children[k][0], rows[inside], own[inside] & (d[inside] <= self.mu[k])), (self.children[k][1], rows[outside], own[outside] & (d[outside] > self.mu[k]))]
        return tuple(np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.zeros(0, np.int64),) * 3


def band_of(n: np.ndarray, ratio: float) -> np.ndarray:
    return np.floor(np.log(n) / np.log(ratio)).astype(np.int64)


def lay_out(nodes: DataFrame, radius: int, ratio: float, shard: int, sample: int) -> tuple[dict[int, Tree], dict[int, int]]:
    """(tree, parts) of each band."""
    sizes = {r.band: r.c for r in nodes.groupBy("band").agg(F.count("*").alias("c")).collect()}  # a number for each band: some dozens
    trees = {b: Tree(np.zeros((0, 2), np.uint64), 1, radius) for b in sizes}
    if large := [b for b, c in sizes.items() if c > shard]:
        first = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("id"), "id"))
        some = nodes.filter(F.col("band").isin(large)).withColumn("r", first).filter(F.col("r") <= sample).select("band", "h1", "h2").toPandas()  # at most `sample` of each band
        for b, g in some.groupby("band"):
            trees[int(b)] = Tree(g[["h1", "h2"]].to_numpy(np.int64).view(np.uint64), -(-sizes[b] // shard), radius)
    return trees, {b: -(-(c + sizes.get(b - 1, 0)) // shard) for b, c in sizes.items()}


def placed(nodes: DataFrame, radius: int, ratio: float, shard: int, sample: int) -> DataFrame:
    """nodes (id, h1, h2, n, w) as (band, shard, part, home, own, id, h1, h2, n, w): a home row in each part of its shard, and a row for each visit."""
    nodes = nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(ratio)))).cast("int"))
    trees, parts = lay_out(nodes, radius, ratio, shard, sample)
    sent = nodes.sparkSession.sparkContext.broadcast((trees, parts))  # a few numbers for each shard
    names = ["id", "h1", "h2", "n", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, parts = sent.value
        for b in batches:
            h = np.stack([b["h1"].to_numpy(), b["h2"].to_numpy()], 1).view(np.uint64)
            band, salt = b["band"].to_numpy(), mix(b["id"].to_numpy().view(np.uint64), 5)
            out: list[tuple[np.ndarray, ...]] = []
            for t in np.unique(np.concatenate([band, band + 1])).tolist():
                if t not in trees:
                    continue
                rows = np.flatnonzero((band == t) | (band == t - 1))
                at, number, own = trees[t].visits(h[rows])
                at = rows[at]
                own = own & (band[at] == t)
                # of two shards of one band only the fingerprints of the lower-numbered visit the other
                mine = np.full(len(h), -1)
                mine[at[own]] = number[own]
                asks = (band[at] != t) | (number >= mine[at])
                part = (salt[at] % np.uint64(parts[t])).astype(np.int64)
                out.append((at[asks], np.full(asks.sum(), t), number[asks], part[asks], np.zeros(asks.sum(), bool), own[asks]))
                home = np.repeat(np.flatnonzero(own), parts[t])
                out.append((at[home], np.full(len(home), t), number[home], np.tile(np.arange(parts[t]), own.sum()), np.ones(len(home), bool), np.ones(len(home), bool)))
            at, band_, shard_, part, home, own = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(6))
            cols = [pa.array(band_, pa.int32()), pa.array(shard_, pa.int32()), pa.array(part, pa.int32()), pa.array(home.astype(bool)), pa.array(own.astype(bool)), *(b[c].take(pa.array(at)) for c in names)]
            yield pa.RecordBatch.from_arrays(cols, names=["band", "shard", "part", "home", "own", *names])

    return nodes.mapInArrow(run, "band int, shard int, part int, home boolean, own boolean, id long, h1 long, h2 long, n int, w long")


def leaf_pairs(h: np.ndarray, n: np.ndarray, qh: np.ndarray, qn: np.ndarray, radius: int, ratio: float, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query number, home number, distance) within the radius; h and n sorted by n, as qh and qn."""
    if not len(h) or not len(qh):
        return
    h1, h2 = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
    q1, q2 = np.ascontiguousarray(qh[:, 0])[:, None], np.ascontiguousarray(qh[:, 1])[:, None]
    lows, highs = np.searchsorted(n, qn / ratio - 1e-9), np.searchsorted(n, qn * ratio + 1e-9, "right")
    words, first, second = np.empty(max(BLOCK, len(h)), np.uint64), *(np.empty(max(BLOCK, len(h)), np.uint8) for _ in range(2))
    a = 0
    while a < len(qh):
        lo = int(lows[a])
        # as many queries as fit: their windows overlap, since they are sorted
        b = a + max(1, min(len(qh) - a, BLOCK // max(1, int(highs[a]) - lo)))
        while b > a + 1 and (b - a) * (int(highs[b - 1]) - lo) > len(words):
            b -= 1
        hi = int(highs[b - 1])
        if lo < hi:
            size = (b - a) * (hi - lo)
            x, d1, d2 = (v[:size].reshape(b - a, -1) for v in (words, first, second))
            np.bitwise_count(np.bitwise_xor(h1[lo:hi], q1[a:b], out=x), out=d1)
            np.bitwise_count(np.bitwise_xor(h2[lo:hi], q2[a:b], out=x), out=d2)
            d1 += d2
            if stats is not None:
                stats["distances"] = stats.get("distances", 0) + size
            if d1.min() <= radius:
                i, j = np.divmod(np.flatnonzero(first[:size] <= radius), hi - lo)
                d, m = d1[i, j].astype(np.int64), qn[a:b]
                big, small = np.maximum(m[i], n[lo + j]), np.minimum(m[i], n[lo + j])
                ok = big <= small * ratio + 1e-9
                if ok.any():
                    yield a + i[ok], lo + j[ok], d[ok]
        a = b


def tree_pairs(h: np.ndarray, n: np.ndarray, qh: np.ndarray, qn: np.ndarray, radius: int, ratio: float, leaf: int = LEAF, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """leaf_pairs through a vantage-point tree over the home rows."""
    todo = [(np.arange(len(h)), np.arange(len(qh)), 0)]
    while todo:
        rows, queries, depth = todo.pop()
        if stats is not None:
            stats["depth"] = max(stats.get("depth", 0), depth)
        cut = vantage(h[rows], radius) if len(rows) > leaf and len(queries) else None
        if cut is None:
            for i, j, d in leaf_pairs(h[rows], n[rows], qh[queries], qn[queries], radius, ratio, stats):
                yield queries[i], rows[j], d
            continue
        d, dq = distance(h[rows], cut[0]), distance(qh[queries], cut[0])
        if stats is not None:
            stats["distances"] = stats.get("distances", 0) + len(d) + len(dq)
        inside = d <= cut[1]
        todo += [(rows[inside], queries[dq <= cut[1] + radius], depth + 1), (rows[~inside], queries[dq > cut[1] - radius], depth + 1)]


class Forest:
    """Trees of numbered nodes; keeps of the pairs only those that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, a: np.ndarray) -> np.ndarray:
        root = self.parent[a]
        while True:
            up = self.parent[root]
            if (up == root).all():
                self.parent[a] = root
                return root
            root = up

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        kept = []
        while True:
            ra, rb = self.find(a), self.find(b)
            live = np.flatnonzero(ra != rb)
            if not len(live):
                return kept
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            # hang each larger root under the smallest that it meets; one pair for each larger root
            big, small = np.maximum(ra, rb), np.minimum(ra, rb)
            order = np.lexsort((small, big))
            first = order[np.concatenate([[True], big[order][1:] != big[order][:-1]])]
            kept += [(int(a[k]), int(b[k])) for k in first]
            self.parent[big[first]] = small[first]


def near_pairs(nodes: DataFrame, radius: int = RADIUS, ratio: float = RATIO, shard: int = SHARD, leaf: int = LEAF, sample: int = SAMPLE, forest: bool = False) -> DataFrame:
    """All pairs (a, b, distance, links), a < b, of nodes (id, h1, h2, n, w) that are near; links is null.

    forest: of each task's pairs only as many as keep its connected nodes connected, and for each node a row (a, null, null, links): the
    weight w of the nodes near it that the task saw; a node's sum over all its rows is that of all nodes near it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"])
        ids, n, w = pdf["id"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
        home, own = pdf["home"].to_numpy(bool), pdf["own"].to_numpy(bool)
        h = pdf[["h1", "h2"]].to_numpy(np.int64).view(np.uint64)
        here, asks = np.flatnonzero(home), np.flatnonzero(~home)
        node, first, number = np.unique(ids, return_index=True, return_inverse=True)  # a node may be here twice
        trees, links = Forest(len(node)), np.zeros(len(node), np.int64)
        out: list[tuple] = []
        for i, j, d in tree_pairs(h[here], n[here], h[asks], n[asks], radius, ratio, leaf):
            i, j = asks[i], here[j]
            once = ~own[i] | (ids[i] < ids[j])  # both nodes of a pair in one shard ask there
            i, j, d = number[i[once]], number[j[once]], d[once]
            if forest:
                links += np.bincount(i, w[first[j]], len(node)).astype(np.int64) + np.bincount(j, w[first[i]], len(node)).astype(np.int64)
                kept = trees.add(i, j)
                if kept:
                    k = np.array(kept)
                    x = h[first[k[:, 0]]] ^ h[first[k[:, 1]]]
                    out.append((node[k[:, 0]], node[k[:, 1]], np.bitwise_count(x).sum(1)))
            else:
                out.append((node[i], node[j], d))
        a, b, d = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d}, dtype="Int64")
        some = np.flatnonzero(links)
        return pd.concat([pairs, pd.DataFrame({"a": node[some], "links": links[some]}, dtype="Int64")]).reindex(columns=["a", "b", "distance", "links"])

    return placed(nodes, radius, ratio, shard, sample).groupBy("band", "shard", "part").applyInPandas(run, "a long, b long, distance int, links long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component, for the ids of edges (a, b).

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared folder.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, e = e, materialise(small, "edges")
        discard(before)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(now) == state:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        state = tuple(now)


def grouped(docs: DataFrame, radius: int = RADIUS, ratio: float = RATIO, shard: int = SHARD) -> DataFrame:
    """(doc_id, group_id, group_size, n_links) of each distinct doc_id in a group of at least two ids; see near_duplicates."""
    tune(docs.sparkSession)
    prints = materialise(fingerprint_table(docs), "fingerprints")
    # a doc_id with several texts may be the smallest of several fingerprints: nodes are numbered by fingerprint
    members = materialise(prints.distinct().select(F.xxhash64("h1", "h2", "n").alias("id"), "doc_id", "h1", "h2", "n"), "members")
    discard(prints)
    nodes = materialise(members.groupBy("id", "h1", "h2", "n").agg(F.count("*").alias("w")), "nodes")
    found = materialise(near_pairs(nodes, radius, ratio, shard, forest=True), "pairs")
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    facts = nodes.select("id", "w").join(roots, "id", "left").join(links, "id", "left").select("id", F.coalesce("root", "id").alias("root"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links")).filter("links > 0")
    facts = materialise(facts, "groups")
    rows = members.select("id", "doc_id").join(facts, "id").groupBy("root", "doc_id").agg(F.sum("links").alias("n_links"))
    # a group's name is its smallest doc_id; groups of one id are no groups
    size = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    # a doc_id with several texts may be in several groups
    return rows.join(size, "root").groupBy("doc_id", "group_id", "group_size").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_id, group_id, group_size, n_links) of every document that has a near duplicate, itself included.

    group_id is the smallest doc_id of its connected component; n_links is the number of documents linked to it directly, those of the same
    fingerprint and those of fingerprints near it, each counted. Copies aren't spelled out as pairs, but no link is left out of the
    groups or counts. Rows with a null doc_id, a null text or a text without words are in no group. Rows that repeat one doc_id and
    text count once; a doc_id with several texts counts with each. Texts of any length are read whole. An empty table gives an
    empty result. Other columns don't matter.
    """
    return grouped(docs, radius, ratio)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """docs without the members of near-duplicate groups other than the one with the smallest doc_id.

    Rows with a null doc_id or a text without words stay. Of rows that repeat one doc_id one row stays, if the id is kept
    (the first by text). Null doc_ids are never compared. Columns are those of docs, and none is changed, whatever its name.
    """
    plain = numbered(docs)
    names = plain.columns
    keyed = plain.withColumns({"_id": field(docs, "doc_id", "long"), "_text": field(docs, "text", "string")})
    drop = grouped(docs, radius, ratio).filter("doc_id <> group_id").select(F.col("doc_id").alias("_id")).distinct()
    again = materialise(keyed.filter("_id IS NOT NULL").groupBy("_id").count().filter("count > 1").select("_id"), "again")
    kept = keyed.join(drop, "_id", "left_anti")
    if again.isEmpty():
        return kept.select(*names).toDF(*docs.columns)
    order = Window.partitionBy("_id").orderBy(F.col("_text").asc_nulls_last())
    once = kept.join(again, "_id", "left_semi").withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return kept.join(again, "_id", "left_anti").select(*names).unionByName(once.select(*names)).toDF(*docs.columns)
