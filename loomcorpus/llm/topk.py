"""Exact top-k search: columnar branch and bound over blocks of dimensions.

Queries are the rows whose id a condition names; each is compared with all rows. Vectors lie vertically (a row of memory for
each dimension), dimensions of greatest variance first, about the mean of their block, which leaves distances as they are.
Candidates come in tiles. In a tile squared distances accumulate block by block; after each,
|q - x|^2 >= sum so far + (|rest of q| - |rest of x|)^2 by the mass of the dimensions that remain, so a pair whose bound exceeds
the query's k-th best so far goes. Columns that no query of the group needs are compacted away; once few pairs are left they
are compacted to a list of pairs. Distances of the survivors are summed in double precision in the vectors' own order.
Queries lie in order of their angle to each other, so that those of a group lose the same columns.

Queries and candidates are cut into blocks of bounded size; each pair of blocks is a task, and a query's lists are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, tune

K, DIM_BLOCK = 10, 16
#: Vectors of a query block and of a candidate block.
QUERIES, CANDIDATES = 2048, 16384
#: Queries of a group and candidates of a tile, which are worked on together.
GROUP, TILE = 64, 2048
#: Queries are the rows whose id this number divides.
EVERY = 100


def _alike(q: np.ndarray) -> np.ndarray:
    """An order of the rows in which neighbours are alike: by the sign pattern, then the place, along the directions of greatest variance."""
    if len(q) < 2:
        return np.arange(len(q))
    y = q - q.mean(0)
    _, axes = np.linalg.eigh(y.T @ y)
    p = y @ axes[:, : -5 if q.shape[1] > 4 else None : -1]
    return np.lexsort((p[:, 0], *((p > 0).T)[::-1]))


def search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, dim_block: int = DIM_BLOCK, rows: int = GROUP, tile: int = TILE, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, squared distance): for each query its k nearest candidate ids other than its own; ties by id.

    Of candidates that repeat an id the nearest counts. stats, if given, gets the pairs that reached each block of dimensions.
    """
    dims = q.shape[1]
    whole_q, whole_x = np.asarray(q, np.float64), np.asarray(x, np.float64)
    repeated = len(np.unique(xid)) < len(xid)
    centre = whole_x.mean(0) if len(x) else np.zeros(dims)
    order = np.argsort(-whole_x.var(axis=0), kind="stable") if len(x) else np.arange(dims)
    q, x = (whole_q - centre)[:, order], (whole_x - centre)[:, order].T
    # bounds are computed in single precision, of vectors scaled to at most 1; what they can be off is added to the limits
    size = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) or 1.0
    q, x = np.ascontiguousarray(q / size, np.float32), np.ascontiguousarray(x / size, np.float32)
    cuts = [*range(0, dims, dim_block), dims]
    mass_q = np.stack([(q[:, c:].astype(float) ** 2).sum(1) for c in cuts], 0)
    mass_x = np.stack([(x[c:].astype(float) ** 2).sum(0) for c in cuts], 0)
    rest_q, rest_x = np.sqrt(mass_q).astype(np.float32), np.sqrt(mass_x).astype(np.float32)
    eps = float(np.finfo(np.float32).eps)
    shift = 16 * np.finfo(np.float64).eps * np.sqrt(dims) * (np.abs(centre).max(initial=0) / size + 1)
    all_x = mass_x[0].astype(np.float32)

    def most_of(limit: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
        """What a bound of each query may be at most, |q|^2 taken off; largest: the largest |x| of the candidates."""
        norm = np.sqrt(mass_q[0, rows])
        off = eps * (norm + largest) + shift  # of a distance, for rounded coordinates
        d = np.minimum(limit / size**2, 64.0 * dims)
        return np.where(np.isfinite(limit), d + 2 * off * np.sqrt(d) + off**2 + 2 * (dims + 8) * eps * (norm + largest) ** 2 - mass_q[0, rows], np.inf).astype(np.float32)

    reached = [0] * (len(cuts) - 1)
    doubled = -2 * x
    share = np.zeros(len(cuts) - 1)  # of the pairs that last came to a block's bound, those that it left
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    similar = _alike(q)
    for a in range(0, len(q), rows):
        mine = similar[a : a + rows]
        n = len(mine)
        limit = np.full(n, np.inf)
        best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for number, t in enumerate(range(0, len(xid), tile)):
            alive = np.arange(t, min(t + tile, len(xid)))
            # sum so far + (rest of q - rest of x)^2 = |q|^2 + |x|^2 - 2 (products so far) - 2 |rest of q| |rest of x|
            part = np.zeros((n, len(alive)), np.float32)
            largest = float(np.sqrt(mass_x[0, alive].max()))
            most = most_of(limit, mine, largest)
            i = j = None
            done = 0
            for b in range(len(cuts) - 1):
                hi = cuts[b + 1]
                if i is None:
                    reached[b] += part.size
                    # a bound that left nearly all is tried again at every eighth tile only
                    if b + 2 < len(cuts) and (not np.isfinite(limit).any() or share[b] > 0.9 and number % 8):
                        continue
                    part += q[mine, done:hi] @ (doubled[done:hi, alive[0] : alive[-1] + 1] if len(alive) == alive[-1] - alive[0] + 1 else doubled[done:hi, alive])
                    done = hi
                    if not np.isfinite(limit).any():
                        continue
                    low = rest_q[b + 1, mine, None] * (-2 * rest_x[b + 1, alive])
                    low += part
                    low += all_x[alive]
                    keep = low <= most[:, None]
                    left = np.count_nonzero(keep)
                    share[b] = left / keep.size
                    if share[b] < 0.04:
                        i, c = np.divmod(np.flatnonzero(keep), keep.shape[1])
                        j, part = alive[c], part[i, c]
                        if not left:
                            break
                    elif share[b] < 0.5 and (some := keep.any(axis=0)).mean() < 0.8:
                        alive, part = alive[some], part[:, some]
                else:
                    reached[b] += len(i)
                    part = part - 2 * (q[mine[i], done:hi] * x[done:hi, j].T).sum(1)
                    done = hi
                    keep = part - 2 * rest_q[b + 1, mine[i]] * rest_x[b + 1, j] + all_x[j] <= most[i]
                    i, j, part = i[keep], j[keep], part[keep]
            if i is None:
                part += all_x[alive]
                # of each query, those that its k-th best of this tile lets through (with repeated ids: all)
                if not repeated and part.shape[1] > k + 1:
                    own = (np.partition(part, k, axis=1)[:, k] + mass_q[0, mine]).clip(0) * size**2
                    own = most_of(np.minimum(limit, own * (1 + 1e-5)), mine, largest)
                    i, c = np.nonzero(part <= (own + 2 * (dims + 8) * eps * (np.sqrt(mass_q[0, mine]) + largest) ** 2)[:, None])
                else:
                    i, c = np.nonzero(np.ones(part.shape, bool))
                j = alive[c]
            other = qid[mine[i]] != xid[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            d = np.empty(len(i))
            for s in range(0, len(i), 1 << 14):
                d[s : s + (1 << 14)] = ((whole_q[mine[i[s : s + (1 << 14)]]] - whole_x[j[s : s + (1 << 14)]]) ** 2).sum(1)
            i, j, d = (np.concatenate([u, v]) for u, v in zip(best, (i, j, d)))
            place = np.lexsort((xid[j], d, i))
            if repeated:  # of one id, the nearest
                pair = np.stack([i[place], xid[j[place]]], 1)
                _, first = np.unique(pair, axis=0, return_index=True)
                place = place[np.sort(first)]
            i, j, d = i[place], j[place], d[place]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            best = tuple(u[rank < k] for u in (i, j, d))
            full = rank == k - 1
            limit[i[full]] = d[full]
        out.append((mine[best[0]], best[1], best[2]))
    if stats is not None:
        stats["pairs"] = stats.get("pairs", 0) + len(q) * len(xid)
        stats["reached"] = [u + v for u, v in zip(stats.get("reached", [0] * len(reached)), reached)]
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


def nearest(vectors: DataFrame, k: int = K, query: Column | None = None, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): for each query its k nearest rows of another vec_id, by Euclidean distance, ties by id.

    query: which rows are queries, in terms of `id`; by default those whose id EVERY divides. All rows are candidates.
    Rows with a null id or vector, an empty vector, or one that holds a null, a NaN or an infinity are left out. Vectors are
    compared with those of the same length only. Rows that repeat an id and a vector count once; of several vectors of one id
    the nearest counts, for a query as for a neighbour. With fewer than k others, all of them are listed. An empty table gives an
    empty result. Other columns don't matter.
    """
    tune(vectors.sparkSession)
    query = F.col("id") % EVERY == 0 if query is None else query
    # single-precision vectors travel as they are; sums are in double precision
    kind = "array<float>" if dict(vectors.dtypes).get("embedding") == "array<float>" else "array<double>"
    rows = vectors.select(column(vectors, "vec_id", "long").alias("id"), column(vectors, "embedding", kind).alias("e"))
    good = "id IS NOT NULL AND size(e) > 0 AND NOT exists(e, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
    rows = rows.filter(good).withColumn("dim", F.size("e"))
    # which lengths there are and how often: a handful of numbers
    counts = rows.agg(F.count("*").alias("x"), F.count(F.when(query, 1)).alias("q")).first()
    gq, gx = max(1, -(-counts["q"] // queries)), max(1, -(-counts["x"] // candidates))
    h = F.xxhash64("id", F.lit(5))
    all_q, all_x = F.sequence(F.lit(0), F.lit(gq - 1)), F.sequence(F.lit(0), F.lit(gx - 1))
    one_q, one_x = F.pmod(h, F.lit(gq)).cast("int"), F.pmod(h, F.lit(gx)).cast("int")
    as_query = rows.filter(query).select("dim", one_q.alias("cq"), F.explode(all_x).alias("cx"), F.lit(True).alias("query"), "id", "e")
    as_candidate = rows.select("dim", F.explode(all_q).alias("cq"), one_x.alias("cx"), F.lit(False).alias("query"), "id", "e")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        own, other = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"vec_id": [], "neighbour_id": [], "d": []})
        qid, xid = own["id"].to_numpy(), other["id"].to_numpy()
        i, j, d = search(np.stack(own["e"].tolist()), qid, np.stack(other["e"].tolist()), xid, k)
        return pd.DataFrame({"vec_id": qid[i], "neighbour_id": xid[j], "d": d})

    found = as_query.unionByName(as_candidate).groupBy("dim", "cq", "cx").applyInPandas(run, "vec_id long, neighbour_id long, d double")
    best = found.groupBy("vec_id", "neighbour_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "neighbour_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", F.sqrt("d").alias("distance"))
