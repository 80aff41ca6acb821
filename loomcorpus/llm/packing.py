"""Packing: cuts the ordered stream of documents into windows by dynamic programming.

Documents are taken in order of doc_id. Cuts may fall after a document, after a sentence, and, in a sentence longer than
a window, after each full window of it. A window costs its padding; a cut that ends a document's text early costs more:
SENTENCE_CUT at a sentence's end, HARD_CUT inside a sentence. With P the running length,

    cost(i) = pen(i) + L - P(i) + min { cost(j) + P(j) : j < i, P(i) - P(j) <= L },

a sliding-window minimum that a monotone queue yields in constant time for each cut. Nothing is dropped. Lengths are words
between white space.

The stream is one, whatever its ids are: it is sorted by ranges and cut into stretches of STRETCH words by running length,
which are tasks of one size. A stretch doesn't know where the best packing enters it, but that has a cut within any window's
length. So the programme runs from each cut of the stretch's first window at once, until from some place on all these runs agree
but for a constant; there all best packings have gone through one cut. What lies between the first and the last such cut of a
stretch is packed for good; what is left, a few windows around each seam, is packed in a second pass from the last such cut of one
stretch to the first of the next. The result costs what one programme over the whole stream does. In a stretch where the runs
never agree (as may be in texts of equal sentences that no document's end breaks) the stretch's first full window is
the seam's end, which costs at most one window more. The last stretch may be too short for its runs to agree; then it all belongs
to the seam before it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, materialise, raw, spans, tune

WINDOW, SENTENCE_CUT, HARD_CUT = 2048, 64, 512
#: Words of a stretch.
STRETCH = 1 << 22
#: Runs are compared at each so manieth cut; when so few are left, they go on one by one.
MEET, FEW = 64, 8

_TOKEN = np.ones(256, bool)
_TOKEN[[9, 10, 11, 12, 13, 32]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_NEWLINE = np.zeros(256, np.int64)
_NEWLINE[10] = 1


def sentence_lengths(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, words of each sentence). A sentence ends after a word that ends in . ! or ?, at a newline, and with the text."""
    data, off = raw(texts)
    starts, ends = spans(data, _TOKEN)
    if not len(starts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    after = np.add.reduceat(_NEWLINE[data], ends)  # from a word's end to the next word's end
    last = _STOP[data[ends - 1]] | (after > 0)  # a text ends in a newline
    stops = np.flatnonzero(last)
    at = np.searchsorted(starts[stops], off)
    return at, np.diff(np.concatenate([[-1], stops])).astype(np.int32)


def cuts_of(lengths: list[np.ndarray], window: int, sentence_cut: int, hard_cut: int, open_end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(running length, penalty) of each place where a cut may fall, the beginning included; open_end: the last document goes on."""
    if not lengths:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    lens = np.concatenate(lengths).astype(np.int64)
    last = np.cumsum([len(x) for x in lengths]) - 1
    penalty = np.full(len(lens), sentence_cut)
    penalty[last[[len(x) > 0 for x in lengths]]] = 0
    if open_end:
        penalty[-1] = sentence_cut
    inner = np.maximum((lens - 1) // window, 0)  # full windows of a sentence before its end
    end = np.cumsum(lens)
    number = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    place = np.concatenate([[0], end, np.repeat(end - lens, inner) + number * window])
    penalty = np.concatenate([[0], penalty, np.full(len(number), hard_cut)])
    order = np.argsort(place, kind="stable")
    return place[order], penalty[order]


def best_cuts(place: list[int], penalty: list[int], window: int, cost: list[int] | None = None, first: int = 0, low: int = 0) -> tuple[list[int], list[int]]:
    """(cost, cut before) of each cut. cost, if given, has the costs of the cuts from low to `first`, from which the programme goes on."""
    m = len(place)
    cost = [0] * m if cost is None else [*cost, *[0] * (m - len(cost))]
    back = [0] * m
    queue: deque[tuple[int, int]] = deque()  # (cost + place, cut), least first
    for i in range(low, m):
        p = place[i]
        if i > first:
            while p - place[queue[0][1]] > window:
                queue.popleft()
            g, back[i] = queue[0]
            cost[i] = penalty[i] + window - p + g
        g = cost[i] + p
        while queue and queue[-1][0] > g:
            queue.pop()
        queue.append((g, i))
    return cost, back


def pack(lengths: list[np.ndarray], window: int = WINDOW, sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, open_end: bool = False) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document number, first word, end word), of least total cost; of equal cuts the earlier one."""
    place, penalty = cuts_of(lengths, window, sentence_cut, hard_cut, open_end)
    _, back = best_cuts(place.tolist(), penalty.tolist(), window)
    cuts = []
    i = len(place) - 1
    while i > 0:
        cuts.append(i)
        i = back[i]
    return pieces(lengths, [0, *place[cuts[::-1]].tolist()])


def pieces(lengths: list[np.ndarray], at: list[int]) -> list[list[tuple[int, int, int]]]:
    """What of which document lies between each two neighbours of at, places in the stream."""
    ends = np.cumsum([int(x.sum()) for x in lengths], dtype=np.int64) if lengths else np.zeros(0, np.int64)
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    out = []
    for a, b in zip(at, at[1:]):
        part = []
        d = int(np.searchsorted(ends, a, "right"))
        while d < len(ends) and first[d] < b:
            if ends[d] > first[d]:
                part.append((d, int(max(a, first[d]) - first[d]), int(min(b, ends[d]) - first[d])))
            d += 1
        out.append(part)
    return out


def settled(place: np.ndarray, penalty: np.ndarray, window: int) -> tuple[list[int], bool]:
    """(cuts, sure) of a stretch that is entered nobody knows where: the cuts of the best packing that don't depend on what lies outside.

    sure: every best packing of the whole stream has these cuts. Otherwise there is one cut, chosen as the module says.
    """
    m = len(place)
    starts = int(np.searchsorted(place, place[0] + window, "right"))  # one of these cuts is in the best packing
    end = int(np.searchsorted(place, place[-1] - window, "left"))  # and one from here on
    reach = np.searchsorted(place, place - window, "left")  # the first cut from which each can be reached
    far = np.int64(1) << 50
    first_window = max(1, min(m - 1, int(np.searchsorted(place, place[0] + window, "right")) - 1))
    rows: list[np.ndarray | None] = []  # cost + place of each cut, for each run; runs that agree go on as one
    backs: list[np.ndarray] = []
    meet = max(1, min(MEET, m // 64))
    # least of rows[low:i], the earliest of equal ones: least of each rows[k:turn], and of rows[turn:i]
    turn, before = 0, {}
    since, since_at = np.full(starts, far), np.full(starts, -1)
    for i in range(m):
        g, best = np.full(len(since), far), np.full(len(since), -1)
        if i:
            low = int(reach[i])
            if low >= turn:
                least, least_at, before = g, best, {}
                for k in range(i - 1, low - 1, -1):
                    le = rows[k] <= least
                    least, least_at = np.where(le, rows[k], least), np.where(le, k, least_at)
                    before[k] = least, least_at
                turn, since, since_at = i, g.copy(), best.copy()
            least, least_at = before[low]
            less = since < least
            g, best = np.where(less, since, least) + (penalty[i] + window), np.where(less, since_at, least_at)
        if i < starts:  # a run that begins here, and none that begins later
            g[i:], best[i:] = far, -1
            g[i] = place[i]
        rows.append(g)
        backs.append(best)
        less = g < since
        since, since_at = np.where(less, g, since), np.where(less, i, since_at)
        if i % meet == 0 and reach[i] >= starts:
            low = int(reach[i])
            rows[:low] = [None] * low
            block = np.stack(rows[low:])
            _, some = np.unique(block - block[-1], axis=1, return_index=True)
            some.sort()
            if len(some) <= FEW:
                block = block[:, some]
                break
            if len(some) < block.shape[1]:
                rows[low:] = [r[some] for r in rows[low:]]
                before = {k: (v[some], at[some]) for k, (v, at) in before.items() if k >= low}
                since, since_at = since[some], since_at[some]
    else:  # the stretch ends before the runs are few
        return [first_window], False
    # the few runs that are left go on one by one to the end
    low, last = int(reach[i]), i
    known = [0] * low
    runs = [best_cuts(place.tolist(), penalty.tolist(), window, [*known, *(c - place[low : last + 1]).tolist()], last, low) for c in block.T]
    gaps = np.array([np.array(c[low:]) - np.array(runs[0][0][low:]) for c, _ in runs])
    change = np.concatenate([[0], np.where((gaps[:, 1:] != gaps[:, :-1]).any(0), np.arange(low + 1, m), 0)])
    quiet = np.flatnonzero(np.maximum.accumulate(change) <= reach[low:])
    quiet = quiet[quiet + low >= last]
    if not len(quiet):
        return [first_window], False
    agreed = low + int(quiet[0])  # the first cut by which all runs have agreed, but for constants, on all costs within reach
    back = runs[0][1]
    heads = set(range(max(end, agreed), m))
    while len(heads) > 1:  # the later goes back first, so what all ends share is found
        late = max(heads)
        if late <= agreed:
            return [first_window], False
        heads.remove(late)
        heads.add(back[late])
    at = heads.pop()
    if at <= agreed:
        return [first_window], False
    path = [at]
    while path[-1] > agreed:
        path.append(back[path[-1]])
    # further back each run has its own way; as long as all go together the cut is sure
    while True:
        way = {b[path[-1]] for _, b in runs} if path[-1] > last else set(backs[path[-1]].tolist())
        if len(way) > 1 or (node := way.pop()) < starts:
            break
        path.append(node)
    return path[::-1], True


def packed(docs: DataFrame, window: int = WINDOW, sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, stretch: int = STRETCH) -> DataFrame:
    """(first_word, doc_ids, first_words, end_words, n_words, padding): the windows, by the number of words in the stream before them, and the word ranges that fill them.

    Documents with a null, empty or blank text fill nothing. Null doc_ids come first. Repeated ids are packed each, in order of
    their number of sentences and text hash; repeated rows side by side. doc_id keeps its type, whatever it is. A text of any
    length is cut like any other. An empty table gives an empty result. Other columns don't matter.
    """
    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType if "doc_id" in docs.columns else T.LongType()
    ids = id_type.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lens = sentence_lengths(b["text"])
            yield pa.record_batch({"doc_id": b["doc_id"], "h": b["h"], "lens": pa.ListArray.from_arrays(at.astype(np.int32), pa.array(lens, pa.int32()))})

    rows = docs.select(column(docs, "doc_id", ids).alias("doc_id"), column(docs, "text", "string").alias("text")).filter("text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text")).mapInArrow(measure, f"doc_id {ids}, h long, lens array<int>").filter("size(lens) > 0")
    # u tells repeated rows apart, so that ranges can be cut between them; they are alike, so the result doesn't depend on it
    rows = materialise(rows.withColumn("u", F.monotonically_increasing_id()), "lengths")
    words = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
    key = [F.col("doc_id").asc_nulls_first(), F.size("lens"), F.col("h"), F.col("u")]
    ordered = rows.withColumn("words", words).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = b["words"].to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "lens", "words", "part")), pa.array(before)], names=["doc_id", "lens", "words", "part", "before"])

    stream = materialise(ordered.select("doc_id", "lens", "words", "part").mapInArrow(running, f"doc_id {ids}, lens array<int>, words long, part int, before long"), "stream")
    totals = stream.groupBy("part").agg(F.sum("words").alias("words")).orderBy("part").collect()  # a number for each range
    offsets = np.cumsum([0, *(r.words for r in totals)])
    table = docs.sparkSession.createDataFrame([(r.part, int(o)) for r, o in zip(totals, offsets)], "part int, offset long")
    stream = stream.join(F.broadcast(table), "part").select("doc_id", "lens", (F.col("offset") + F.col("before")).alias("at"))
    stream = stream.withColumn("stretch", F.floor(F.col("at") / stretch))
    whole = int(offsets[-1])
    # a piece of a document: its sentences from word `skip` on; ends: the document ends with it
    schema = f"kind int, seam long, at long, doc_id {ids}, skip long, lens array<int>, ends boolean, doc_ids array<{ids}>, first_words array<int>, end_words array<int>, n_words int, padding int"
    names = [f.split()[0] for f in ("kind", "seam", "at", "doc_id", "skip", "lens", "ends", "doc_ids", "first_words", "end_words", "n_words", "padding")]

    def windows_of(pdf: pd.DataFrame, cut: list[list[tuple[int, int, int]]], at: int) -> list[tuple]:
        out = []
        doc_ids, skip = [None if pd.isna(x) else x for x in pdf["doc_id"]], pdf["skip"].tolist()
        for part in cut:
            n = sum(b - a for _, a, b in part)
            # the pieces of one document join again
            whole_part: list[list] = []
            for d, a, b in part:
                if whole_part and skip[d] > 0 and whole_part[-1][2] == skip[d] + a and whole_part[-1][3] == d - 1:
                    whole_part[-1][2:] = [skip[d] + b, d]
                else:
                    whole_part.append([doc_ids[d], skip[d] + a, skip[d] + b, d])
            out.append((0, None, at, None, None, None, None, [p[0] for p in whole_part], [p[1] for p in whole_part], [p[2] for p in whole_part], n, window - n))
            at += n
        return out

    def rest(pdf: pd.DataFrame, seam: int, a: int, b: int) -> list[tuple]:
        """The pieces between two places of the stretch, for a seam."""
        out = []
        start = int(pdf["at"].iloc[0])
        for doc_id, lens, at in zip(pdf["doc_id"], pdf["lens"], pdf["at"]):
            lo, n = at - start, int(lens.sum())
            if lo < b and lo + n > a:
                skip, end = max(0, a - lo), min(n, b - lo)
                edge = np.concatenate([[0], np.cumsum(lens)])
                some = np.unique(np.concatenate([[skip], edge[(edge > skip) & (edge < end)], [end]]))
                out.append((1, seam, start + lo + skip, None if pd.isna(doc_id) else doc_id, skip, np.diff(some).tolist(), end == n, None, None, None, None, None))
        return out

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(names)})

    def first_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["stretch"].iloc[0])
        pdf = pdf.sort_values("at").assign(skip=0)
        lengths = pdf["lens"].tolist()
        start = int(pdf["at"].iloc[0])
        place, penalty = cuts_of(lengths, window, sentence_cut, hard_cut)
        total = int(place[-1])
        if start == 0:  # the stream begins with a cut
            _, back = best_cuts(place.tolist(), penalty.tolist(), window)
            head = len(place) - 1 if start + total == whole else None
            heads = {head} if head else set(range(int(np.searchsorted(place, total - window, "left")), len(place)))
            while len(heads) > 1:
                late = max(heads)
                heads.remove(late)
                heads.add(back[late])
            path = [heads.pop()]
            while path[-1] > 0:
                path.append(back[path[-1]])
            cuts = path[::-1]
        else:
            cuts, sure = settled(place, penalty, window)
            if not sure and start + total == whole:
                # the last stretch, which may be short: it goes to the seam before it, so that no cut is forced
                return frame(rest(pdf, number, 0, total))
        at = place[cuts].tolist()
        done = windows_of(pdf, pieces(lengths, at), start + at[0])
        # the next text begins where this stretch's last one ends, which may be some stretches further on
        after = number + 1 if start + total == whole else (start + total) // stretch
        return frame([*rest(pdf, number, 0, at[0]), *done, *rest(pdf, after, at[-1], total)])

    def second_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        lengths = pdf["lens"].tolist()
        # a document's inner pieces don't end it: their sentences are joined into one run for the programme
        runs: list[list[np.ndarray]] = []
        for k, lens in enumerate(lengths):
            if k and not pdf["ends"].iloc[k - 1]:
                runs[-1].append(lens)
            else:
                runs.append([lens])
        joined = [np.concatenate(r) for r in runs]
        place, penalty = cuts_of(joined, window, sentence_cut, hard_cut)
        _, back = best_cuts(place.tolist(), penalty.tolist(), window)
        cuts, i = [], len(place) - 1
        while i > 0:
            cuts.append(i)
            i = back[i]
        return frame(windows_of(pdf, pieces(lengths, [0, *place[cuts[::-1]].tolist()]), int(pdf["at"].iloc[0])))

    once = materialise(stream.groupBy("stretch").applyInPandas(first_pass, schema), "stretches")
    seams = once.filter("kind = 1").groupBy("seam").applyInPandas(second_pass, schema)
    result = [F.col("at").alias("first_word"), "doc_ids", "first_words", "end_words", "n_words", "padding"]
    return once.filter("kind = 0").select(*result).unionByName(seams.select(*result))
