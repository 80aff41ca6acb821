"""Toxicity: a sentence classifier regularised by counterfactual swaps of identity terms.

A document's logit is its bias plus its worst sentence's sum of word weights. Training labels are for documents, so each
step lets a document's worst sentence answer for it. In every labelled sentence that mentions an identity term, the term is also
swapped for each other term of its group and for a neutral word; the swapped sentence's features are made anew, stems included, both
are scored, and (score - swapped score)^2, weighted by `pairing`, is added to the loss, so a mention alone can't raise a
score. The model is fitted on at most `sample_rows` labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, tune, word_hashes

#: Terms of a group stand in for each other.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("mexican", "chinese", "german", "french", "american", "indian", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("disabled", "deaf", "blind", "autistic", "old", "young"),
)
NEUTRAL = ("person", "people")
BUCKETS, SAMPLE_ROWS, PAIRING = 1 << 18, 6000, 2.0
#: Standard deviations by which a word is more (or less) frequent in toxic documents at which half its evidence counts. A word's start and
#: the speed at which it learns go by z^4 / (z^4 + EVIDENCE^4): no word is shut out, and words of chance hardly move.
EVIDENCE = 6.0
#: Bytes of a long word that count as its stem.
STEM = 8

_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


_WORDS = [w for g in IDENTITY_TERMS for w in g] + list(NEUTRAL)
SIZE = BUCKETS + len(_WORDS)


def _stems(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (word_hashes(data, start, start + STEM) >> np.uint64(45)).astype(np.int64) & (BUCKETS - 1)


def _terms() -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sorted hashes of all terms with their numbers, and each term's stem feature or -1."""
    w = Words(pa.array(_WORDS), places=True)
    order = np.argsort(w.hash)
    stems = np.full(len(_WORDS), -1)
    long_ = np.flatnonzero(w.length > STEM)
    stems[long_] = _stems(w.data, w.start[long_])
    return w.hash[order], order, stems.tolist()


_HASH, _NUMBER, _TERM_STEM = _terms()
#: A term's number -> the numbers of what it is swapped for.
SWAPS: dict[int, list[int]] = {_WORDS.index(a): [_WORDS.index(b) for b in (*g, *NEUTRAL) if b != a] for g in IDENTITY_TERMS for a in g}
NEUTRAL_FEATURES = [BUCKETS + _WORDS.index(w) for w in NEUTRAL]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, stem feature or -1, term's number or -1, sentence number in the batch, text number) of each word of the texts."""
    w = Words(texts, places=True)
    number = np.cumsum(_STOPS[w.data], dtype=np.int32)[w.start] if len(w.hash) else np.zeros(0, np.int32)
    at = np.searchsorted(_HASH, w.hash).clip(max=len(_HASH) - 1)
    term = np.where(_HASH[at] == w.hash, _NUMBER[at], -1)
    f = np.where(term >= 0, BUCKETS + term, (w.hash >> np.uint64(46)).astype(np.int64))
    # the first bytes of long words, for words that share a stem
    stem = np.full(len(f), -1)
    long_ = np.flatnonzero(w.length > STEM)
    stem[long_] = _stems(w.data, w.start[long_])
    return f, stem, term, number, w.doc


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence number in the batch, text number) for each distinct feature of each sentence, in order."""
    f, stem, _, number, doc = features(texts)
    long_ = np.flatnonzero(stem >= 0)
    key = np.unique(np.concatenate([(number.astype(np.int64) << 19) | f, (number[long_].astype(np.int64) << 19) | stem[long_]]))
    s, f = key >> 19, key & ((1 << 19) - 1)
    # sentences never cross texts, so a sentence's text is that of any of its words
    owner = np.zeros(int(number[-1]) + 1 if len(number) else 0, np.int64)
    owner[number] = doc
    return f, s, owner[s]


#: What a swap changes: features that the sentence loses, and those that it gains.
Swap = tuple[tuple[int, ...], tuple[int, ...]]


def swaps(texts: pa.Array) -> list[Counter[Swap]]:
    """For each text, how often which change follows from swapping an identity term in one of its sentences."""
    f, stem, term, number, doc = features(texts)
    out: list[Counter[Swap]] = [Counter() for _ in range(len(texts))]
    named = np.unique(number[term >= 0])
    lo, hi = np.searchsorted(number, named), np.searchsorted(number, named, "right")
    for a, b in zip(lo.tolist(), hi.tolist()):
        words = list(zip(f[a:b].tolist(), stem[a:b].tolist(), term[a:b].tolist()))
        was = {x for w in words for x in w[:2] if x >= 0}
        for t in {w[2] for w in words} & SWAPS.keys():
            rest = {x for w in words if w[2] != t for x in w[:2] if x >= 0}
            for u in SWAPS[t]:
                new = rest | {x for x in (BUCKETS + u, _TERM_STEM[u]) if x >= 0}
                out[doc[a]][tuple(sorted(was - new)), tuple(sorted(new - was))] += 1
    return out


def _ranges(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _worst(w: np.ndarray, f: np.ndarray, s: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of its worst sentence's weights, number of that sentence) of each of n texts; 0 and -1 without words; of equal ones the first."""
    at = _ranges(s)
    top, which = np.zeros(n), np.full(n, -1)
    if not len(at):
        return top, which
    total = np.add.reduceat(w[f], at)
    owner = doc[at]
    order = np.lexsort((-total, owner))
    first = order[_ranges(owner[order])]
    top[owner[first]], which[owner[first]] = total[first], s[at[first]]
    return top, which


class Model:
    """Word weights and a bias."""

    def __init__(self) -> None:
        self.w = np.zeros(SIZE, np.float32)
        self.bias = -2.0

    def worst(self, f: np.ndarray, s: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return _worst(self.w, f, s, doc, n)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        top, which = self.worst(*sentences(texts), len(texts))
        return np.where(which >= 0, 1 / (1 + np.exp(-(top + self.bias).clip(-30, 30))), 0.0)

    def fit(self, f: np.ndarray, s: np.ndarray, doc: np.ndarray, y: np.ndarray, changes: Counter[Swap] | None = None, pairing: float = PAIRING, steps: int = 120, rate: float = 0.05, l1: float = 2e-4) -> Model:
        """s: sentence numbers, different for all documents; doc: numbers into y; both sorted. changes: of all sentences, see swaps."""
        n = len(y)
        changes = changes or Counter()
        # only features that occur are learned, under numbers of their own
        rows = [(k, x, sign) for k, (lost, gained) in enumerate(changes) for sign, part in ((1, lost), (-1, gained)) for x in part]
        number, feature, sign = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        used = np.unique(np.concatenate([f, feature]))
        f, feature = np.searchsorted(used, f), np.searchsorted(used, feature)
        size = len(used)
        # the start and the speed of a word: by how much more it is seen in toxic documents than chance allows
        pair = np.unique(doc * size + f)
        d, g = pair // size, pair % size
        pos, all_ = np.bincount(g, y[d], size), np.bincount(g, minlength=size)
        p = max(y.mean(), 1e-3)
        z = (pos - p * all_) / np.sqrt(p * (1 - min(p, 0.999)) * np.maximum(all_, 1))
        evidence = (z**4 / (z**4 + EVIDENCE**4)).astype(np.float32)
        evidence[used >= BUCKETS] = 1  # identity terms always learn
        w = (np.sign(z) * 2 * z**4 / (z**4 + EVIDENCE**4)).astype(np.float32)
        speed = np.append(evidence, np.float32(1))
        anchor = np.isin(used[feature], NEUTRAL_FEATURES)  # the neutral words stay where the texts put them
        mentions = np.array(list(changes.values()), float)
        force = 2 * pairing * np.minimum(1, 10 * mentions / n) / (max(len(g) for g in IDENTITY_TERMS) + 1)
        bias = -2.0
        weight = np.where(y > 0, 0.35 / p, 0.65 / max(1 - p, 1e-3)) / n
        first = _ranges(s)
        of = s[first]
        ends = np.append(first[1:], len(s))
        m = v = np.zeros(size + 1, np.float32)
        for step in range(1, steps + 1):
            top, which = _worst(w, f, s, doc, n)
            g = ((1 / (1 + np.exp(-(top + bias).clip(-30, 30))) - y) * weight).astype(np.float32)
            has = np.flatnonzero(which >= 0)
            at = np.searchsorted(of, which[has])
            lens = ends[at] - first[at]
            pick = np.repeat(first[at] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            grad = np.zeros(size + 1, np.float32)
            grad[:size] = np.bincount(f[pick], np.repeat(g[has], lens), size)
            grad[size] = g.sum()
            if len(rows):
                # score of the sentence less that of its swap
                pull = force * np.bincount(number, w[feature] * sign, len(force))
                grad[:size] += np.bincount(feature, np.where(anchor, 0, pull[number] * sign), size)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = rate * speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:size]
            w = np.sign(w) * np.maximum(np.abs(w) - l1, 0)
            bias -= float(move[size])
        self.w[used], self.bias = w, bias
        return self


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pairing: float = PAIRING) -> Model:
    """Fits on at most sample_rows labelled rows, those with the smallest hashes of their ids; half of them toxic where there are enough.

    Rows of labels with a null id or label are left out, as are labelled documents without text; without both classes the model scores
    everything alike. Of rows that repeat an id one counts for each label it has, the one whose text has the smallest hash, so however often
    an id occurs no more than sample_rows rows reach the driver.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL").distinct()
    half = sample_rows // 2
    chosen = rows.filter("_y > 0").orderBy(F.xxhash64("_id"), "_id").limit(half).unionByName(rows.filter("_y <= 0").orderBy(F.xxhash64("_id"), "_id").limit(half))
    # the sample is bounded by sample_rows, so it may be broadcast whatever the size of the tables
    texts = docs.select(F.col("doc_id").alias("_id"), column(docs, "text", "string").alias("text")).join(F.broadcast(chosen), "_id").filter("text IS NOT NULL").withColumn("_h", F.xxhash64("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, s, doc = sentences(b["text"])
            at = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            changed = [[{"lost": lost, "gained": gained, "times": k} for (lost, gained), k in c.items()] for c in swaps(b["text"])]
            yield pa.record_batch({"id": b["_id"], "y": b["_y"], "h": b["_h"], "f": pa.ListArray.from_arrays(at, f.astype(np.int32)), "s": pa.ListArray.from_arrays(at, s.astype(np.int32)), "swaps": pa.array(changed, kind)})

    kind = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32())), ("times", pa.int32())]))
    # of each sampled row eight bytes for each distinct word of a sentence, and a few for each swap
    each = texts.mapInArrow(extract, "id long, y int, h long, f array<int>, s array<int>, swaps array<struct<lost: array<int>, gained: array<int>, times: int>>")
    table = each.groupBy("id", "y").agg(F.min_by(F.struct("f", "s", "swaps"), "h").alias("x")).select("id", "y", "x.f", "x.s", "x.swaps").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = table["y"].to_numpy().clip(0, 1).astype(np.float64) if table.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Model()
    lens = pc.list_value_length(table["f"]).to_numpy()
    doc = np.repeat(np.arange(len(lens)), lens)
    f = table["f"].combine_chunks().flatten().to_numpy().astype(np.int64)
    s = table["s"].combine_chunks().flatten().to_numpy().astype(np.int64)
    change = np.concatenate([[0], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else s
    changes: Counter[Swap] = Counter()
    for each in table["swaps"].to_pylist():
        for x in each:
            changes[tuple(x["lost"]), tuple(x["gained"])] += x["times"]
    return Model().fit(f, np.cumsum(change), doc, y, changes, pairing)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, toxicity, is_toxic) of every row: toxicity is the probability by the worst sentence.

    Null, empty and wordless texts score 0. Repeated rows and null ids are scored each. A text of any length is scored whole. An
    empty table gives an empty result. Other columns don't matter.
    """
    some = np.flatnonzero(model.w)
    sent = docs.sparkSession.sparkContext.broadcast((some, model.w[some], model.bias))  # at most one weight a bucket, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model()
        m.w[sent.value[0]], m.bias = sent.value[1], sent.value[2]
        for b in batches:
            p = m.probabilities(b["text"])
            yield pa.record_batch({"doc_id": b["doc_id"], "toxicity": p, "is_toxic": pa.array(p >= threshold)})

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, toxicity double, is_toxic boolean")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pairing: float = PAIRING, threshold: float = 0.5) -> DataFrame:
    """Trains on the labelled documents and scores all of them; see train and score."""
    tune(docs.sparkSession)
    return score(docs, train(docs, labels, sample_rows, pairing), threshold)
