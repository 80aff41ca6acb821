"""LM scoring: a causal self-attention model over subword ids, trained in numpy, and a memory of the corpus's sentences.

p(token | context) = p(class | context) p(token | class). The classes hold about equal shares of the corpus's tokens, in order of
frequency; p(token | class) comes from the counts of all tokens of all documents. The context model is one causal attention head and a
feed-forward layer over the last WINDOW inputs. What a small model of fixed size can't hold, the memory does, which grows with the corpus: with N
other occurrences of the sentence before, M of them followed by this very sentence, a whole sentence has the probability

    p(sentence | sentence before) = 1 / (N + 1) p(its tokens, by the attention model) + N / (N + 1) M / N,

so a document that stands in the corpus twice is predicted from its copy, and a sentence after a new one from the attention model alone.

1. every text is turned into subword ids once, into a table in the shared folder;
2. tokens are counted over all documents, and classes cut;
3. the attention model is trained on all tokens of all documents, in rounds. Documents are dealt to shards by a hash, shards being as many as the
   corpus's tokens need. In a round each shard trains a copy of the model and of its optimiser's state on its documents of that
   round, in order of their hash; the copies are averaged by tokens and go on to the next. The first rounds are short. Nothing
   depends on how tables are split, but for the rounding of sums;
4. every text is cut into overlapping windows: each token is scored once, in the window where it has the most context, and
   batches of windows run through masked attention together;
5. sentences are counted by hashes: each part of the scored table sends its distinct ones with their counts, and gets back the totals of
   those that occur elsewhere too. A part sends no hash twice, so a sentence that a third of all documents holds is no hot group.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, mix, tune

#: Ranks of a byte-level BPE vocabulary, one "base64 rank" a line.
VOCABULARY = os.environ.get("LOOMCORPUS_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, OVERLAP, WIDTH, HIDDEN, CLASSES = 32, 8, 16, 32, 64
#: Rows of the input embedding: the most frequent tokens have their own, the rest share hashed ones; the last is the start.
OWN_ROWS, SHARED_ROWS = 4096, 1024
ROWS = OWN_ROWS + SHARED_ROWS + 1
#: Tokens of a training shard at least, and shards at most; shards are larger beyond that.
SHARD_TOKENS, MAX_SHARDS = 8_000_000, 16_384
#: Sixteenths of the documents in each round, and its learning rate.
ROUNDS = ((1, 0.01), (3, 0.004), (12, 0.002))
#: Tokens whose windows are shuffled together in training.
SHUFFLED = 1 << 18
#: Windows of a scoring batch and of a training step.
BATCH, STEP = 128, 128
#: Parameters of a part of a copy, and branches of the tree in which copies are averaged.
PART, BRANCHES = 1 << 14, 64
#: Sentence hashes of a bucket, about.
BUCKET = 1 << 21

_encoders: dict[str, object] = {}


def encoder(path: str):  # noqa: ANN201
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class _Known:
    """Ids of words of up to 24 bytes and 8 ids, in a table of fixed size: a word has one place in it, where the latest stays. Words are compared whole."""

    def __init__(self, dtype: str) -> None:
        self.key = np.zeros((SLOTS, 4), np.uint64)
        self.count = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, 8), dtype)


#: Words that a worker remembers, at most, 49 bytes each: a power of two.
SLOTS = 1 << 20
#: Words that are looked up at once, some 150 bytes each.
LOOKUP = 1 << 17
_known: dict[str, _Known] = {}
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Last bytes of white space, in ASCII and beyond.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WHITE_END = _WHITE.copy()
_WHITE_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


@lru_cache(4)
def begins_spaced(path: str) -> np.ndarray:
    """For each id whether its bytes begin with a space."""
    ranks = encoder(path)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, bool)
    out[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    return out


def _words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts and 32 more, where in them each word after a space begins and ends, where each text's words begin)."""
    each = [t.encode("utf-8", "surrogatepass") for t in texts]
    blob = b"\n".join([*each, bytes(32)])
    data = np.frombuffer(blob, np.uint8)
    off = np.cumsum([0, *(len(x) + 1 for x in each)])
    space = data == 32
    space[off[1:] - 1] = True  # a text's end
    edge = np.flatnonzero(space)
    opens = np.flatnonzero(data[edge] == 32)
    start, end = edge[opens] + 1, edge[opens + 1] if len(opens) else edge[:0]
    return blob, start, end, np.searchsorted(start, off)


def _odd(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether words are empty or end in white space."""
    odd = end == start
    some = np.flatnonzero(_WHITE_END[data[end - 1]])
    last, one, two = (data[end[some] - k] for k in (1, 2, 3))
    odd[some] |= _WHITE[last] | ((one == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((two >= 0xE1) & (two <= 0xE3) & ((one == 0x80) | (one == 0x81) | (one == 0x9A)))
    return odd


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of four are equal."""
    return (a == b).view(np.uint32).ravel() == 0x01010101


def _ids_of(blob: bytes, start: np.ndarray, end: np.ndarray, odd: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, how many each has), each word after a space; odd words have none."""
    if path not in _known:
        _known[path] = _Known(_dtype(path))
    known, enc = _known[path], encoder(path)
    size = end - start
    short = size <= 24
    eight = np.ndarray(len(blob) - 7, "<u8", blob, 0, (1,))  # the eight bytes from each on
    key = np.empty((len(start), 4), np.uint64)
    for k in range(3):
        np.bitwise_and(eight[start + 8 * k], _FIRST[np.clip(size - 8 * k, 0, 8)], out=key[:, k])
    key[:, 3] = size
    mixed = key[:, 0] * _SPREAD[0]
    for k in range(1, 4):
        mixed += key[:, k] * _SPREAD[k]
    slot = (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    wide, lens = known.ids.take(slot, 0), known.count.take(slot).astype(np.int32)
    lens[odd] = 0
    new = np.flatnonzero(~(_same(known.key.take(slot, 0), key) & short | odd))
    longer = np.zeros(0, np.int32)
    if len(new):
        # equal words follow one another; long ones are taken one by one
        new = new[np.argsort(mixed[new], kind="stable")]
        first = np.ones(len(new), bool)
        first[1:] = ~(_same(key[new[1:]], key[new[:-1]]) & short[new[1:]])
        one = new[first]
        ids = np.array(enc.encode_ordinary((b" " + b" ".join([blob[a:e] for a, e in zip(start[one].tolist(), end[one].tolist())])).decode("utf-8", "surrogatepass")), np.int32)
        begin = np.flatnonzero(begins_spaced(path)[ids])  # only a word's first subword begins with a space
        count = np.diff(np.append(begin, len(ids)))
        row = np.zeros((len(one), 8), wide.dtype)
        inside = np.arange(8) < count[:, None]
        row[inside] = ids[(begin[:, None] + np.arange(8))[inside]]
        group = np.cumsum(first) - 1
        wide[new], lens[new] = row[group], count[group]
        keep = np.flatnonzero((count <= 8) & short[one])
        place, pick = np.unique(slot[one[keep]], return_index=True)
        keep = keep[pick]
        known.key[place], known.count[place], known.ids[place] = key[one[keep]], count[keep], row[keep]
        many = np.flatnonzero(count[group] > 8)
        many = many[np.argsort(new[many])]  # in the order of the texts
        if len(many):
            longer = np.concatenate([ids[begin[g] : begin[g] + count[g]] for g in group[many].tolist()])
    inside = np.arange(8) < lens[:, None]
    if not len(longer):
        return wide[inside].astype(np.int32), lens
    flat, fits = np.empty(lens.sum(), np.int32), lens <= 8
    within = np.repeat(fits, lens)
    flat[within], flat[~within] = wide[inside & fits[:, None]], longer
    return flat, lens


def encode(texts: list[str], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, offsets), the same as encoding each text alone.

    The vocabulary's pattern never joins what a single space separates, so each " word" is encoded once and remembered. Texts where
    white space precedes a space are encoded as a whole.
    """
    enc = encoder(path)
    blob, start, end, at = _words(texts)
    strange = _odd(np.frombuffer(blob, np.uint8), start, end)
    parts = [_ids_of(blob, start[a : a + LOOKUP], end[a : a + LOOKUP], strange[a : a + LOOKUP], path) for a in range(0, max(1, len(start)), LOOKUP)]
    flat, lens = (np.concatenate(x) for x in zip(*parts))
    cut = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])[at]
    odd = np.concatenate([[0], np.cumsum(strange)])[at]
    out = []
    for k, t in enumerate(texts):
        h = t.split(" ", 1)[0]
        if odd[k + 1] > odd[k] or (h and h[-1].isspace() and at[k + 1] > at[k]):
            out.append(np.array(enc.encode_ordinary(t), np.int32))
        else:
            out.append(np.concatenate([np.array(enc.encode_ordinary(h), np.int32), flat[cut[k] : cut[k + 1]]]))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), offsets


class Classes:
    """Classes of tokens and the share of each token in its class, from counts over the whole corpus; unseen tokens count one half."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES) -> None:
        order = np.argsort(-counts, kind="stable")
        mass = counts[order] + 0.5
        middle = (np.cumsum(mass) - mass / 2) / mass.sum()
        self.of = np.empty(len(counts), np.int64)
        self.of[order] = np.minimum((middle * classes).astype(np.int64), classes - 1)
        total = np.bincount(self.of, counts + 0.5, classes)
        self.log_share = (np.log(counts + 0.5) - np.log(total[self.of])).astype(np.float32)
        self.prior = np.log(np.maximum(total, 0.5) / total.sum()).astype(np.float32)
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.row = np.where(rank < OWN_ROWS, rank, OWN_ROWS + (np.arange(len(counts)) * 2654435761 >> 7) % SHARED_ROWS)


def windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first token, first token to score, end) of each window; every token is to be scored in just one."""
    stride = WINDOW - OVERLAP
    n = np.where(lens > 0, 1 + np.maximum(0, -(-(lens - WINDOW) // stride)), 0)
    doc = np.repeat(np.arange(len(lens)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = k * stride
    return doc, first, np.where(k > 0, first + OVERLAP, 0), np.minimum(first + WINDOW, lens[doc])


ONES = np.ones(max(WINDOW, CLASSES), np.float32)
#: Rows of a matrix product that are taken at once: BLAS multiplies small matrices as they lie, large ones it copies first.
TALL = 512
#: Exponents are cut off here, so that their sums stay finite.
LARGEST = np.float32(60)


def _exp(x: np.ndarray) -> None:
    """exp in place."""
    if x.size and x.max() > LARGEST:
        np.minimum(x, LARGEST, out=x)
    np.exp(x, out=x)


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for many rows and a small w, by blocks of rows."""
    n, k = len(x), len(x) // TALL * TALL
    out = np.empty((n, w.shape[1]), np.float32)
    w = np.ascontiguousarray(w)
    np.matmul(x[:k].reshape(-1, TALL, x.shape[1]), w, out=out[:k].reshape(-1, TALL, w.shape[1]))
    np.matmul(x[k:], w, out=out[k:])
    return out


def cross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y for many rows, as a sum over blocks of rows."""
    k = len(x) // TALL * TALL
    return (x[:k].reshape(-1, TALL, x.shape[1]).transpose(0, 2, 1) @ y[:k].reshape(-1, TALL, y.shape[1])).sum(0) + x[k:].T @ y[k:]


def turned(x: np.ndarray) -> np.ndarray:
    """Each matrix of x transposed, in memory too."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


class Attention:
    """The parameters in one vector, named views on it, and forward and backward passes."""

    SHAPES = {"e": (ROWS, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "a": (WIDTH, HIDDEN), "ab": (HIDDEN,), "b": (HIDDEN, WIDTH), "u": (WIDTH, CLASSES), "c": (CLASSES,)}
    MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def __init__(self, flat: np.ndarray | None = None, seed: int = 11) -> None:
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        self.flat = np.random.default_rng(seed).normal(0, 0.15, size).astype(np.float32) if flat is None else flat.astype(np.float32)
        self.__dict__ |= self.views(self.flat)
        self.moments: tuple[np.ndarray, np.ndarray, int] | None = None
        if flat is None:
            self.c[:], self.ab[:] = 0, 0

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = math.prod(shape)
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """(q k', v o): an input's scores are x (q k') x' and what it adds is (weights x) (v o), so that inputs are their own keys and values."""
        return self.q @ self.k.T * np.float32(WIDTH**-0.5), self.v @ self.o

    def bias(self) -> np.ndarray:
        """c, within what exp can take: the classes' sums and gradients take exp(c) as a factor, which spares a pass over all places and classes."""
        return np.clip(self.c, -LARGEST, LARGEST)

    def log_probability(self, rows: np.ndarray, target: np.ndarray, skip: int) -> np.ndarray:
        """log p(class) at each place after the first `skip`; target is given for these places only."""
        b, w = rows.shape
        d, n = WIDTH, b * (w - skip)
        x = self.e.take(rows, 0)
        x += self.p
        qk, vo = self.products()
        own = np.ascontiguousarray(x[:, skip:]).reshape(n, d)
        s = times(own, qk).reshape(b, w - skip, d) @ turned(x)
        _exp(s)
        s *= self.MASK[skip:]
        y = (s @ x).reshape(n, d)
        y *= (1 / (s.reshape(n, w) @ ONES[:w]))[:, None]
        h = times(y, vo)
        h += own
        z = times(h, self.a)
        z += self.ab
        np.maximum(z, 0, out=z)
        h += times(z, self.b)
        out, c = times(h, self.u), self.bias()
        own = np.minimum(out.ravel()[np.arange(0, n * CLASSES, CLASSES) + target.ravel()], LARGEST)
        own += c[target.ravel()]
        _exp(out)
        return (own - np.log(out @ np.exp(c))).reshape(b, w - skip)

    def step(self, rows: np.ndarray, target: np.ndarray, valid: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean loss, gradient) over the valid places."""
        g = np.zeros_like(self.flat)
        G = self.views(g)
        b, w = rows.shape
        d, scale = WIDTH, np.float32(WIDTH**-0.5)
        # what follows attention is needed at valid places only; a few others are quicker to take along with a weight of 0 than to leave out
        count = int(np.count_nonzero(valid))
        whole = count > 0.9 * valid.size
        pick = slice(None) if whole else np.flatnonzero(valid)
        weight = valid.ravel()[pick] * np.float32(1 / max(1, count))
        qk, vo = self.products()
        x3 = self.e.take(rows, 0)
        x3 += self.p
        x = x3.reshape(-1, d)
        q, turned_x = times(x, qk).reshape(b, w, d), turned(x3)
        a = q @ turned_x
        _exp(a)
        a *= self.MASK
        # the weights are divided by their sums after the products, which are narrower than they
        one_by = (1 / (a.reshape(-1, w) @ ONES[:w]))[:, None]
        seen = (a @ x3).reshape(-1, d)
        seen *= one_by
        y = seen[pick]
        n = len(y)
        h1 = times(y, vo)
        h1 += x[pick]
        z = times(h1, self.a)
        z += self.ab
        np.maximum(z, 0, out=z)
        h2 = times(z, self.b)
        h2 += h1
        p, factor = times(h2, self.u), np.exp(self.bias())
        _exp(p)
        total = p @ factor
        at, to = np.arange(0, n * CLASSES, CLASSES), target.ravel()[pick]
        at += to
        of = factor[to]
        loss = float(-np.log(p.ravel()[at] * of / total + 1e-12) @ weight)
        # the gradient is (weight / total) p factor: a place's part is put on the narrower side of each product, a class's on the parameters
        p.ravel()[at] -= total / of
        by = weight / total
        G["c"][:] = (by @ p) * factor
        dh = times(p, (self.u * factor).T)
        dh *= by[:, None]
        G["b"][:] = cross(z, dh)
        h2 *= by[:, None]
        G["u"][:] = cross(h2, p) * factor
        dz = times(dh, self.b.T)
        dz *= (z > 0).astype(np.float32)
        G["a"][:], G["ab"][:] = cross(h1, dz), np.ones(n, np.float32) @ dz
        dh += times(dz, self.a.T)
        dvo = cross(y, dh)
        G["v"][:], G["o"][:] = dvo @ self.o.T, self.v.T @ dvo
        dy = times(dh, vo.T)
        if not whole:
            dy, some = np.zeros((b * w, d), np.float32), dy
            dy[pick] = some
        dy *= one_by
        # the softmax's own term, from the sums that it gave
        own = np.einsum("ij,ij->i", dy, seen).reshape(b, w, 1)
        dy = dy.reshape(b, w, d)
        dx = a.transpose(0, 2, 1) @ dy
        ds = dy @ turned_x
        ds -= own
        ds *= a
        dq = (ds @ x3).reshape(-1, d)
        dx += ds.transpose(0, 2, 1) @ q
        dqk = cross(x, dq) * scale
        G["q"][:], G["k"][:] = dqk @ self.k, dqk.T @ self.q
        dx = dx.reshape(-1, d)
        dx += times(dq, qk.T)
        dx[pick] += dh
        G["p"][:] = dx.reshape(b, w, d).sum(0)
        _add_rows(G["e"], rows.ravel(), dx)
        return loss, g

    def fit(self, rows: np.ndarray, target: np.ndarray, valid: np.ndarray, epochs: int, rate: float, batch: int = STEP, seed: int = 3) -> list[float]:
        """Adam over the windows, from where an earlier call left off; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        if self.moments is None:
            self.moments = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        m, v, t = self.moments
        losses = []
        for _ in range(epochs):
            each = []
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                loss, g = self.step(rows[pick], target[pick], valid[pick])
                t += 1
                root = (1 - 0.999**t) ** 0.5
                for c in range(0, len(g), PART):  # a part stays in the cache
                    grad, mean, square = (y[c : c + PART] for y in (g, m, v))
                    # both moments are held without their factors 0.1 and 0.001, which the last two numbers have
                    move = grad * grad
                    square *= 0.999
                    square += move
                    mean *= 0.9
                    mean += grad
                    np.sqrt(square, out=move)
                    move += 1e-8 * root / 0.001**0.5
                    np.divide(mean, move, out=move)
                    move *= rate * root / (1 - 0.9**t) * 0.1 / 0.001**0.5
                    self.flat[c : c + PART] -= move
                each.append(loss)
            losses.append(float(np.mean(each)) if each else 0.0)
        self.moments = m, v, t
        return losses


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows[k]] += values[k], for all k."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # by radix
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    # as complex numbers two are added at a time
    out[r[first]] += np.add.reduceat(values.take(order, 0).view(np.complex64), first, axis=0).view(np.float32)


def batches_of(ids: np.ndarray, off: np.ndarray, classes: Classes) -> tuple[np.ndarray, ...]:
    """(input rows, target classes' tokens, places to learn) of windows side by side, padded to WINDOW; each token is learned once. Full windows come first."""
    lens = np.diff(off)
    n = -(-lens // WINDOW)
    doc = np.repeat(np.arange(len(lens)), n)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    full = np.argsort(first + WINDOW > lens[doc], kind="stable")
    doc, first = doc[full], first[full]
    place = first[:, None] + np.arange(WINDOW)
    inside = place < lens[doc][:, None]
    at = np.minimum(off[doc][:, None] + place, max(len(ids) - 1, 0))
    rows = np.full(at.shape, ROWS - 1)
    if len(ids):
        rows = np.where(place > 0, classes.row[ids[np.maximum(at - 1, 0)]], rows)
        at = np.where(inside, ids[at], 0)
    return rows, at, inside


def score_tokens(model: Attention, classes: Classes, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log probability of each token, by the attention model."""
    out = np.zeros(len(ids), np.float32)
    lens = np.diff(off)
    doc, first, _, _ = windows(lens)
    begin, size = off[doc] + first, np.minimum(lens[doc] - first, WINDOW)
    # each place's input and class, in runs of WINDOW; places behind the last text are masked
    padding = np.zeros(WINDOW, np.int64)
    rows_from = np.lib.stride_tricks.sliding_window_view(np.concatenate([[ROWS - 1], classes.row[ids], padding]), WINDOW)
    class_from = np.lib.stride_tricks.sliding_window_view(np.concatenate([classes.of[ids], padding]), WINDOW)
    for chosen, skip in ((first == 0, 0), (first > 0, OVERLAP)):
        for full in (True, False):
            some = np.flatnonzero(chosen & ((size == WINDOW) == full))
            for a in range(0, len(some), BATCH):
                pick = some[a : a + BATCH]
                rows = rows_from[begin[pick]]
                if not skip:
                    rows[:, 0] = ROWS - 1
                lp = model.log_probability(rows, class_from[begin[pick], skip:], skip)
                at = begin[pick, None] + np.arange(skip, WINDOW)
                if full:
                    out[at] = lp
                else:
                    inside = np.arange(skip, WINDOW) < size[pick, None]
                    out[at[inside]] = lp[inside]
    out += classes.log_share[ids]
    return out


@lru_cache(4)
def stops(vocabulary: str) -> np.ndarray:
    """For each id whether its bytes hold a full stop, exclamation or question mark or newline: a sentence ends with it."""
    ranks = encoder(vocabulary)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, bool)
    out[[i for b, i in ranks.items() if any(c in b for c in b".!?\n")]] = True
    return out


@lru_cache(4)
def _id_hashes(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64))


def sentences(ids: np.ndarray, off: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where in ids each sentence begins, its hash, where each text's sentences begin)."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    begins = np.zeros(len(ids) + 1, bool)
    begins[1:] = stop[ids]
    begins[off] = True
    first = np.flatnonzero(begins[:-1])
    length = np.diff(np.append(first, len(ids)))
    place = np.arange(len(ids)) - np.repeat(first, length)
    h = mix(_id_hashes(len(stop))[ids] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first, mix(np.add.reduceat(h, first) + length.astype(np.uint64)), np.searchsorted(first, off)


def pair_hash(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before, 3) + h, 4)


def remembered(base: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log probability of sentences: base by the attention model; n other occurrences of the sentence before, m of them followed by this one."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    with np.errstate(divide="ignore"):
        return np.logaddexp(base - np.log(n + 1), np.log(m / (n + 1)))


def _dtype(vocabulary: str) -> str:
    return "<u2" if len(stops(vocabulary)) <= 1 << 16 else "<u4"


def _flat(column_: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, offsets) of a column of packed ids."""
    width = np.dtype(dtype).itemsize
    off = np.frombuffer(column_.buffers()[1], np.int32)[column_.offset : column_.offset + len(column_) + 1].astype(np.int64)
    data = column_.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype) if data is not None else np.zeros(0, dtype)
    return ids.astype(np.int32), (off - off[0]) // width


def _packed(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """One binary of each run of values."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, h, ids) of every row, in the shared folder: ids packed, h a hash of the row."""
    dtype = _dtype(vocabulary)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, off = encode([t or "" for t in b["text"].to_pylist()], vocabulary)
            yield pa.record_batch({"doc_id": b["doc_id"], "h": b["h"], "ids": _packed(ids.astype(dtype), off)})

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).withColumn("h", F.xxhash64("doc_id", "text", F.lit(17)))
    return materialise(rows.mapInArrow(tokens, "doc_id long, h long, ids binary"), "tokens")


def count_tokens(table: DataFrame, vocabulary: str = VOCABULARY) -> np.ndarray:
    """How often each id occurs."""
    size, dtype = len(stops(vocabulary)), _dtype(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_flat(b["ids"], dtype)[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch({"id": some.astype(np.int32), "c": total[some]})

    counted = table.select("ids").mapInArrow(count, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # at most a row for each subword
    counts = np.zeros(size, np.int64)
    counts[counted["id"].to_numpy()] = counted["c"].to_numpy()
    return counts


def train(table: DataFrame, classes: Classes, tokens: int, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, rounds: tuple = ROUNDS) -> tuple[np.ndarray, int]:
    """(parameters, tokens that were learned) from (h, ids) of every document; tokens: how many there are."""
    model, dtype = Attention(), _dtype(vocabulary)
    model.c[:] = classes.prior
    state = np.stack([model.flat, np.zeros_like(model.flat), np.zeros_like(model.flat)])
    steps, learned = 0, 0
    shards = max(1, min(MAX_SHARDS, -(-tokens // shard_tokens)))
    dealt = table.filter("octet_length(ids) > 0").select("h", "ids", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("h", F.lit(2)), F.lit(16)).alias("turn"))
    spark = table.sparkSession
    size = state.shape[1]
    begin = 0

    def rows_of(weight: int, t: int, own: np.ndarray, branch: int) -> pa.RecordBatch:
        parts = [own[:, a : a + PART] for a in range(0, size, PART)]
        return pa.record_batch({"part": pa.array(range(len(parts)), pa.int32()), "branch": pa.array([branch] * len(parts), pa.int32()), "weight": pa.array([weight] * len(parts), pa.int64()), "steps": pa.array([t] * len(parts), pa.int64()), "values": pa.array([p.tobytes() for p in parts], pa.binary())})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf["weight"].sum())
        mean = sum(w / total * np.frombuffer(v, np.float32).astype(float) for w, v in zip(pdf["weight"], pdf["values"]))
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "weight": [total], "steps": [pdf["steps"].max()], "values": [mean.astype(np.float32).tobytes()]})

    def learn(own: Attention, texts: list[np.ndarray], cl: Classes, rate: float) -> None:
        r, t, inside = batches_of(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), cl)
        own.fit(r, cl.of[t], inside, epochs=1, rate=rate, seed=own.moments[2])

    for share, rate in rounds:
        sent = spark.sparkContext.broadcast((state, steps, classes))  # some 2 MB, whatever the input

        def local(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            state, steps, cl = sent.value
            own, weight, held, size = None, 0, [], 0
            for b in batches:
                ids, off = _flat(b["ids"], dtype)
                if own is None:
                    own = Attention(state[0].copy())
                    own.moments = state[1].copy(), state[2].copy(), steps
                for a, e in zip(off[:-1].tolist(), off[1:].tolist()):
                    held.append(ids[a:e])
                    weight, size = weight + e - a, size + e - a
                    if size >= SHUFFLED:  # counted from document to document, so however the batches fall
                        learn(own, held, cl, rate)
                        held, size = [], 0
            if own is not None:
                if held:
                    learn(own, held, cl, rate)
                yield rows_of(weight, own.moments[2], np.stack([own.flat, *own.moments[:2]]), TaskContext.get().partitionId() % BRANCHES)

        turn = dealt.filter(F.col("turn").between(begin, begin + share - 1))
        begin += share
        # a partition is a shard, in the order of its rows' hashes
        copies = turn.repartitionById(shards, F.col("shard")).sortWithinPartitions("h", "ids").select("ids").mapInArrow(local, "part int, branch int, weight long, steps long, values binary")
        # a tree of two levels: no task reads more than one part of a fraction of the copies
        schema = "part int, weight long, steps long, values binary"
        averaged = copies.groupBy("part", "branch").applyInPandas(average, schema).groupBy("part").applyInPandas(average, schema).collect()  # the model's parameters
        state = state.copy()
        for p in averaged:
            values = np.frombuffer(p["values"], np.float32).reshape(3, -1)
            state[:, p["part"] * PART : p["part"] * PART + values.shape[1]] = values
        steps = max([steps, *(p["steps"] for p in averaged)])
        learned += max((p["weight"] for p in averaged), default=0)
        sent.destroy()
    return state[0], learned


def score_table(table: DataFrame, flat: np.ndarray, classes: Classes, vocabulary: str = VOCABULARY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row of a token table."""
    spark = table.sparkSession
    dtype = _dtype(vocabulary)
    sent = spark.sparkContext.broadcast((flat, classes))  # some 2 MB

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, cl = sent.value
        m, stop, unit = Attention(flat), stops(vocabulary), TaskContext.get().partitionId()
        for b in batches:
            ids, off = _flat(b["ids"], dtype)
            lp = score_tokens(m, cl, ids, off)
            begin, h, at = sentences(ids, off, stop)
            base = np.add.reduceat(lp.astype(float), begin) if len(begin) else np.zeros(0)
            yield pa.record_batch({"doc_id": b["doc_id"], "unit": pa.array([unit] * b.num_rows, pa.int32()), "n_tokens": pa.array(np.diff(off), pa.int32()), "h": _packed(h, at), "base": _packed(base.astype(np.float32), at)})

    scored = materialise(table.select("doc_id", "ids").mapInArrow(first, "doc_id long, unit int, n_tokens int, h binary, base binary"), "scored")
    sentence_count = scored.agg(F.coalesce(F.sum(F.octet_length("h")), F.lit(0))).first()[0] // 8
    buckets = max(1, -(-2 * sentence_count // bucket))

    def keys_of(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the sentences that have one before them, its key, the pair's key)."""
        follows = np.ones(len(h), bool)
        follows[at[:-1][at[:-1] < len(h)]] = False
        k = np.flatnonzero(follows)
        return k, mix(h[k - 1], 9), pair_hash(h[k - 1], h[k])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def send() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            b = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            some, first = np.unique(b[order], return_index=True)
            off = np.append(first, len(keys))
            return pa.record_batch({"bucket": pa.array(some, pa.int32()), "unit": pa.array([now] * len(some), pa.int32()), "keys": _packed(keys[order], off), "counts": _packed(counts[order].astype(np.int32), off)})

        for b in batches:
            units = b["unit"].to_numpy()
            h, at = _flat64(b["h"], np.uint64)
            for u in np.unique(units).tolist():
                rows = np.flatnonzero(units == u)
                if now is not None and now != u and held:
                    yield send()
                    held.clear()
                now = u
                lo, hi = rows[0], rows[-1] + 1
                _, before, pair = keys_of(h[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                held += [before, pair]
                if sum(map(len, held)) > 1 << 22:
                    yield send()
                    held.clear()
        if held:
            yield send()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        counts = np.concatenate([np.frombuffer(c, np.int32) for c in pdf["counts"]]).astype(np.int64)
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, counts).astype(np.int64)[number]
        out, a = [], 0
        for unit, k in zip(pdf["unit"], keys):
            t = total[a : a + len(k)]
            a += len(k)
            again = t > 1
            if again.any():
                out.append((unit, k[again].tobytes(), t[again].tobytes()))
        return pd.DataFrame(out, columns=["unit", "keys", "totals"])

    def last(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in answers["keys"]]) if len(answers) else np.zeros(0, np.uint64)
        totals = np.concatenate([np.frombuffer(t, np.int64) for t in answers["totals"]]) if len(answers) else np.zeros(0, np.int64)
        keys, place = np.unique(keys, return_index=True)
        totals = totals[place]

        def others(k: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, k).clip(max=max(len(keys) - 1, 0))
            return np.where(keys[at] == k, totals[at] - 1, 0) if len(keys) else np.zeros(len(k), np.int64)

        lens = np.array([len(x) // 8 for x in docs["h"]], np.int64)
        at = np.concatenate([[0], np.cumsum(lens)])
        h = np.frombuffer(b"".join(docs["h"]), np.uint64)
        lp = np.frombuffer(b"".join(docs["base"]), np.float32).astype(float)
        k, before, pair = keys_of(h, at)
        n = others(before)
        some = np.flatnonzero(n > 0)
        lp[k[some]] = remembered(lp[k[some]], n[some], np.minimum(others(pair[some]), n[some]))
        doc = np.repeat(np.arange(len(docs)), lens)
        total = np.bincount(doc, lp, len(docs))
        tokens = docs["n_tokens"].to_numpy(np.int64)
        ppl = np.exp(np.minimum(-total / np.maximum(tokens, 1), 700))
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_tokens": tokens, "log_prob": np.where(tokens > 0, total, 0.0), "perplexity": pd.Series(ppl, dtype=object).where(tokens > 0, None)})

    asked = scored.select("unit", "h").mapInArrow(ask, "bucket int, unit int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "unit int, keys binary, totals binary")
    return scored.groupBy("unit").cogroup(answers.groupBy("unit")).applyInPandas(last, "doc_id long, n_tokens int, log_prob double, perplexity double")


def _flat64(column_: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, offsets) of a column of packed ones."""
    off = np.frombuffer(column_.buffers()[1], np.int32)[column_.offset : column_.offset + len(column_) + 1].astype(np.int64)
    data = column_.buffers()[2]
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype) if data is not None else np.zeros(0, dtype), (off - off[0]) // width


def score(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, rounds: tuple = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row.

    Null and empty texts have no tokens: log_prob 0, perplexity null. Repeated rows and null ids are scored each, alike up to
    the rounding of single precision, and count as occurrences of each other's sentences. A text of any length is scored
    whole. An empty table gives an empty result. Other columns don't matter.
    """
    tune(docs.sparkSession)
    table = token_table(docs, vocabulary)
    counts = count_tokens(table, vocabulary)
    classes = Classes(counts)
    flat, _ = train(table, classes, int(counts.sum()), vocabulary, shard_tokens, rounds)
    return score_table(table, flat, classes, vocabulary)
