"""Quality classifier, toxicity and LM scoring: identities, held-out results, odd inputs."""

import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomcorpus.llm import lm, quality, toxicity

SF = "/root/testdata/sf0.1"
LONG = "word and more. " * 40_000


def odd_docs(spark, extra="keep string, score double, _text string"):
    rows = [(1, "A plain text of some words.", "en", "a"), (1, "A plain text of some words.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "An id that is null.", "en", "b"), (4, LONG, "de", "a"), (5, " \n ", "en", "a"), (6, "éß 漢字 \U0001f600", "fr", "c")]
    schema = "doc_id long, text string, lang string, source string, " + extra
    width = len(extra.split(","))
    return spark.createDataFrame([(*r, *["x" if "string" in e else 1.0 for e in extra.split(",")][:width]) for r in rows], schema)


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return docs.merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id")


def test_factorisation_identity():
    m = quality.Machine()
    m.w[:] = np.random.default_rng(1).normal(size=quality.SIZE)
    at, idx, val, _ = quality.features(pa.array(["a few words, a few", "", "B! b! B!"]), pa.array(["en", None, "de"]), pa.array(["s", "s", None]))
    got, _ = m.raw_score(at, idx, val)
    for k in range(3):
        i, x = idx[at[k] : at[k + 1]], val[at[k] : at[k + 1]].astype(float)
        assert len(set(i.tolist())) == len(i)
        gram = m.v[i].astype(float) @ m.v[i].astype(float).T * np.outer(x, x)
        want = m.bias + (m.w[i] * x).sum() + (gram.sum() - np.trace(gram)) / 2
        assert got[k] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_quality_on_held_out_rows(labelled):
    train, test = labelled.iloc[:2500], labelled.iloc[2500:]
    cols = lambda x: (pa.array(x.text), pa.array(x.lang), pa.array(x.source))
    at, idx, val, _ = quality.features(*cols(train))
    m = quality.Machine().fit(at, idx, val, train.quality.to_numpy(np.float32), epochs=8)
    p, y = m.scores(*cols(test)), test.quality.to_numpy()
    assert (p[y == 1] >= 0.5).mean() > 0.985
    assert (p[y == 0] < 0.5).mean() > 0.95


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, None), (4, 0, 1), (None, 1, 1), (2, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == [*docs.columns, "quality_score", "keep_"]
    assert {(r.keep, r["_text"]) for r in rows} == {("x", "x")}
    same = [r.quality_score for r in rows if r.doc_id == 1]
    assert same[0] == same[1]
    assert all(r.quality_score == 0 and not r.keep_ for r in rows if r.doc_id in (2, 3, 5))
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.keep_)
    neutral = quality.classify(docs, labels.limit(0)).filter("doc_id = 6").first()
    assert neutral.keep_ and 0.4 < neutral.quality_score < 0.6


def test_toxicity_on_held_out_rows(labelled):
    train, test = labelled.iloc[:2500], labelled.iloc[2500:]
    m = toxicity.Model().fit(*toxicity.sentences(pa.array(train.text)), train.toxic.to_numpy(float))
    p, y = m.probabilities(pa.array(test.text)), test.toxic.to_numpy()
    assert (p[y == 1] >= 0.5).mean() > 0.8
    assert (p[y == 0] >= 0.5).mean() < 0.03


def _skewed(term, other):
    """(texts, labels) in which a term is mentioned mostly in toxic texts, and another of its group in others."""
    rng = np.random.default_rng(0)
    words = ["tree", "river", "house", "walked", "under", "stone", "green", "light"]
    say = lambda extra: " ".join(rng.permutation([*rng.choice(words, 6), *extra])) + "."
    texts = [say([term, "vile"]) for _ in range(150)] + [say(["vile"]) for _ in range(100)] + [say([]) for _ in range(300)] + [say([term]) for _ in range(15)] + [say([other]) for _ in range(60)]
    return texts, np.array([1.0] * 250 + [0.0] * 375)


def _fitted(texts, y, pairing=toxicity.PAIRING):
    changes = sum(toxicity.swaps(pa.array(texts)), Counter())
    return toxicity.Model().fit(*toxicity.sentences(pa.array(texts)), y, changes, pairing=pairing)


@pytest.mark.parametrize("group", toxicity.IDENTITY_TERMS, ids=lambda g: g[0])
def test_counterfactuals_protect_neutral_mentions_of_every_term(group):
    for term in group:
        other = next(t for t in group if t != term)
        gap, found = {}, {}
        for pairing in (0.0, toxicity.PAIRING):
            m = _fitted(*_skewed(term, other), pairing=pairing)
            p = found[pairing] = m.probabilities(pa.array([f"The {term} walked under the tree.", f"The {other} walked under the tree.", "The vile house."]))
            gap[pairing] = abs(np.log(p[0] / (1 - p[0])) - np.log(p[1] / (1 - p[1])))
        assert gap[toxicity.PAIRING] < 0.5 * gap[0.0] + 0.05, (term, gap)
        assert found[toxicity.PAIRING][0] < 0.5 < found[toxicity.PAIRING][2], term


def test_swaps_are_those_of_sentences_made_anew():
    text = "The immigrants and refugees came. A man, a woman. No one."
    swapped = Counter()
    words = {w: g for g in toxicity.IDENTITY_TERMS for w in g}
    for sentence in ("The immigrants and refugees came", "A man, a woman"):
        was = set(toxicity.sentences(pa.array([sentence]))[0].tolist())
        for term in ("immigrants", "refugees", "man", "woman"):
            if re.search(rf"\b{term}\b", sentence):
                for other in (*words[term], *toxicity.NEUTRAL):
                    if other != term:
                        new = set(toxicity.sentences(pa.array([re.sub(rf"\b{term}\b", other, sentence)]))[0].tolist())
                        swapped[tuple(sorted(was - new)), tuple(sorted(new - was))] += 1
    assert toxicity.swaps(pa.array([text, "", None])) == [swapped, Counter(), Counter()]
    assert any(len(lost) > 1 for lost, _ in swapped)  # stems go with their terms


def test_toxicity_equals_a_plain_scorer():
    rng = np.random.default_rng(4)
    m = toxicity.Model()
    m.w[:] = rng.normal(size=toxicity.SIZE)
    texts = pq.read_table(f"{SF}/documents.parquet").slice(0, 60)["text"].to_pylist() + ["", None, "One. two! three", "muslim IMMIGRANTS. x"]
    got = m.probabilities(pa.array(texts))
    for k, t in enumerate(texts):
        best = None
        for sentence in re.split(r"[.!?\n]", t or ""):
            f = set(toxicity.sentences(pa.array([sentence]))[0].tolist())
            if f:
                best = max(best if best is not None else -1e9, sum(float(m.w[x]) for x in f))
        assert got[k] == pytest.approx(0 if best is None else 1 / (1 + np.exp(-(np.clip(best + m.bias, -30, 30)))), rel=1e-3, abs=1e-9)


def test_rare_words_are_not_shut_out():
    rng = np.random.default_rng(1)
    say = lambda extra: " ".join(rng.permutation([*rng.choice(["tree", "river", "house", "stone"], 6), *extra]))
    texts = [say(["vile"]) for _ in range(20)] + [say([]) for _ in range(20)]
    p = _fitted(texts, np.array([1.0] * 20 + [0.0] * 20)).probabilities(pa.array(["the vile house", "the house"]))
    assert p[0] > 0.5 > p[1]


def test_toxicity_worst_sentence_decides():
    m = toxicity.Model()
    f, s, doc = toxicity.sentences(pa.array(["One two. three four! five", "", None, "six"]))
    assert [len(set(s[doc == k].tolist())) for k in range(4)] == [3, 0, 0, 1]
    m.w[f[s == s[0]]] = 3
    top, which = m.worst(f, s, doc, 4)
    assert top.tolist() == [6, 0, 0, 0] and which[1] == which[2] == -1


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark, "toxicity double, is_toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 8 and {r.toxicity for r in rows if r.doc_id in (2, 3, 5)} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert not any(r.is_toxic for r in toxicity.classify(docs, labels.limit(0)).collect())


TEXTS = ["a  b", "a \n b", " lead", "trail ", "x\n\n y", "  ", "", " ", "a\t b  c\n", "tab\tq   z", "Ça va, l'été? 12 34", "word " * 50, "  b   c"]


def test_encode_equals_the_plain_encoder():
    more = pq.read_table(f"{SF}/documents.parquet").slice(0, 200)["text"].to_pylist()
    for _ in range(2):  # the second time from memory
        ids, off = lm.encode(TEXTS + more)
        for k, t in enumerate(TEXTS + more):
            assert ids[off[k] : off[k + 1]].tolist() == lm.encoder(lm.VOCABULARY).encode_ordinary(t)


@pytest.mark.parametrize("slots,lookup", [(1 << 20, 1 << 17), (64, 37)])  # in 64 places words push each other out
def test_encode_of_odd_texts(monkeypatch, slots, lookup):
    monkeypatch.setattr(lm, "SLOTS", slots)
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    monkeypatch.setattr(lm, "_known", {})
    rng = np.random.default_rng(slots)
    parts = [*"ab é’”… \u0085\xa0\u2003\u3000\n\t\x1c\x00'sà漢😀.!1", *[" "] * 6, "word", "Licence", "a" * 24, "a" * 25, "a" * 60, "zqxjkvzqxjkv", "\x00\x00"]
    for _ in range(10):
        texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(100)]
        ids, off = lm.encode(texts)
        for k, t in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == lm.encoder(lm.VOCABULARY).encode_ordinary(t)
    assert len(lm.encode([])[0]) == len(lm.encode([""])[0]) == 0


def test_many_words_are_remembered(monkeypatch):
    enc, read = lm.encoder(lm.VOCABULARY), []
    lm.begins_spaced(lm.VOCABULARY)
    monkeypatch.setattr(lm, "_known", {})
    monkeypatch.setattr(lm, "encoder", lambda path: SimpleNamespace(encode_ordinary=lambda t: read.append(len(t)) or enc.encode_ordinary(t)))
    texts = ["first " + " ".join(f"w{k}x" for k in range(a, a + 10_000)) for a in range(0, 150_000, 10_000)]
    lm.encode(texts)
    once = sum(read)
    read.clear()
    for t in texts:
        lm.encode([t])
    assert sum(read) < 0.2 * once


def _small_model():
    ids, off = lm.encode(pq.read_table(f"{SF}/documents.parquet").slice(0, 120)["text"].to_pylist())
    classes = lm.Classes(np.bincount(ids, minlength=50_256))
    m = lm.Attention()
    m.c[:] = classes.prior
    r, t, v = lm.batches_of(ids[: off[80]], off[:81], classes)
    losses = m.fit(r, classes.of[t], v, epochs=2, rate=0.01)
    return m, classes, ids, off, losses


def plain_scores(m, classes, mine):
    """Log probability of each token of one text: one window at a time, every token in the only window that is to score it."""
    out = np.zeros(len(mine))
    _, first, start, end = lm.windows(np.array([len(mine)]))
    assert np.concatenate([np.arange(a, b) for a, b in zip(start, end)] or [[]]).tolist() == list(range(len(mine)))
    for f, a, b in zip(first, start, end):
        inputs = np.array([lm.ROWS - 1 if p == 0 else classes.row[mine[p - 1]] for p in range(f, b)])
        x = m.e[inputs] + m.p[: len(inputs)]
        s = (x @ m.q) @ (x @ m.k).T / np.sqrt(lm.WIDTH)
        s[np.triu_indices(len(s), 1)] = -np.inf
        w = np.exp(s - s.max(1, keepdims=True))
        h = x + (w / w.sum(1, keepdims=True)) @ (x @ m.v) @ m.o
        h = h + np.maximum(h @ m.a + m.ab, 0) @ m.b
        z = h @ m.u + m.c
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        out[a:b] = [z[p - f, classes.of[mine[p]]] + classes.log_share[mine[p]] for p in range(a, b)]
    return out


def test_lm_learns_and_scores_each_token_once():
    m, classes, ids, off, losses = _small_model()
    assert losses[1] < losses[0]
    held, at = ids[off[80] :], off[80:] - off[80]
    got = lm.score_tokens(m, classes, held, at)
    unigram = (classes.log_share + classes.prior[classes.of])[held].sum()
    assert got.sum() > unigram
    for k in range(5):
        assert got[at[k] : at[k + 1]] == pytest.approx(plain_scores(m, classes, held[at[k] : at[k + 1]]), rel=1e-3, abs=1e-3)


def test_lm_gradient():
    m, classes, ids, off, _ = _small_model()
    r, t, v = lm.batches_of(ids[: off[3]], off[:4], classes)
    for some in (slice(0, 8), slice(-8, None)):  # full windows, and padded ones
        _, g = m.step(r[some], classes.of[t[some]], v[some])
        rng = np.random.default_rng(0)
        for i in [*rng.integers(lm.ROWS * lm.WIDTH, len(g), 15), *(r[some].ravel()[:5] * lm.WIDTH + 3)]:
            old = m.flat[i]
            m.flat[i] = old + 1e-2
            a, _ = m.step(r[some], classes.of[t[some]], v[some])
            m.flat[i] = old - 1e-2
            b, _ = m.step(r[some], classes.of[t[some]], v[some])
            m.flat[i] = old
            assert (a - b) / 2e-2 == pytest.approx(g[i], abs=3e-3, rel=0.05)


def test_padded_places_have_no_part_in_a_step():
    m, classes, ids, off, _ = _small_model()
    r, t, v = lm.batches_of(ids[: off[6]], off[:7], classes)
    y = classes.of[t]
    full, padded = np.flatnonzero(v.all(1)), np.flatnonzero(~v.all(1))
    assert len(full) > 30 and len(padded)
    for some in (np.append(full, padded[0]), padded, np.append(full[:1], padded)):  # few padded places, and many
        loss, g = m.step(r[some], y[some], v[some])
        each = [(v[k].sum(), *m.step(r[k : k + 1], y[k : k + 1], v[k : k + 1])) for k in some]
        n = sum(e[0] for e in each)
        assert loss == pytest.approx(sum(e[0] * e[1] for e in each) / n, rel=1e-4)
        assert g == pytest.approx(sum(e[0] * e[2] for e in each) / n, abs=2e-5)
        again = m.step(np.where(v[some], r[some], 9), np.where(v[some], y[some], 5), v[some])
        assert again[0] == pytest.approx(loss, rel=1e-5) and again[1] == pytest.approx(g, abs=1e-5)


def test_fit_is_adam_by_the_book():
    m, classes, ids, off, _ = _small_model()
    r, t, v = lm.batches_of(ids[: off[9]], off[:10], classes)
    got, want = lm.Attention(m.flat.copy()), lm.Attention(m.flat.copy())
    got.fit(r, classes.of[t], v, epochs=2, rate=0.003, batch=40, seed=8)
    rng, mean, square, k = np.random.default_rng(8), 0.0, 0.0, 0
    for _ in range(2):
        order = rng.permutation(len(r))
        for a in range(0, len(order), 40):
            some = order[a : a + 40]
            g = want.step(r[some], classes.of[t[some]], v[some])[1].astype(float)
            k += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            want.flat -= (0.003 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    assert k > 5 and np.abs(got.flat - m.flat).max() > 0.003
    assert np.quantile(np.abs(got.flat - want.flat), 0.99) < 1e-4


def test_inputs_are_their_own_keys_and_values(monkeypatch):
    m, classes, ids, off, _ = _small_model()
    r, t, v = lm.batches_of(ids[: off[9]], off[:10], classes)
    some = np.flatnonzero(v.all(1))[:64]
    times, cross, made = lm.times, lm.cross, []
    monkeypatch.setattr(lm, "times", lambda x, w: made.append(x.shape[1] * w.shape[1]) or times(x, w))
    monkeypatch.setattr(lm, "cross", lambda x, y: made.append(x.shape[1] * y.shape[1]) or cross(x, y))
    square, rest = lm.WIDTH**2, lm.WIDTH * (2 * lm.HIDDEN + lm.CLASSES)
    m.step(r[some], classes.of[t[some]], v[some])
    assert sum(made) == 6 * square + 3 * rest  # a place has two projections, each forward, backward and for its gradient
    made.clear()
    m.log_probability(r[some], classes.of[t[some]], 0)
    assert sum(made) == 2 * square + rest


def test_products_by_blocks_are_the_plain_ones():
    rng = np.random.default_rng(2)
    for n in (0, 1, lm.TALL - 1, lm.TALL, 3 * lm.TALL + 5):
        x, y, w = (rng.normal(size=s).astype(np.float32) for s in ((n, 16), (n, 64), (64, 16)))
        assert lm.times(x, w.T) == pytest.approx(x @ w.T, abs=1e-4) and lm.cross(x, y) == pytest.approx(x.T @ y, abs=1e-2)


def test_rows_are_added_as_by_a_loop():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(0, 50, 300), np.repeat(7, 40)])
    values = rng.normal(size=(340, lm.WIDTH)).astype(np.float32)
    got, want = np.zeros((60, lm.WIDTH), np.float32), np.zeros((60, lm.WIDTH))
    lm._add_rows(got, rows, values)
    for r, v in zip(rows, values):
        want[r] += v
    assert got == pytest.approx(want, abs=1e-4)


def test_windows_of_training_hold_each_token_once():
    lens = np.array([0, 1, 31, 32, 33, 100])
    ids = np.arange(lens.sum())
    classes = lm.Classes(np.ones(len(ids)))
    rows, target, inside = lm.batches_of(ids, np.concatenate([[0], np.cumsum(lens)]), classes)
    assert sorted(target[inside].tolist()) == ids.tolist()
    begins = np.cumsum(lens) - lens
    for r, t, i in zip(rows, target, inside):
        assert r[0] == (lm.ROWS - 1 if t[0] in begins else classes.row[t[0] - 1]) and (r[1:][i[1:]] == classes.row[t[:-1][i[1:]]]).all()


def _sentences_of(ids, stop):
    out, now = [], []
    for x in ids.tolist():
        now.append(x)
        if stop[x]:
            out.append(tuple(now))
            now = []
    return out + [tuple(now)] * bool(now)


def test_score_equals_brute_force_whatever_the_partitions(spark):
    rng = np.random.default_rng(7)
    lines = [" ".join(rng.choice(["tree", "river", "house", "stone", "Haus", "vert", "42"], rng.integers(2, 12))) + rng.choice([".", "!", "\n", " ?"]) for _ in range(30)]
    texts = [" ".join(rng.choice(lines, rng.integers(1, 9))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " more", "x", "", "word " * 300, lines[3] + " " + lines[4] + " " + lines[3] + " " + lines[4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lm.tune(spark)
    found = []
    for parts in (2, 8):
        table = lm.token_table(docs.repartition(parts))
        counts = lm.count_tokens(table)
        classes = lm.Classes(counts)
        flat, learned = lm.train(table, classes, int(counts.sum()), shard_tokens=1000, rounds=((4, 0.01), (12, 0.005)))
        assert learned == counts.sum()  # all tokens of all documents
        found.append({r.doc_id: r for r in lm.score_table(table, flat, classes, bucket=60).collect()})
        assert len(found[-1]) == len(texts)
    assert {k: r.log_prob for k, r in found[0].items()} == pytest.approx({k: r.log_prob for k, r in found[1].items()}, rel=1e-3, abs=1e-3)
    model, stop = lm.Attention(flat), lm.stops(lm.VOCABULARY)
    each = [_sentences_of(np.array(lm.encoder(lm.VOCABULARY).encode_ordinary(t)), stop) for t in texts]
    before, pairs = Counter(), Counter()
    for s in each:
        before.update(s[:-1])
        pairs.update(zip(s, s[1:]))
    for k, s in enumerate(each):
        ids = np.array([x for y in s for x in y], int)
        lp, total, at = plain_scores(model, classes, ids), 0.0, 0
        for i, sentence in enumerate(s):
            own = lp[at : at + len(sentence)].sum()
            at += len(sentence)
            n, m = (before[s[i - 1]] - 1, pairs[s[i - 1], sentence] - 1) if i else (0, 0)
            total += own if n == 0 else np.log(np.exp(own) / (n + 1) + m / (n + 1))
        r = found[1][k]
        assert r.n_tokens == len(ids) and r.log_prob == pytest.approx(total, rel=2e-3, abs=2e-3), k
        assert r.perplexity == (None if not len(ids) else pytest.approx(np.exp(-total / len(ids)), rel=1e-2))


def test_copies_are_scored_apart(spark):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").slice(0, 300)["text"].to_pylist()
    texts = [t for t in dict.fromkeys(texts) if len(t) > 400][:150]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:10])), "doc_id long, text string")
    ppl = {r.doc_id: r.perplexity for r in lm.score(docs).collect()}
    twice = [ppl[k] for k in range(10)] + [ppl[len(texts) + k] for k in range(10)]
    assert np.median(twice) < 0.5 * np.median([ppl[k] for k in range(10, len(texts))])


def test_lm_odd_rows(spark):
    docs = odd_docs(spark, "perplexity double, ids string")
    rows = lm.score(docs).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[2].perplexity is None and by[3].log_prob == 0
    same = [r.log_prob for r in rows if r.doc_id == 1]
    assert same[0] == pytest.approx(same[1], rel=1e-5)  # single precision, in other places of a batch
    assert by[4].n_tokens == len(lm.encoder(lm.VOCABULARY).encode_ordinary(LONG)) and np.isfinite(by[4].perplexity)
    assert lm.score(docs.limit(0)).count() == 0


def test_more_documents_make_a_better_model(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("tree", "river", "house", "stone") for b in ("", "s", "less", "like")]
    texts = [" ".join(words[(k + j) % 16] for j in range(200)) for k in rng.integers(0, 16, 600).tolist()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loss = lambda rounds: -lm.score(docs, rounds=rounds).selectExpr("sum(log_prob) / sum(n_tokens)").first()[0]
    assert loss(lm.ROUNDS) < loss(((1, 0.01),)) - 0.1


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_training_rows_are_bounded_however_often_an_id_occurs(spark, monkeypatch, module, label):
    texts = [(k, f"{'calm plain' if k % 2 else 'awful nasty'} words number {k}. The woman spoke.", "en", "a") for k in range(40)]
    hot = [(k % 40, f"calm plain words again {k}.", "en", "a") for k in range(400)]  # any sample holds repeated ids
    schema = "doc_id long, text string, lang string, source string"
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 3, f"doc_id long, {label} int")
    rows = []
    kind = quality.Machine if module is quality else toxicity.Model
    fit = kind.fit
    at = 3  # where fit takes the labels, after itself
    monkeypatch.setattr(kind, "fit", lambda *a, **k: rows.append(a[at + 1]) or fit(*a, **k))
    weights = []
    for some in (texts + hot, (texts + hot) * 2):
        weights.append(module.train(spark.createDataFrame(some, schema), labels, sample_rows=20).w)
    assert [len(y) <= 20 and len(set(y.tolist())) == 2 for y in rows] == [True, True]
    assert np.array_equal(*weights)
