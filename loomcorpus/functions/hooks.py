"""Where a user's own code plugs in: embedding models, stemmers for further languages, work after a page's crawl.

A hook is a function from a list of texts to as many results; it runs in Python workers on Arrow batches, and is loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stem as english

Embedder = Callable[[list[str]], np.ndarray]
Stemmer = Callable[[list[str]], list[str]]

_stemmers: dict[str, Stemmer] = {}


def embed(texts: Column, load: Callable[[], Embedder]) -> Column:
    """Each text's vector by the model that load() gives, at length 1; a zero vector stays one, a null text gives null."""
    model: list[Embedder] = []

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batch: pd.Series) -> pd.Series:
        if not model:
            model.append(load())
        some = batch.notna().to_numpy()
        v = np.asarray(model[0](batch[some].tolist()), np.float64) if some.any() else np.zeros((0, 1))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        out = pd.Series([None] * len(batch), dtype=object)
        for k, x in zip(np.flatnonzero(some), v.astype(np.float32)):
            out.iat[k] = x
        return out

    return run(texts)


def letter_profile() -> Embedder:
    """A model without weights, for tests and as an example: how often each of the letters a to h occurs."""
    return lambda texts: np.array([[t.count(c) for c in "abcdefgh"] for t in texts], float).reshape(len(texts), 8)


def lemma_base(lemma: str) -> str:
    """A lemmatiser may give two forms, as past#present; the first is the base."""
    return lemma.split("#")[0]


def register_stemmer(language: str, stemmer: Stemmer) -> None:
    """Makes stemmed() use the stemmer for that language."""
    _stemmers[language] = stemmer


def stemmed(word: Column, language: Column) -> Column:
    """The word's stem: by its language's registered stemmer, else English by Porter2; words of other languages stay as they are."""
    own = dict(_stemmers)

    @F.pandas_udf(T.StringType())
    def run(words: pd.Series, languages: pd.Series) -> pd.Series:
        out = words.copy()
        for name in languages.dropna().unique():
            rows = (languages == name) & words.notna()
            distinct = words[rows].unique().tolist()
            if name in own:
                known = dict(zip(distinct, own[name](distinct)))
            elif name == "en":
                known = {w: english.porter2(w) for w in distinct}
            else:
                continue
            out[rows] = words[rows].map(known)
        return out

    return run(word, language)


def after_page(entries: Column, load: Callable[[], Callable[[list[str]], list[str | None]]]) -> Column:
    """What a hook makes of each page's entry, JSON to JSON; null entries aren't given to it, and null is its answer for no result."""
    hook: list[Callable[[list[str]], list[str | None]]] = []

    @F.pandas_udf(T.StringType())
    def run(batch: pd.Series) -> pd.Series:
        if not hook:
            hook.append(load())
        out, some = batch.copy(), batch.notna()
        if some.any():
            out[some] = hook[0](batch[some].tolist())
        return out

    return run(entries)
