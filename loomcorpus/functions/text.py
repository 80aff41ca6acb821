"""Tokens, n-grams, phrases and stems."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import STOP_WORDS

_STOPS = pa.array(sorted(STOP_WORDS))

#: Marks that separate words when phrases are sought.
PHRASE_MARKS = r"[,،;؛.·•:!?/\\|()\[\]{}<>@#$%^&*_=+~`\"'«»‹›—–\-\x{200c}\x{200d}\x{00ad}\x{2000}-\x{200a}]+"
SPACES = "[ \\t\\n\\f\\r]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at least two bytes that are neither stop words nor numbers."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    # numbers go with one pass over the text instead of a match for each word
    words = F.split(F.regexp_replace(spaced, r"(?<![^ ])\p{Nd}+(?![^ ])", ""), " ")
    return F.filter(words, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*sorted(STOP_WORDS)))


def token_lists(texts: pa.Array) -> pa.ListArray:
    """tokens() of a batch of texts, in Arrow; a null text has none. (Lower case is by single characters here, where a few letters have two.)"""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(spaced, " ")
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    good = pc.and_(pc.greater_equal(pc.binary_length(flat), 2), pc.invert(pc.is_in(flat, _STOPS)))
    good = pc.and_(good, pc.invert(pc.match_substring_regex(flat, r"^\p{Nd}+$")))
    at = np.searchsorted(row.filter(good).to_numpy(), np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat.filter(good))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces: the runs of n - 1, each with the word behind it."""
    if n == 1:
        return words
    paired = F.zip_with(ngrams(words, n - 1), F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(paired, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def all_ngrams(words: Column) -> Column:
    return let(words, lambda w: F.concat(*(ngrams(w, n) for n in (1, 2, 3))))


def query_ngrams(words: list[str]) -> list[str]:
    """Contiguous runs of the query's words, longest first, each once."""
    n = len(words)
    return list(dict.fromkeys(" ".join(words[i : i + k]) for k in range(n, 0, -1) for i in range(n - k + 1)))


def ngrams_of_query(words: Column, most: int = 6) -> Column:
    """query_ngrams as a column: runs of up to `most` words, longest first, each once."""
    return let(words, lambda w: F.array_distinct(F.concat(*(ngrams(w, n) for n in range(most, 0, -1)))))


def phrase_text(text: Column) -> Column:
    """text as it is searched for phrases: marks and runs of white space become one space."""
    return F.regexp_replace(F.regexp_replace(text, PHRASE_MARKS, " "), SPACES, " ")


def word_context(text: Column, word: Column, width: int = 60) -> Column:
    """`width` characters on either side of word's first place in the lower-cased text, trimmed; '' without one."""
    low = F.lower(text)
    at = F.position(word, low)
    begin = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(low, begin, at + F.length(word) + width - begin))).otherwise("")


def language(text: Column) -> Column:
    """fa if over three tenths of the characters that aren't white space are Arabic script, else en."""
    solid = F.regexp_replace(text, r"\s", "")
    arabic = F.length(F.regexp_replace(solid, r"[^\x{0600}-\x{06FF}]", ""))
    return F.when(arabic > 0.3 * F.length(solid), "fa").otherwise("en")


def content_type_ok(kind: Column) -> Column:
    """True for types whose bodies hold text; an unknown type counts as one."""
    low = F.lower(kind)
    return (kind == "") | low.rlike(r"text/(html|xml|plain)|application/(xhtml\+xml|xml|json|rss\+xml|atom\+xml)")
