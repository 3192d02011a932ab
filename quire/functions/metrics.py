"""Likeness of an extracted text and the text expected."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

def _ratio(a, b, autojunk: bool = True) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b, autojunk).ratio()


def _whole(a: str, b: str) -> float:
    """The matching share of long texts. difflib leaves out characters that make up
    over 1 % of 200 or more, which of a long text are nearly all, and without that it
    is slow: so words are matched first, and characters between matching words."""
    if a == b or len(b) < 200:
        return _ratio(a, b)
    u, v = (re.findall(r"\s+|\S+\s?", x) for x in (a, b))
    n = i = j = 0
    for p, q, size in difflib.SequenceMatcher(None, u, v, autojunk=False).get_matching_blocks():
        x, y = "".join(u[i:p]), "".join(v[j:q])
        if x and y:
            n += sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        n += sum(map(len, u[p : p + size]))
        i, j = p + size, q + size
    return 2 * n / (len(a) + len(b))


def _plain(s) -> str:
    return " ".join((s or "").split())


def _scored(score):
    @F.pandas_udf(DoubleType())
    def scores(got: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([score(a, b) for a, b in zip(got, want)], dtype=float)

    return scores


def char_accuracy(got, want, sample_size: int | None = None):
    """Matching share of the characters, white space collapsed: of all, or of the
    first `sample_size` (the reference takes 15,000)."""
    if sample_size is None:
        return _scored(lambda a, b: _whole(_plain(a), _plain(b)))(got, want)
    return _scored(lambda a, b: _ratio(_plain(a)[:sample_size], _plain(b)[:sample_size]))(got, want)


def word_error_rate(got, want, max_words: int | None = None):
    """One less the matching share of the words: of all, or of the first `max_words`
    (the reference takes 2,000)."""
    return _scored(lambda a, b: 1 - _ratio(_plain(a).split()[:max_words], _plain(b).split()[:max_words], max_words is not None))(got, want)


def similarity(got, want):
    """Matching share of all characters of the texts as they are."""
    return _scored(lambda a, b: _whole(a or "", b or ""))(got, want)
