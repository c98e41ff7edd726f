"""Similarity of terms: which pairs may be compared, and token set similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexistrata.constants import EXCLUDED_TERMS, SYNONYMS
from lexistrata.functions.text import lookup


#: The least share of common words and the least ratio of lengths of terms that are compared.
LEAST_SHARED = 0.67
LEAST_RATIO = 0.55


def comparable(term: Column) -> Column:
    """What comparing needs of a term: its text, distinct words, length and synonym; null for a term that is never compared."""
    words = F.array_distinct(F.split(term, " "))
    held = F.struct(term.alias("t"), words.alias("w"), F.size(words).alias("n"), F.length(term).alias("len"), lookup(SYNONYMS, term).alias("s"))
    return F.when(~term.isin(EXCLUDED_TERMS), held)


def comparable_pair(a: Column, b: Column) -> Column:
    """Whether two terms, given as ``comparable``, share enough words and have like lengths; synonyms always."""
    shared = F.size(F.array_intersect(a["w"], b["w"]))
    least, most = F.least(a["len"], b["len"]), F.greatest(a["len"], b["len"])
    alone = (a["n"] == 1) | (b["n"] == 1)
    same = (a["n"] == b["n"]) & (shared == a["n"])
    near = (least / most >= LEAST_RATIO) & (shared / F.least(a["n"], b["n"]) >= LEAST_SHARED) & (shared > 0)
    fits = ((least >= 5) | (a["t"] == b["t"])) & F.when(alone, same).otherwise(near)
    return F.coalesce(fits | a["s"].eqNullSafe(b["t"]) | b["s"].eqNullSafe(a["t"]), F.lit(False))


def can_compare(left: Column, right: Column) -> Column:
    """Whether two terms share enough words and have like lengths, synonyms always, excluded terms never."""
    a, b = comparable(left), comparable(right)
    return a.isNotNull() & b.isNotNull() & comparable_pair(a, b)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & places.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_similarity(left: str, right: str) -> float:
    """The best likeness, 0 to 1, of two texts as sets of words: shared words against either, and the rests against each other.

    Likeness of two strings is twice their longest common subsequence over the sum of their lengths.
    """
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    shared, only_a, only_b = a & b, " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if shared and not (only_a and only_b):
        return 1.0
    both = len(" ".join(sorted(shared)))
    gap = 1 if both else 0
    whole_a, whole_b = both + gap + len(only_a), both + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 1 - apart / (whole_a + whole_b)
    if both:
        best = max(best, 1 - (gap + len(only_a)) / (both + whole_a), 1 - (gap + len(only_b)) / (both + whole_b))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """``token_set_similarity`` of Arrow batches of pairs."""
    return pd.Series([token_set_similarity(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")
