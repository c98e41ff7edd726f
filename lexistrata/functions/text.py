"""Text functions of the profiler as built-in expressions: normal forms, lists in one cell, phrases, term filters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexistrata.constants import (
    BLOCK_STOP_TOKENS,
    COMPOUND_FIELDS,
    EXCLUDED_TERMS,
    NOISY_STREAMS,
    SENSOR_TERMS,
    STOPWORDS,
    SYNONYMS,
)
from lexistrata.functions.cleaning import strip_ends

SEPARATOR = " | "


def literals(values: list[str]) -> Column:
    """An array of strings."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a key in a fixed dictionary, null where it has none.

    The dictionary is one literal that the optimizer folds: as thousands of nodes it would cost more to plan than to use.
    """
    packed = "\u0001".join(f"{k}\u0002{v}" for k, v in pairs.items())
    return F.try_element_at(F.str_to_map(F.lit(packed), F.lit("\u0001"), F.lit("\u0002")), key)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used; inside functions on arrays this matters."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: those with one such character, and the others."""
    one, into, more = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", char)
        if plain == char:
            continue
        ascii_part = plain.encode("ascii", "ignore").decode()
        if len(ascii_part) == 1:
            one.append(char)
            into.append(ascii_part)
        elif ascii_part:
            more[char] = ascii_part
    return "".join(one), "".join(into), more


def _wide_class(chars: list[str], gap: int = 600) -> str:
    """A character class of few ranges that has all these characters, and others between them."""
    codes = sorted(map(ord, chars))
    starts = [c for i, c in enumerate(codes) if not i or c - codes[i - 1] > gap]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] - c > gap]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True)) + "]"


def fold_ascii(text: Column) -> Column:
    """Compatibility decomposition of all of Unicode, then only its ASCII characters."""
    one, into, more = _folds()
    plane = {c: more[c] for c in more if ord(c) < 0x10000}
    # Most characters pass by two tests: a few wide ranges for the text, plain ASCII for the character.
    chars = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.when(c < "\u0080", c).otherwise(F.coalesce(lookup(plane, c), c))), ""
    )
    rare = F.when(text.rlike(_wide_class(list(plane))), chars).otherwise(text)
    folded = F.regexp_replace(F.translate(rare, one, into), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def normalize_text(value: Column, *, remove_stopwords: bool = False) -> Column:
    """Lower-case ASCII words parted by single spaces, without addresses; a whole text that has a synonym becomes it.

    Null becomes the empty string.
    """
    text = F.lower(fold_ascii(F.coalesce(value.cast("string"), F.lit(""))))
    text = F.regexp_replace(text, r"https?://\S+", " ")
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    text = F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))
    if remove_stopwords:
        kept = F.filter(F.split(text, " "), lambda word: ~word.isin(STOPWORDS))
        text = F.array_join(kept, " ")
    return bind(text, lambda whole: F.coalesce(lookup(SYNONYMS, whole), whole))


def without_stopwords(normal: Column) -> Column:
    """The normal form without stop words of a text that is a normal form already."""
    kept = F.array_join(F.filter(F.split(normal, " "), lambda word: ~word.isin(STOPWORDS)), " ")
    return bind(kept, lambda whole: F.coalesce(lookup(SYNONYMS, whole), whole))


def split_compound(value: Column) -> Column:
    """Normal forms of the parts of a text between semicolons, commas and bars, none for a text without words."""
    none = F.array().cast("array<string>")

    def parts(whole: Column) -> Column:
        split = F.split(F.coalesce(value.cast("string"), F.lit("")), r"\s*[;,|]\s*")
        found = F.filter(F.transform(split, lambda part: normalize_text(part)), lambda part: part != "")
        some = bind(found, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(whole)))
        return F.when(whole == "", none).otherwise(some)

    return bind(normalize_text(value), parts)


def compact(values: Column, limit: int = 5) -> Column:
    """The first distinct non-blank values of an array, trimmed, in order."""
    trimmed = F.filter(F.transform(values, lambda v: strip_ends(v)), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.slice(F.array_distinct(trimmed), 1, limit)


def compact_list(values: Column, limit: int = 5) -> Column:
    """``compact`` in one cell, parted by bars."""
    return F.array_join(compact(values, limit), SEPARATOR)


def _runs(words: Column, length: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - (length - 1)),
        lambda start: F.array_join(F.slice(words, start, length), " "),
    )


def phrases(value: Column) -> Column:
    """The whole normal form without stop words and, above two words, all runs of two and of three words."""
    none = F.array().cast("array<string>")

    def runs(pair: Column) -> Column:
        whole, words = pair["whole"], pair["words"]
        longer = F.concat(F.array(whole), _runs(words, 2), _runs(words, 3))
        return F.when(whole == "", none).when(F.size(words) > 2, F.array_distinct(longer)).otherwise(F.array(whole))

    whole = normalize_text(value, remove_stopwords=True)
    pair = bind(whole, lambda w: F.struct(w.alias("whole"), F.split(w, " ").alias("words")))
    return bind(pair, runs)


def list_terms(value: Column) -> Column:
    """The items of a cell that holds a list."""
    return split_compound(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit(SEPARATOR), F.lit(";")))


def extract_terms(value: Column, field: str) -> Column:
    """The terms of one cell: the items of a list field, the phrases of any other."""
    return list_terms(value) if field in COMPOUND_FIELDS else phrases(value)


def filter_form(term: Column) -> Column:
    """Lower case, slashes and hyphens made spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(term), "[/-]", " "), r"\s+", " "))


def is_excluded(term: Column) -> Column:
    """Terms below three characters, fixed excluded terms, identifiers and parts of dates."""
    value = filter_form(term)
    hexes = r"^[a-f0-9]{8}(?:[ -]?[a-f0-9]{4}){3}[ -]?[a-f0-9]{12}$"
    date = r"^(?:\d{4}|\d{4}\s+\d{1,2}\s+\d{1,2}|\d{1,2}\s+\d{1,2}\s+\d{2,4})$"
    return (F.length(value) < 3) | value.isin(EXCLUDED_TERMS) | value.rlike(hexes) | value.rlike(date)


def is_sensor_term(term: Column) -> Column:
    """Terms that have a sensor word in them and are no mere streams."""
    value = filter_form(term)
    return ~value.isin(NOISY_STREAMS) & F.exists(literals(SENSOR_TERMS), lambda word: value.contains(word))


def field_form(name: Column) -> Column:
    """Lower-case letters and digits, anything else as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def block_keys(term: Column) -> Column:
    """Keys under which terms are compared: words that are not too common, synonyms, and always the first word."""
    tokens = F.split(term, " ")
    kept = F.filter(tokens, lambda t: ~t.isin(BLOCK_STOP_TOKENS))
    canonical = F.filter(F.array(lookup(SYNONYMS, term)), lambda t: t.isNotNull())
    back: dict[str, list[str]] = {}
    for alias, meant in SYNONYMS.items():
        back.setdefault(meant, []).append(alias)
    aliases = F.coalesce(
        F.try_element_at(F.create_map(*(x for k, v in back.items() for x in (F.lit(k), literals(v)))), term),
        F.array().cast("array<string>"),
    )
    keys = F.concat(kept, canonical, aliases, F.array(F.get(tokens, F.lit(0))))
    return F.array_distinct(F.filter(keys, lambda key: F.length(key) >= 3))
