"""Texts that were cut off by a field limit or in transfer.

A backward character n-gram model tells how likely a unit (line, list entry, text) ends after a given final context, or
goes on. It counts every position of all distinct texts: what precedes a line end ends, what precedes any other character
goes on. Only contexts that some text ends with are asked for, so only those are counted; the counts are joined to the
texts. Each text's final context is scored by the log-odds of the two, backed off from long contexts to short ones. Over all texts, expectation and maximisation on the score counts of each
language gives the share of cut texts, which sets that language's threshold, and the lengths at which the texts of a source
pile up count as evidence. Scoring is row by row; only score counts and length counts are gathered.
"""

from __future__ import annotations

import functools
import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint
from lexistrata.llm.bits import key_filter, may_hold

#: Lengths of the contexts counted.
ORDERS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17)
#: Characters that a task counts at a time, and distinct contexts that it holds before it hands their counts on.
CHUNK_CHARS = 500_000
HELD_CONTEXTS = 1_500_000
#: Weight of the shorter context's estimate against counts of the longer one.
BACK_OFF = 3.0
_BASE = 0x9E3779B97F4A7C15
#: The code of no character; one more is 0, as for a place before a text.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BULLET = re.compile(r"^\s*(?:[-*•–·]|\d+[.)])\s")
_BROKEN = re.compile(r"(?:\\u[0-9a-fA-F]{0,3}|\\|&#?\w{0,8}|<[^<>\n]{0,200}|[�\x00-\x08\x0e-\x1f])+$")
_MARK = re.compile(r"\s*(?:\.{3,}|…)$")
_CLOSING = re.compile(r"</[a-zA-Z]+\s*>\s*$")
_RUNS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")
_NINES = {ord(d): "9" for d in "012345678"}
#: Final characters that decide how a text ends; more are read where no line starts among them.
FINAL = 4_000
#: An end counts once for all texts that agree in so many final characters: copies cut alike are one example.
TAIL = 120


def units(text: str) -> tuple[str, bool]:
    """A text with one line a unit, digits masked, and whether it ends in a broken character, entity or tag."""
    text = re.sub(r"(?:\s*</?(?:p|li|ul|ol|div|br|h\d)\s*/?>\s*)+", "\n", text)
    text = text.replace("​", "").replace("﻿", "")
    text = text.strip()
    broken = bool(_BROKEN.search(text))
    if broken:
        text = _BROKEN.sub("", text).rstrip()
    text = _MARK.sub("", text)
    text = _RUNS.sub(" ", text)
    text = re.sub(r" ?\n[\s]*", "\n", text)
    return text.translate(_NINES) if text.isascii() else re.sub(r"\d", "9", text), broken


def final_units(text: str) -> tuple[str, bool]:
    """What ``units`` gives, of a long text only its last lines: the same for all that is asked of a text's end."""
    if len(text) > FINAL:
        start = text.find("\n", len(text) - FINAL, len(text) - FINAL // 2)
        if start >= 0:
            unit, broken = units(text[start:])
            if len(unit) > FINAL // 8:
                return unit, broken
    return units(text)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character codes behind a line start, and for each whether its line is a list entry."""
    lines = text.split("\n")
    codes = np.frombuffer(("\n" + text).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    listed = np.concatenate([np.full(len(line) + 1, bool(_BULLET.match(line)), bool) for line in lines])
    return codes, listed


def contexts(codes: np.ndarray, listed: np.ndarray, at: np.ndarray, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the places among ``at`` and a hash of the characters that end there; contexts stop at the text's start.

    With a filter of the contexts asked for, a place goes on to longer contexts only while its shorter ones are asked for:
    whoever asks for a context asks for all shorter ones that it ends with.
    """
    kept = np.arange(len(at))
    total = (listed[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    power = 1
    for k in range(1, ORDERS[-1] + 1):
        place = at[kept] - (k - 1)
        char = np.where(place >= 0, codes[np.maximum(place, 0)] + np.uint64(1), np.uint64(0))
        power = power * _BASE % (1 << 64)
        total = total + (char ^ (char << np.uint64(21))) * np.uint64(power)
        if k in ORDERS:
            mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashed = ((mixed ^ (mixed >> np.uint64(32))) + np.uint64(k)).view(np.int64)
            if asked is not None:
                hit = may_hold(asked, hashed)
                kept, total, hashed = kept[hit], total[hit], hashed[hit]
            yield kept, hashed


def _tails(units_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, list entries and places of the final contexts of some texts, as ``contexts`` takes them."""
    wide = ORDERS[-1]
    codes = np.full((len(units_), wide), _NONE)
    for row, unit in zip(codes, units_, strict=True):
        tail = np.frombuffer(("\n" + unit)[-wide:].encode("utf-32-le", "replace"), np.uint32)
        row[wide - len(tail) :] = tail
    listed = np.array([bool(_BULLET.match(unit[unit.rfind("\n") + 1 :])) for unit in units_], bool)
    return codes.ravel(), np.repeat(listed, wide), np.arange(len(units_)) * wide + wide - 1


def _hashes(units_: list[str]) -> np.ndarray:
    return np.stack([hashed for _, hashed in contexts(*_tails(units_))], axis=1) if units_ else np.empty((0, len(ORDERS)), np.int64)


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text, log-odds that need no counts, else its final contexts and which of them it has itself.

    A link that ends a text is looked up with spaces for its other marks, so that its longer contexts need not be among
    the text's own.
    """
    for batch in batches:
        ends = [final_units(text) for text in batch["_text"]]
        fixed = [30.0 if broken else None if unit else 0.0 for unit, broken in ends]
        open_ = [i for i, value in enumerate(fixed) if value is None]
        last = [ends[i][0].rpartition(" ")[2].rpartition("\n")[2] for i in open_]
        own = _hashes([ends[i][0] for i in open_])
        asked = _hashes([re.sub(r"\W+", " ", word) if "://" in word else ends[i][0] for i, word in zip(open_, last, strict=True)])
        keys, mine, link = [[] for _ in ends], [[] for _ in ends], [False] * len(ends)
        for row, i in enumerate(open_):
            keys[i], mine[i], link[i] = asked[row].tolist(), (asked[row] == own[row]).tolist(), "://" in last[row]
        yield batch[["_hash"]].assign(fixed=pd.array(fixed, "Float64"), link=link, keys=keys, own=mine)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
    """The texts in lists of about as many characters, so that memory does not depend on the batch."""
    held, size = [], 0
    for batch in batches:
        for text in batch["_text"]:
            held.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Counts:
    """Goings-on counted by context, those before a word's end apart, added up over the texts of a task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray | None, apart: np.ndarray) -> None:
        codes, found = pd.factorize(key)
        many = np.bincount(codes, n, len(found)).astype(np.int64)
        self.parts.append((found, many, np.bincount(codes, apart, len(found)).astype(np.int64)))
        self.size += len(found)

    def combine(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def frame(self) -> pd.DataFrame:
        self.combine()
        parts, self.parts, self.size = self.parts, [], 0
        key, n, apart = parts[0] if parts else (np.empty(0, np.int64),) * 3
        return pd.DataFrame({"order": 1, "k": key, "tail": pd.array([None] * len(key), "Int64"), "n": n, "w": apart})


@functools.lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    """For every code point, whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _counter(asked: Broadcast):  # noqa: ANN202
    """Counts of the contexts in the filter: of goings-on for each context, of ends a row for each tail."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, counts, positions = _alphanumeric(), _Counts(), 0
        for texts in _chunks(batches):
            pieces, seen_tails = [], []
            for text in texts:
                unit, broken = units(text)
                if not unit:
                    continue
                codes, listed = _codes(unit)
                ended = np.append(codes[1:] == 10, not broken) & (codes != 10)
                whole = "\n" + unit
                own = np.zeros(len(codes), np.int64)
                own[ended] = [xxhash.xxh64_intdigest(whole[max(0, i + 1 - TAIL) : i + 1].encode("utf-8", "replace")) >> 1 for i in np.flatnonzero(ended)]
                seen_tails.append(own[ended])
                # The characters before a text's start are none: a gap as long as the longest context parts the texts.
                pieces.append((codes, listed, ended, own))
            if not pieces:
                continue
            gap = ORDERS[-1]
            codes = np.concatenate([np.concatenate([np.full(gap, _NONE), c]) for c, _, _, _ in pieces])
            listed, ended, own = (np.concatenate([np.concatenate([np.zeros(gap, p[i].dtype), p[i]]) for p in pieces]) for i in (1, 2, 3))
            at = np.flatnonzero((codes != 10) & (codes != _NONE))
            following, after = np.append(codes[1:], _NONE), np.ones(len(codes), bool)
            inside = following != _NONE
            after[inside] = ~letters[following[inside].astype(np.int64)]
            positions += int((~ended[at]).sum())
            keys, ends = [], []
            for kept, hashed in contexts(codes, listed, at, asked.value):
                place = at[kept]
                on = ~ended[place]
                keys.append((hashed[on], after[place[on]]))
                ends.append((hashed[~on], own[place[~on]]))
            counts.add(np.concatenate([k for k, _ in keys]), None, np.concatenate([w for _, w in keys]))
            if counts.size > HELD_CONTEXTS:
                counts.combine()
                if counts.size > HELD_CONTEXTS // 2:
                    yield counts.frame()
            both = pd.DataFrame({"k": np.concatenate([k for k, _ in ends]), "tail": np.concatenate([t for _, t in ends])}).drop_duplicates()
            yield both.assign(order=1, n=0, w=0, tail=both["tail"].astype("Int64"))[["order", "k", "tail", "n", "w"]]
            # Order 0, the context of nothing, gives the base rate.
            once = np.unique(np.concatenate(seen_tails))
            yield pd.DataFrame({"order": 0, "k": 0, "tail": pd.array(once, "Int64"), "n": 0, "w": 0})
        yield counts.frame()
        yield pd.DataFrame({"order": [0], "k": [0], "tail": pd.array([None], "Int64"), "n": [positions], "w": [0]})

    return count


def text_odds(texts: DataFrame) -> DataFrame:
    """``_hash, log_odds, _fixed``: for every distinct text, by its hash, the log-odds that it goes on over that it ends.

    ``texts`` has the column ``_text``, without nulls and blanks. All distinct texts are counted. An end counts in how many
    distinct tails it occurred; one is taken off where the context is the text's own, so that neither a text nor a copy of
    one vouches for itself. Contexts that occurred once, or up to twice without an end, count as not seen.
    """
    distinct = checkpoint(
        texts.select(F.xxhash64("_text").alias("_hash"), "_text").groupBy("_hash").agg(F.min("_text").alias("_text"))
    )
    asks = checkpoint(distinct.mapInPandas(_ask, "_hash long, fixed double, link boolean, keys array<long>, own array<boolean>"))
    places = asks.select("_hash", "link", F.posexplode(F.arrays_zip("keys", "own")).alias("i", "c")).select(
        "_hash", "link", "i", F.col("c.keys").alias("k"), F.col("c.own").alias("own")
    )
    asked = checkpoint(places.select("k").distinct())
    counted = checkpoint(
        distinct.mapInPandas(_counter(key_filter(asked, "k")), "order int, k long, tail long, n long, w long")
        .groupBy("order", "k", "tail")
        .agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        .groupBy("order", "k")
        .agg(F.count("tail").alias("e"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    )
    total = counted.where("order = 0").agg(F.sum("e").alias("ended"), F.sum("n").alias("on")).first()
    base = min(max(total.ended / (total.ended + total.on), 1e-4), 0.5) if total.ended else 0.01
    known = counted.where("order = 1 and (e > 0 or n > 2) and e + n > 1").select(
        "k", "e", (F.col("e") + F.col("n")).alias("n"), (F.col("e") + F.col("w")).alias("w")
    )
    met = places.join(known, "k", "left").groupBy("_hash").agg(
        F.array_sort(F.collect_list(F.struct("i", F.when(F.col("link"), F.col("w")).otherwise(F.col("e")).alias("e"), "n", "own"))).alias("c")
    )
    first = F.when(F.col("link"), 0.2).otherwise(base)  # a link may end after any whole word

    def back_off(p, c):  # noqa: ANN001, ANN202
        off = F.when(c["own"], F.least(c["e"], F.lit(1))).otherwise(0)
        return F.when(c["n"].isNull(), p).otherwise((c["e"] - off + BACK_OFF * p) / (c["n"] - off + BACK_OFF))

    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.aggregate("c", first.cast("double"), back_off)))
    odds = F.log((1 - p) / p) - F.log((1 - first) / first)
    return asks.join(met, "_hash", "left").select("_hash", F.coalesce("fixed", odds).alias("log_odds"), F.col("fixed").isNotNull().alias("_fixed"))


def cut_share(odds: np.ndarray, n: np.ndarray, rounds: int = 60) -> float:
    """The share of cut texts of a group from counts of its log-odds, by expectation and maximisation."""
    total, share = n.sum(), 0.1
    for _ in range(rounds):
        cut = (n / (1 + np.exp(-np.clip(odds + math.log(share / (1 - share)), -50, 50)))).sum()
        share = min(0.9, max(0.001, (cut + 0.1) / (total + 1)))
    return share


def _shares(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"_name": [group["_name"].iloc[0]], "_share": [cut_share(group["_odds"].to_numpy(), group["_n"].to_numpy())]})


def score_texts(df: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """``key, source, lang, log_odds, evidence, cut`` of every text that is not null or blank.

    ``log_odds`` is for going on, ``evidence`` adds the language's share of cut texts and the source's length limit, and
    ``cut`` is whether evidence is positive. Null languages and sources are groups of their own; repeated keys repeat
    their rows; very long texts are read whole, their last line is scored. An empty table gives no rows.
    """
    language = F.coalesce(F.lower(F.trim(F.col(lang))), F.lit("und"))
    rows = df.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), language.alias("_lang"), F.col(source).alias("_source")
    ).where(F.col("_text").rlike(r"(?U)\S"))
    measured = rows.select(
        "_key", "_lang", "_source", F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_chars"),
        F.col("_text").rlike(r"(?U)(?:(?<!\.\.)[.?!)\]»”\"':;>])\s*$").alias("_closed"),
        F.col("_text").rlike("(?U)" + _CLOSING.pattern).alias("_tag"),
    )
    # A closing tag at the end weighs on the score of texts that needed counts.
    joined = measured.join(text_odds(rows), "_hash")
    odds = F.col("log_odds") - F.when(F.col("_tag") & ~F.col("_fixed"), 10.0).otherwise(0.0)
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))
    scored = checkpoint(joined.select("_key", "_lang", "_source", "_chars", "_closed", bounded.alias("log_odds")))
    # Ends that close a sentence and ends that do not are judged apart in each language.
    group = F.concat("_lang", F.when(F.col("_closed"), ".").otherwise(""))
    # A group has at most one row for each tenth between the bounds, whatever the number of its texts.
    histogram = scored.groupBy(group.alias("_name"), F.round("log_odds", 1).alias("_odds")).agg(F.count("*").alias("_n"))
    shares = histogram.groupBy("_name").applyInPandas(_shares, "_name string, _share double")
    scored = scored.withColumn("_name", group).join(shares, "_name")
    prior = F.log(F.col("_share") / (1 - F.col("_share")))
    # A length that a source's texts reach far more often than the lengths around it is a limit.
    lengths = scored.groupBy("_source", "_chars").agg(F.count("*").alias("_at"))
    near = lengths.groupBy("_source", F.floor(F.col("_chars") / 64).alias("_near")).agg(
        F.sum("_at").alias("_around"), F.count("*").alias("_lengths")
    )
    limits = (
        lengths.withColumn("_near", F.floor(F.col("_chars") / 64))
        .join(near, ["_source", "_near"])
        .where((F.col("_at") >= 5) & (F.col("_at") * 64 >= 12 * (F.col("_around") - F.col("_at") + 4)))
        .select(F.col("_source").alias("_s"), F.col("_chars").alias("_c"), F.lit(True).alias("_limit"))
    )
    judged = scored.join(
        limits, scored["_source"].eqNullSafe(F.col("_s")) & (scored["_chars"] == F.col("_c")), "left"
    )
    bump = F.when(F.col("_limit") & ~F.col("_closed"), 3.0).otherwise(0.0)
    evidence = F.col("log_odds") + prior + bump
    return judged.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("_lang").alias("lang"),
        "log_odds",
        evidence.alias("evidence"),
        (evidence > 0).alias("cut"),
        F.coalesce("_limit", F.lit(False)).alias("at_limit"),
    )
