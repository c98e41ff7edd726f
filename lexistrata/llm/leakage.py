"""Passages of evaluation items inside corpus texts.

Texts and passages are brought to the same words. Windows on a ladder of lengths get a SimHash fingerprint of 64 bits: of a
passage every window, of a text every window that starts at a multiple of a quarter of its length, so that a stretch of a
window and a quarter always holds a window that the passage has too. Fingerprints are compared within a radius that grows
with the length: short windows must be almost the same, longer ones bear a changed word or two, which moves about seven bits
of a window of 16. The passages' fingerprints are indexed under four blocks of 16 bits, and under every variant of a block
that the radius allows: two fingerprints within the radius agree in one block up to a fourth of it, so that none is missed.
Every (text, item) so found is verified exactly by the weighted share of the passage's words that lie in shingles common to
both; a shingle weighs less the more passages hold it, but never nothing.

A bounded index goes to every worker and texts are read once, never shuffled. A larger set of items is joined by block.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint

#: Window lengths with their radius in bits; each length is twice the one before.
LADDER = {8: 3, 16: 7, 32: 7}
BLOCKS = 4
WIDTH = 64 // BLOCKS
SHINGLE = 4
#: Words of passages up to which the index is sent to every worker.
INDEX_WORDS = 200_000
#: Words that are fingerprinted at a time; a multiple of every step.
SLICE = 1 << 16

_TAG = re.compile(r"<[^<>]{1,200}>")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W_]+")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")


def plain_words(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, accents, invisible characters and line-end hyphens."""
    if not text:
        return []
    if "\\u" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    if "-\n" in text:
        text = re.sub(r"(?<=\w)-\n\s*(?=[a-z])", "", text)
    return _WORD.findall(text.lower())


def _signs(word: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(xxhash.xxh64_digest(word.encode("utf-8", "replace")), np.uint8))
    return bits.astype(np.int8) * 2 - 1


def _packed(total: np.ndarray) -> np.ndarray:
    return np.packbits(total > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


class Fingerprints:
    """SimHash of word windows; keeps the bit signs of a bounded number of words."""

    def __init__(self, remember: int = 500_000) -> None:
        self.number: dict[str, int] = {}
        self.signs = np.zeros((1024, 64), np.int8)
        self.remember = remember

    def _codes(self, words: Sequence[str]) -> np.ndarray:
        if len(self.number) > self.remember:
            self.number.clear()
        codes = list(map(self.number.get, words))
        if None in codes:
            for i, code in enumerate(codes):
                if code is None:
                    word = words[i]
                    code = self.number.get(word)
                    if code is None:
                        code = self.number[word] = len(self.number)
                        if code >= len(self.signs):
                            self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
                        self.signs[code] = _signs(word)
                    codes[i] = code
        return np.array(codes, np.int64)

    def every(self, words: Sequence[str], window: int) -> np.ndarray:
        """The fingerprint of every window, by its first word; empty where the words are fewer."""
        if len(words) < window:
            return np.empty(0, np.uint64)
        codes = self._codes(words)  # may grow the signs
        upto = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(self.signs[codes], axis=0, dtype=np.int32)])
        return _packed(upto[window:] - upto[:-window])

    def stepped(self, words: Sequence[str]) -> dict[int, np.ndarray]:
        """For each length of the ladder, the fingerprints of the windows that start at multiples of a quarter of it."""
        codes, overlap = self._codes(words), max(LADDER)
        found: dict[int, list[np.ndarray]] = {window: [] for window in LADDER}
        for first in range(0, len(codes), SLICE):
            part = self.signs[codes[first : first + SLICE + overlap]]  # sums stay within a byte
            size = 1
            for window in LADDER:
                step = window // 4
                while size < step:
                    even = len(part) // 2 * 2
                    part = part[0:even:2] + part[1:even:2]
                    size *= 2
                n = min(len(part) - 3, SLICE // step)
                if n > 0:
                    found[window].append(_packed(part[:n] + part[1 : n + 1] + part[2 : n + 2] + part[3 : n + 3]))
        return {window: np.concatenate(parts) if parts else np.empty(0, np.uint64) for window, parts in found.items()}


def block_variants(block: np.ndarray, radius: int) -> list[np.ndarray]:
    """The values of a block within a fourth of the radius, the block itself first."""
    out = []
    for flips in range(radius // BLOCKS + 1):
        for bits in itertools.combinations(range(WIDTH), flips):
            out.append(block ^ sum(1 << b for b in bits))
    return out


def block_of(hashes: np.ndarray, block: int) -> np.ndarray:
    """One block of bits of each fingerprint."""
    return ((hashes >> np.uint64(block * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def shingle_weights(passages: Sequence[Sequence[str]]) -> dict[tuple[str, ...], float]:
    """The weight of every shingle by the inverse of how many different passages hold it: 1 for one, never 0."""
    held: dict[tuple[str, ...], int] = {}
    different = {tuple(words) for words in passages}
    for words in different:
        for shingle in set(shingle_list(words)):
            held[shingle] = held.get(shingle, 0) + 1
    most = math.log(len(different) + 1)  # a single passage has weights of 1
    return {shingle: math.log((len(different) + 1) / n) / most for shingle, n in held.items()}


def word_weights(weight: Sequence[float]) -> np.ndarray:
    """The weight of every word of a passage from those of its shingles: as much as the heaviest shingle it is in."""
    each = np.asarray(weight, float)
    heavy = np.zeros(len(each) + SHINGLE - 1 if len(each) else 0)
    for k in range(SHINGLE if len(each) else 0):
        heavy[k : k + len(each)] = np.maximum(heavy[k : k + len(each)], each)
    return heavy


def passage_share(own: Sequence[tuple[str, ...]], heavy: np.ndarray, shingles: set[tuple[str, ...]]) -> float:
    """Weighted share of a passage's words in shingles that a text has too; gaps of up to two words between them count.

    ``own`` are the passage's shingles in order, ``heavy`` are the weights of its words.
    """
    hit = np.fromiter((shingle in shingles for shingle in own), bool, len(own))
    if not hit.any():
        return 0.0
    covered = np.zeros(len(heavy), bool)
    for k in range(SHINGLE):
        covered[k : k + len(hit)] |= hit
    at = np.flatnonzero(covered)
    for gap in np.flatnonzero((np.diff(at) > 1) & (np.diff(at) <= 3)):  # a small edit inside a stretch
        covered[at[gap] : at[gap + 1]] = True
    return float(heavy[covered].sum() / heavy.sum())


def shingle_list(words: Sequence[str]) -> list[tuple[str, ...]]:
    """All shingles of a text in order."""
    return list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


class ShortPassages:
    """Passages below the shortest window: they must occur whole."""

    def __init__(self, passages: dict[int, list[str]]) -> None:
        self.by_first: dict[str, list[tuple[int, list[str]]]] = {}
        for item, words in passages.items():
            if 0 < len(words) < min(LADDER):
                self.by_first.setdefault(words[0], []).append((item, words))

    def within(self, words: Sequence[str]) -> list[tuple[int, float]]:
        """The items whose passage stands in ``words``."""
        if not self.by_first:
            return []
        found = {i for k, word in enumerate(words) for i, short in self.by_first.get(word, ()) if words[k : k + len(short)] == short}
        return [(item, 1.0) for item in sorted(found)]


class ItemIndex:
    """Fingerprints of all passages under each block of bits, and what verifying them takes."""

    def __init__(self, items: Sequence[tuple[int, str | None]]) -> None:
        self.words = {item: plain_words(passage) for item, passage in items}
        self.short = ShortPassages(self.words)
        weights = shingle_weights(list(self.words.values()))
        self.shingles = {item: shingle_list(words) for item, words in self.words.items()}
        self.weight = {item: word_weights([weights[s] for s in own]) for item, own in self.shingles.items()}
        prints = Fingerprints()
        self.hashes, self.owners, self.blocks = {}, {}, {}
        for window, radius in LADDER.items():
            found = [(item, prints.every(words, window)) for item, words in self.words.items()]
            hashes = np.concatenate([h for _, h in found] or [np.empty(0, np.uint64)])
            self.owners[window] = np.concatenate([np.full(len(h), item, np.int64) for item, h in found] or [np.empty(0, np.int64)])
            self.hashes[window], self.blocks[window] = hashes, []
            for block in range(BLOCKS):
                variants = block_variants(block_of(hashes, block), radius)
                value, entry = np.concatenate(variants), np.tile(np.arange(len(hashes), dtype=np.int32), len(variants))
                order = np.argsort(value, kind="stable")
                starts = np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)).astype(np.int32)
                self.blocks[window].append((entry[order], starts))

    def near(self, prints: Sequence[dict[int, np.ndarray]]) -> list[set[int]]:
        """For each of some texts, the items that have a window within the radius of one of its windows."""
        items: list[set[int]] = [set() for _ in prints]
        for window, radius in LADDER.items():
            hashes = np.concatenate([p[window] for p in prints])
            text = np.repeat(np.arange(len(prints)), [len(p[window]) for p in prints])
            for first in range(0, len(hashes), SLICE):
                some, place = hashes[first : first + SLICE], text[first : first + SLICE]
                for block, (entries, starts) in enumerate(self.blocks[window]):
                    value = block_of(some, block)
                    begin = starts[value]
                    each = starts[value + 1] - begin
                    upto = np.cumsum(each, dtype=np.int64)
                    entry = entries[np.arange(upto[-1]) + np.repeat(begin - (upto - each), each)]
                    ok = np.flatnonzero(np.bitwise_count(np.repeat(some, each) ^ self.hashes[window][entry]) <= radius)
                    texts, owners = place[np.searchsorted(upto, ok, side="right")], self.owners[window][entry[ok]]
                    for t, item in set(zip(texts.tolist(), owners.tolist(), strict=True)):
                        items[t].add(item)
        return items

    def leaks(self, words: Sequence[str], items: set[int], least: float) -> list[tuple[int, float]]:
        """Of the candidate ``items``, those of which ``words`` give away at least the share ``least``."""
        whole = self.short.within(words)
        if not items:
            return whole
        shingles = set(shingle_list(words))
        scored = ((item, passage_share(self.shingles[item], self.weight[item], shingles)) for item in sorted(items))
        return whole + [(item, share) for item, share in scored if share >= least]


def text_batches(names: Sequence, bodies: Sequence[str], most: int = 1 << 17) -> Iterator[tuple[list, list[list[str]]]]:
    """The keys and words of texts in lists of about ``most`` words."""
    keys, texts, size = [], [], 0
    for name, body in zip(names, bodies, strict=True):
        keys.append(name)
        texts.append(plain_words(body))
        size += len(texts[-1])
        if size >= most:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _broadcast_search(rows: DataFrame, items: list[tuple[int, str | None]], kinds: str, least: float) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(ItemIndex(items))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, prints = held.value, Fingerprints()
        for batch in batches:
            for keys, texts in text_batches(batch["_key"], batch["_text"]):
                near = index.near([prints.stepped(words) for words in texts])
                found = [(k, i, s) for k, words, some in zip(keys, texts, near, strict=True) for i, s in index.leaks(words, some, least)]
                yield pd.DataFrame(found, columns=["_key", "_item", "share"])

    return rows.mapInPandas(search, kinds)


def _joined_search(rows: DataFrame, items: DataFrame, kinds: str, least: float) -> DataFrame:
    """The same for more items than a worker should hold: windows meet by block, only candidates meet their texts."""
    spark = rows.sparkSession
    key_kind, item_kind = dict(rows.dtypes)["_key"], dict(items.dtypes)["_item"]

    def windows(every: bool):  # noqa: ANN202
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            prints = Fingerprints()
            for batch in batches:
                for name, body in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                    words = plain_words(body)
                    made = {w: prints.every(words, w) for w in LADDER} if every else prints.stepped(words)
                    for window, hashes in made.items():
                        hashes = np.unique(hashes)
                        for block in range(BLOCKS):
                            value = block_of(hashes, block)
                            for variant in block_variants(value, LADDER[window] if every else 0):
                                yield pd.DataFrame({"_id": name, "_at": (window * BLOCKS + block) * (1 << WIDTH) + variant, "_h": hashes.view(np.int64)})

        return of

    asked = checkpoint(items.mapInPandas(windows(True), f"_id {item_kind}, _at long, _h long").withColumnRenamed("_id", "_item"))
    # A block value that many windows have is met by its fingerprints once, not once a text and an item.
    of_items = asked.select("_at", F.col("_h").alias("_g")).distinct()
    given = rows.mapInPandas(windows(False), f"_id {key_kind}, _at long, _h long").join(of_items.select("_at").distinct(), "_at", "left_semi")
    given = checkpoint(given.withColumnRenamed("_id", "_key"))
    radius = F.element_at(F.create_map(*(F.lit(x) for pair in LADDER.items() for x in pair)), F.shiftright("_at", WIDTH + 2).cast("int"))
    near = given.select("_at", "_h").distinct().join(of_items, "_at").where(F.bit_count(F.col("_h").bitwiseXOR(F.col("_g"))) <= radius).select("_h", "_g").distinct()
    found = given.select("_key", "_h").distinct().join(near, "_h").join(asked.select("_item", F.col("_h").alias("_g")).distinct(), "_g").select("_key", "_item").distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [plain_words(body) for body in batch["_passage"]]
            rows_ = [(i, k, " ".join(w[k : k + SHINGLE])) for i, w in zip(batch["_item"], words, strict=True) for k in range(len(w) - SHINGLE + 1)]
            yield pd.DataFrame(rows_, columns=["_item", "_k", "_s"])

    # Weights come from counts over all passages; each item then carries its own.
    texts = items.select("_item", "_passage")
    shingles = checkpoint(texts.mapInPandas(cut, f"_item {item_kind}, _k int, _s string"))
    copies = texts.select("_item", F.xxhash64("_passage").alias("_p"))
    held = shingles.join(copies, "_item").groupBy("_s").agg(F.count_distinct("_p").alias("n"))
    total = copies.agg(F.count_distinct("_p")).first()[0]
    weight = F.log((F.lit(total) + 1) / F.col("n")) / F.log(F.lit(total) + 1)
    weights = shingles.join(held, "_s").groupBy("_item").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", weight.alias("w")))), lambda x: x["w"]).alias("_weight"))
    pairs = found.join(texts, "_item").join(weights, "_item").join(rows, "_key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = [
                passage_share(shingle_list(plain_words(p)), word_weights(w), set(shingle_list(plain_words(t))))
                for p, w, t in zip(batch["_passage"], batch["_weight"], batch["_text"], strict=True)
            ]
            kept = batch[["_key", "_item"]].assign(share=share)
            yield kept[kept["share"] >= least]

    short = [(r._item, r._passage) for r in texts.where(F.size(F.split(F.trim("_passage"), r"\s+")) < min(LADDER)).toLocalIterator()]
    out = pairs.select("_key", "_item", "_passage", "_weight", "_text").mapInPandas(verify, kinds)
    held_short = spark.sparkContext.broadcast(ShortPassages({i: plain_words(p) for i, p in short}))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(k, i, s) for k, body in zip(batch["_key"], batch["_text"], strict=True) for i, s in held_short.value.within(plain_words(body))]
            yield pd.DataFrame(hits, columns=["_key", "_item", "share"])

    return out.unionByName(rows.mapInPandas(whole, kinds)) if short else out


def leaked_items(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, *, least: float = 0.4, index_words: int = INDEX_WORDS
) -> DataFrame:
    """``key, item, share``: every text that reproduces at least ``least`` of the words of an item's passage.

    Stretches of passages, apart from case, accents, markup and small edits, are found anywhere in the whole text. Every
    copy of a text is reported. Null, empty and short texts and passages without words leak nothing; a passage shorter
    than the shortest window must occur whole. Item numbers are unique; repeated keys repeat their rows; no items or no
    texts, no rows. Up to ``index_words`` words of passages go to every worker, more are joined: results are the same.
    """
    rows = corpus.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    asked = items.select(F.col(item).alias("_item"), F.col(passage).alias("_passage")).where(F.length("_passage") > 0)
    kinds = f"_key {dict(rows.dtypes)['_key']}, _item {dict(asked.dtypes)['_item']}, share double"
    words = asked.agg(F.sum(F.size(F.split("_passage", r"\s+")))).first()[0] or 0
    if words <= index_words:
        out = _broadcast_search(rows, [(r._item, r._passage) for r in asked.collect()], kinds, least)
    else:
        out = _joined_search(rows, asked, kinds, least)
    return out.select(F.col("_key").alias(key), F.col("_item").alias(item), "share")
