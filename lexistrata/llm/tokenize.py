"""Token ids of a byte-level BPE vocabulary for a whole corpus.

The words of the corpus are counted (built-in expressions, combined before the shuffle); the most frequent ones are
encoded once and compiled into a minimal acyclic transducer: an automaton whose equal suffixes are shared and whose
states count the words below them, so that a walk gives the word's number and with it its ids. The transducer is a few
flat arrays in the shared folder, memory-mapped by every Python worker. Texts are cut into words, the distinct words of
a batch walk the automaton together, and words that it does not hold are merged exactly by rank.
"""

from __future__ import annotations

import base64
import heapq
import os
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.engine import unique_path

#: Where the public vocabularies lie; only a default, every function takes a path.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which this vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are cut into words at a time.
SLICE = 2_000_000
ARRAYS = ("keys", "targets", "skips", "final", "starts", "ids")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, the rank of a merge, from a file of base64 tokens."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: neighbours are joined in order of rank, leftmost first. Time n log n in the length."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it was joined to its left
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if i:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compile_transducer(words: Sequence[bytes], outputs: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of ``words`` with their outputs; both are put in byte order first.

    Suffixes are shared while the words come in order, so that only the last word's path is ever unshared. Transitions
    are kept as sorted ``keys`` (state * 256 + byte) with ``targets`` and ``skips``, the words passed over by taking one.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    below: list[int] = []
    known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}

    def settle(node: list) -> int:
        state = (node[0], tuple(node[1]))
        if state not in known:
            known[state] = len(states)
            states.append(state)
            below.append(int(state[0]) + sum(below[target] for _, target in state[1]))
        return known[state]

    path: list[list] = [[False, []]]
    last = b""
    kept = []
    for k in order:
        word = words[k]
        if kept and word == last:
            continue
        common = len(os.path.commonprefix([word, last]))
        while len(path) - 1 > common:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
        kept.append(k)
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])
    keys, targets, skips = [], [], []
    number = [root, *(s for s in range(len(states)) if s != root)]
    place = {s: i for i, s in enumerate(number)}  # the root is state 0
    for i, s in enumerate(number):
        final, steps = states[s]
        passed = int(final)
        for byte, target in steps:
            keys.append(i * 256 + byte)
            targets.append(place[target])
            skips.append(passed)
            passed += below[target]
    lengths = [len(outputs[k]) for k in kept]
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int64),
        "skips": np.array(skips, np.int64),
        "final": np.array([states[s][0] for s in number], bool),
        "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for k in kept for i in outputs[k]], np.int32),
    }


def look_up(fst: dict[str, np.ndarray], words: Sequence[bytes]) -> np.ndarray:
    """The number of each word in the transducer, -1 for words that it does not hold; all walk together."""
    n = len(words)
    found = np.full(n, -1, np.int64)
    keys = fst["keys"]
    if not n or not len(keys):
        return found
    lengths = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    alive = np.flatnonzero(lengths > 0)
    state = np.zeros(n, np.int64)
    number = np.zeros(n, np.int64)
    step = 0
    while len(alive):
        key = state[alive] * 256 + flat[begins[alive] + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[at] == key
        alive, at = alive[ok], at[ok]
        state[alive] = fst["targets"][at]
        number[alive] += fst["skips"][at]
        step += 1
        ended = lengths[alive] == step
        done = alive[ended]
        done = done[fst["final"][state[done]]]
        found[done] = number[done]
        alive = alive[~ended]
    return found


def frequent_words(df: DataFrame, text: str, most: int, longest: int = 40) -> list[str]:
    """The ``most`` frequent words of the whole column, of at most ``longest`` characters."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))).alias("word"))
    counted = words.where(F.length("word") <= longest).groupBy("word").count()
    return [row.word for row in counted.orderBy(F.desc("count"), "word").limit(most).collect()]


def publish(spark: SparkSession, arrays: dict[str, np.ndarray]) -> tuple[str, bool]:
    """Write the arrays where workers can map them: into the shared folder, or through Spark's own file service.

    The second value tells that workers must ask Spark for the folder, which a store without file paths needs.
    """
    target = urlparse(unique_path(spark, "transducer"))
    shipped = target.scheme not in ("", "file")
    folder = Path(tempfile.mkdtemp()) / Path(target.path).name if shipped else Path(target.path)
    folder.mkdir(parents=True)
    for name in ARRAYS:
        np.save(folder / f"{name}.npy", arrays[name])
    if shipped:
        spark.sparkContext.addFile(str(folder), recursive=True)
        return folder.name, True
    return str(folder), False


def open_transducer(place: tuple[str, bool]) -> dict[str, np.ndarray]:
    """The memory-mapped arrays of a published transducer."""
    folder = Path(SparkFiles.get(place[0]) if place[1] else place[0])
    return {name: np.load(folder / f"{name}.npy", mmap_mode="r") for name in ARRAYS}


class Encoder:
    """Encodes batches of texts in a worker; remembers a bounded number of merged words."""

    def __init__(self, fst: dict[str, np.ndarray], ranks: dict[bytes, int], remember: int = 200_000) -> None:
        self.fst, self.ranks, self.remember = fst, ranks, remember
        self.pattern = regex.compile(WORDS)
        self.merged: dict[bytes, list[int]] = {}

    def _ids(self, word: bytes) -> list[int]:
        ids = self.merged.get(word)
        if ids is None:
            ids = merge(word, self.ranks)
            if len(self.merged) >= self.remember:
                self.merged.clear()
            self.merged[word] = ids
        return ids

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        seen: dict[str, int] = {}
        codes: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.pattern.findall(text)
                counts[i] = len(words)
                codes += [seen.setdefault(word, len(seen)) for word in words]
        distinct = [word.encode("utf-8", "replace") for word in seen]
        numbers = look_up(self.fst, distinct)
        starts = self.fst["starts"]
        known = np.flatnonzero(numbers >= 0)
        lengths = np.zeros(len(distinct), np.int64)
        begins = np.zeros(len(distinct), np.int64)
        lengths[known] = starts[numbers[known] + 1] - starts[numbers[known]]
        begins[known] = starts[numbers[known]]
        extra: list[int] = []
        base = len(self.fst["ids"])
        for k in np.flatnonzero(numbers < 0):
            ids = self._ids(distinct[k])
            begins[k], lengths[k] = base + len(extra), len(ids)
            extra += ids
        table = np.concatenate([self.fst["ids"], np.array(extra, np.int32)])
        word = np.array(codes, np.int64)
        each = lengths[word]
        ends = np.cumsum(each)
        flat = np.repeat(begins[word] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])
        return table[flat], upto[bounds[1:]] - upto[bounds[:-1]]


def encode_corpus(
    df: DataFrame, key: str, text: str, *, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon: int = 50_000
) -> DataFrame:
    """``key, ids``: the token ids of each text, without special tokens.

    Null and empty texts have an empty list; white space is text. Strings that spell a special token are ordinary text.
    ``lexicon`` bounds the words compiled; results do not depend on it. Rows are not joined or gathered: repeated
    keys, very long texts and empty tables come out row by row. Other columns are dropped.
    """
    spark = df.sparkSession
    ranks = read_ranks(vocabulary)
    words = [word.encode() for word in frequent_words(df, text, lexicon)]
    place = publish(spark, compile_transducer(words, [merge(word, ranks) for word in words]))
    held = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the corpus
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = pa.schema([("_key", pa.from_numpy_dtype(np.int64)), ("ids", pa.list_(pa.int32()))])
    key_type = dict(df.select(F.col(key).alias("_key")).dtypes)["_key"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(open_transducer(place), held.value)
        for batch in batches:
            column, first, size = batch.column("_text"), 0, 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > SLICE:
                    part = batch.slice(first, i - first)
                    ids, counts = encoder.encode(part.column("_text").to_pylist())
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("_key"), lists], names=kind.names)
                    first, size = i, 0
                if i < batch.num_rows:
                    size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0

    out = rows.mapInArrow(encode, f"_key {key_type}, ids array<int>")
    return out.withColumnRenamed("_key", key)
