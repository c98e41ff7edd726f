"""All pairs of set-valued records whose overlap reaches a Jaccard threshold, exactly.

Pigeonhole partitioning. Sets are grouped in length bands. In the scheme of the larger set's band the token universe is
cut into m = H + 1 segments, H being the largest symmetric difference that similar sets of that band can have. The
smaller set emits every segment and everything one deletion away from it; the larger set gives each segment a budget u
(0: unused, 1: equal segments, 2: one token apart) such that the budgets sum to H + 1. Were every segment of a pair apart
by more than its budget allows, the sets would differ in more than H tokens; so a similar pair always meets. Budgets go
to the segments that the counted frequencies of their tokens promise to be rare, so that no hot token or empty segment
is joined on unless a set has nothing else. Candidates are verified exactly.

Copies are one class each; the join runs between classes. Expanding a class to its rows is split in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint
from lexistrata.llm.bits import key_filter, may_hold

#: Tokens in more than one of so many sets are hot. Their number is at most this times the mean set size.
HOT_SHARE = 500
#: Rows of one class that one task expands against as many others.
BLOCK = 2_000


def bands(over: int, of: int, smallest: int, largest: int) -> list[tuple[int, int, int]]:
    """Length bands (first, last, H) that cover ``smallest`` to ``largest``.

    H is the largest symmetric difference of two sets with Jaccard of at least over/of, the larger one in the band.
    """
    out = []
    first = smallest
    while first <= largest:
        last = max(first, first * 5 // 4)
        # |A xor B| <= (|A| + |B|) (1 - t) / (1 + t), most with both sets as large as the band allows.
        out.append((first, last, 2 * last * (of - over) // (of + over)))
        first = last + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segments:
    """The token sets of a batch cut into the segments of one scheme.

    A segment's hash is that of the sum of its tokens' hashes, so that leaving a token out is a subtraction. Equal segments
    have equal hashes; unlike ones that happen to have equal hashes are told apart when candidates are verified.
    """

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, sets: int, scheme: int, m: int) -> None:
        self.sets, self.m, self.owner = sets, m, owner
        unsigned = tokens.view(np.uint64)
        self.cell = owner * m + ((unsigned ^ (unsigned >> np.uint64(17))) % np.uint64(m)).astype(np.int64)
        self.hashes = _mixed(unsigned)
        self.sums = np.zeros(sets * m, np.uint64)
        np.add.at(self.sums, self.cell, self.hashes)
        salt = np.uint64(scheme + 1) * np.uint64(0x9E3779B97F4A7C15)
        self.salts = _mixed(np.arange(m, dtype=np.uint64) + salt)

    def whole(self, cells: np.ndarray) -> np.ndarray:
        """The signatures of some segments."""
        return _mixed(self.sums[cells] + self.salts[cells % self.m]).view(np.int64)

    def without(self, places: np.ndarray) -> np.ndarray:
        """The signatures of some tokens' segments without that token."""
        cells = self.cell[places]
        return _mixed(self.sums[cells] - self.hashes[places] + self.salts[cells % self.m]).view(np.int64)

    def budgets(self, rarity: np.ndarray, h: int) -> np.ndarray:
        """The budget of every segment: least expected partners for a total of ``h`` + 1, by an exact knapsack of all sets.

        ``rarity`` is the logarithm of each token's share of the sets.
        """
        cells = self.sets * self.m
        summed = np.bincount(self.cell, rarity, cells)
        size = np.bincount(self.cell, minlength=cells)
        equal = np.exp(summed) * (1 + size)
        fewer = np.bincount(self.cell, np.exp(summed[self.cell] - rarity), cells)
        apart = equal + fewer + (size == 0)
        equal, apart = equal.reshape(self.sets, self.m), apart.reshape(self.sets, self.m)
        units = np.zeros((self.sets, self.m), np.int8)
        chunk = max(1, 20_000_000 // (self.m * (h + 2)))
        for first in range(0, self.sets, chunk):
            part = slice(first, first + chunk)
            n = len(equal[part])
            best = np.full((n, h + 2), np.inf)
            best[:, 0] = 0
            taken = np.zeros((self.m, n, h + 2), np.int8)
            one, two = np.maximum(np.arange(h + 2) - 1, 0), np.maximum(np.arange(h + 2) - 2, 0)
            for i in range(self.m):
                choices = np.stack([best, best[:, one] + equal[part, i, None], best[:, two] + apart[part, i, None]])
                taken[i] = choices.argmin(axis=0)
                best = choices.min(axis=0)
            left = np.full(n, h + 1)
            for i in reversed(range(self.m)):
                units[part, i] = taken[i, np.arange(n), left]
                left = np.maximum(left - units[part, i], 0)
        return units.ravel()


def signatures(batch: Segments, rarity: np.ndarray | None, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, kind, set) of all sets of a batch in one scheme.

    As the smaller sets (no ``rarity``) every segment has kind 0 and every segment without one token kind 1. As the larger
    ones they emit what their budgets call for: kind 2 meets equal segments only, 0 and 1 meet as above.
    """
    if rarity is None:
        cells, places = np.arange(batch.sets * batch.m), np.arange(len(batch.owner))
        kinds = np.zeros(len(cells), np.int8)
    else:
        units = batch.budgets(rarity, h)
        cells = np.flatnonzero(units)
        places = np.flatnonzero(units[batch.cell] == 2)
        kinds = np.where(units[cells] == 1, 2, 0).astype(np.int8)
    found = np.concatenate([batch.whole(cells), batch.without(places)])
    return found, np.concatenate([kinds, np.ones(len(places), np.int8)]), np.concatenate([cells // batch.m, batch.owner[places]])


def classes(df: DataFrame, key: str, values: str, smallest: int) -> tuple[DataFrame, DataFrame]:
    """``(members, sets)``: rows with the class of their set, and one row a class with its distinct sorted values.

    The class is a 128-bit hash of the values, kept as a string. Null values are left out, repeated ones count once.
    """
    distinct = F.array_sort(F.array_distinct(F.filter(F.col(values), lambda v: v.isNotNull() & (F.length(v) > 0))))
    named = F.md5(F.to_json(F.col("_set")).cast("binary"))
    rows = (
        df.select(F.col(key).alias("_key"), distinct.alias("_set"), *(["_group"] if "_group" in df.columns else []))
        .where(F.size("_set") >= smallest)
        .withColumn("_class", named)
    )
    sets = rows.groupBy("_class").agg(F.first("_set").alias("_set"))
    return rows.drop("_set"), sets


def _hot_tokens(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in more than one of ``HOT_SHARE`` sets, a bounded number, in order, with the share that holds them."""
    counted = (
        sets.select(F.explode("_tokens").alias("t")).groupBy("t").count().where(F.col("count") * HOT_SHARE > n)
    )
    rows = sorted((row.t, row["count"] / n) for row in counted.collect())
    return np.array([t for t, _ in rows], np.int64), np.array([share for _, share in rows])


def _emit(sized: DataFrame, schemes: list[tuple[int, int, int]], over: int, of: int, hot: Broadcast, asked: Broadcast | None) -> DataFrame:
    """``_sig, _kind, _id, _n, _u, _v`` of all sets: as the larger ones of a pair, or the smaller ones where a filter is given.

    ``_u`` and ``_v`` are 128 bits, one for each token of the set: sets that differ in a bit differ in a token.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, share = hot.value
        for batch in batches:
            column = batch.column("_tokens")
            ids, sizes = batch.column("_id").to_numpy(), np.diff(column.offsets.to_numpy())
            tokens = column.flatten().to_numpy()
            begins = np.cumsum(sizes) - sizes
            masks, place = np.zeros((2, len(sizes)), np.int64), _mixed(tokens.view(np.uint64) + np.uint64(1)) & np.uint64(127)
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            np.bitwise_or.at(masks, ((place >> np.uint64(6)).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)), bit)
            for scheme, (first, last, h) in enumerate(schemes):
                # Smaller partners of a set in this band have at least over/of of its size.
                fits = (sizes >= first) & (sizes <= last) if asked is None else (sizes <= last) & (sizes * of >= first * over)
                chosen = np.flatnonzero(fits)
                if not len(chosen):
                    continue
                owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
                local = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen])
                some = tokens[np.repeat(begins[chosen], sizes[chosen]) + local]
                rarity = None
                if asked is None:
                    rarity = np.full(len(some), -math.log(HOT_SHARE))
                    if len(known):
                        at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                        rarity = np.where(known[at] == some, np.log(share[at]), rarity)
                sig, kind, which = signatures(Segments(some, owner, len(chosen), scheme, h + 1), rarity, h)
                if asked is not None:
                    kept = may_hold(asked.value, sig)
                    sig, kind, which = sig[kept], kind[kept], which[kept]
                frame = pd.DataFrame({"_sig": sig, "_kind": kind, "_id": ids[chosen[which]], "_n": sizes[chosen[which]].astype(np.int32)})
                frame["_u"], frame["_v"] = masks[0][chosen[which]], masks[1][chosen[which]]
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return sized.select("_id", "_tokens").mapInArrow(emit, "_sig long, _kind tinyint, _id long, _n int, _u long, _v long")


def similar_classes(sets: DataFrame, over: int, of: int, smallest: int) -> DataFrame:
    """``_a, _b``: the pairs of different classes (``_a < _b``) that share at least over/of of their union.

    Only signatures, numbers and a few bits of sets are joined; token lists are fetched for candidates. What the smaller sets emit is
    first held against a filter of the signatures that larger sets ask for, so that empty and other common segments that
    nobody asks for never leave their task.
    """
    hashed = F.array_sort(F.transform("_set", lambda v: F.xxhash64(v)))
    sized = checkpoint(sets.withColumn("_tokens", hashed).withColumn("_id", F.monotonically_increasing_id()))
    stats = sized.agg(F.count("*").alias("n"), F.max(F.size("_tokens")).alias("largest")).first()
    n, largest = stats.n, stats.largest or 0
    schemes = bands(over, of, smallest, largest)
    none = np.empty(0, np.int64), np.empty(0)
    hot = sized.sparkSession.sparkContext.broadcast(_hot_tokens(sized, n) if n else none)
    big = checkpoint(_emit(sized, schemes, over, of, hot, None))
    small = _emit(sized, schemes, over, of, hot, key_filter(big, "_sig"))
    left = big.select("_sig", F.col("_kind").alias("_k1"), F.col("_id").alias("_x"), F.col("_n").alias("_n1"), F.col("_u").alias("_u1"), F.col("_v").alias("_v1"))
    right = small.select("_sig", F.col("_kind").alias("_k2"), F.col("_id").alias("_y"), F.col("_n").alias("_n2"), F.col("_u").alias("_u2"), F.col("_v").alias("_v2"))
    meets = (F.col("_k2") == 0) | (F.col("_k1") == 0)
    ordered = (F.col("_n1") > F.col("_n2")) | ((F.col("_n1") == F.col("_n2")) & (F.col("_x") != F.col("_y")))
    # Similar sets differ in at most this share of their sizes' sum; bits that differ are tokens that do.
    apart = F.bit_count(F.col("_u1").bitwiseXOR(F.col("_u2"))) + F.bit_count(F.col("_v1").bitwiseXOR(F.col("_v2")))
    near = apart * (of + over) <= (F.col("_n1") + F.col("_n2")) * (of - over)
    candidates = (
        left.join(right, "_sig")
        .where(meets & ordered & (F.col("_n2") * of >= F.col("_n1") * over) & near)
        .select(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
        .distinct()
    )
    # Token hashes thin the candidates out; the values themselves decide.
    shared = F.size(F.array_intersect("_t1", "_t2"))
    alike = (
        candidates.join(sized.select(F.col("_id").alias("_x"), F.col("_tokens").alias("_t1")), "_x")
        .join(sized.select(F.col("_id").alias("_y"), F.col("_tokens").alias("_t2")), "_y")
        .where(shared * of >= (F.size("_t1") + F.size("_t2") - shared) * over)
        .select("_x", "_y")
    )
    both = F.size(F.array_intersect("_s1", "_s2"))
    return (
        alike.join(sized.select(F.col("_id").alias("_x"), F.col("_set").alias("_s1"), F.col("_class").alias("_c1")), "_x")
        .join(sized.select(F.col("_id").alias("_y"), F.col("_set").alias("_s2"), F.col("_class").alias("_c2")), "_y")
        .where(both * of >= (F.size("_s1") + F.size("_s2") - both) * over)
        .select(F.least("_c1", "_c2").alias("_a"), F.greatest("_c1", "_c2").alias("_b"))
    )


def similar_sets(
    df: DataFrame, key: str, values: str, *, group: str | None = None, over: int = 3, of: int = 5, smallest: int = 3
) -> DataFrame:
    """``row_a, row_b``: all pairs of rows (smaller ``key`` first) whose value sets share over/of of their union.

    Sets are the distinct non-null, non-empty strings of the array ``values``; those below ``smallest`` values pair with
    nothing. Rows of one ``group`` are not paired (null groups never count as one). Keys are taken as unique: rows that
    repeat a key pair once. An empty table gives no rows; other columns and their names do not matter.
    """
    rows = df.select(
        F.col(key).alias("_k"), F.col(values).alias("_v"), (F.col(group) if group else F.lit(None)).cast("string").alias("_group")
    )
    members, sets = classes(rows, "_k", "_v", smallest)
    members = checkpoint(members)
    pairs = checkpoint(similar_classes(sets, over, of, smallest))
    sizes = members.groupBy("_class").agg(F.count("*").alias("_n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)).cast("int")
    placed = members.join(sizes, "_class").withColumn("_blocks", blocks).withColumn(
        "_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")
    )
    related = pairs.unionByName(sets.select(F.col("_class").alias("_a"), F.col("_class").alias("_b")))
    counted = sizes.select("_class", blocks.alias("_blocks"))
    # Every pair of blocks is a key of its own, so that a hot class is spread over many tasks.
    tasks = (
        related.join(counted.select(F.col("_class").alias("_a"), F.col("_blocks").alias("_m")), "_a")
        .join(counted.select(F.col("_class").alias("_b"), F.col("_blocks").alias("_w")), "_b")
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
        .where((F.col("_a") != F.col("_b")) | (F.col("_i") <= F.col("_j")))
    )
    left = placed.select(F.col("_class").alias("_a"), F.col("_block").alias("_i"), F.col("_key").alias("_p"), F.col("_group").alias("_g"))
    right = placed.select(F.col("_class").alias("_b"), F.col("_block").alias("_j"), F.col("_key").alias("_q"), F.col("_group").alias("_h"))
    inner = (F.col("_a") != F.col("_b")) | (F.col("_i") != F.col("_j")) | (F.col("_p") < F.col("_q"))
    different = F.col("_g").isNull() | F.col("_h").isNull() | (F.col("_g") != F.col("_h"))
    return (
        tasks.select("_a", "_b", "_i", "_j")
        .join(left, ["_a", "_i"])
        .join(right, ["_b", "_j"])
        .where(inner & different & (F.col("_p") != F.col("_q")))
        .select(F.least("_p", "_q").alias("row_a"), F.greatest("_p", "_q").alias("row_b"))
        .distinct()
    )
