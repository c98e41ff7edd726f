"""Clusters of terms: edges by synonym, token sets, n-gram cosine or vectors, components, canonical terms, metrics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.constants import CLUSTER_COLUMNS, SYNONYMS
from lexistrata.engine import checkpoint, stored, text_or_empty
from lexistrata.functions.similarity import token_set_ratio
from lexistrata.functions.text import SEPARATOR, block_keys, is_excluded, is_sensor_term
from lexistrata.operators.blocking import all_pairs, block_pairs, candidate_pairs, comparison_blocks, keyed_terms
from lexistrata.operators.components import connected_components

MOST_TFIDF_TERMS = 50_000
MOST_CLUSTER_TERMS = 500
#: Decimals that scores are rounded to before they meet a threshold.
DIGITS = 9


def filter_terms(terms: DataFrame, *, min_count: int = 2, domain: str = "") -> DataFrame:
    """Rows of at least ``min_count``, without excluded terms; of the domain ``sensor_telemetry`` only its terms.

    The count is that of the row, not of the normalized term. Any other domain filters nothing.
    """
    kept = terms.where(F.col("count") >= min_count) if "count" in terms.columns else terms
    kept = kept.where(~is_excluded(F.col("normalized_term")))
    return kept.where(is_sensor_term(F.col("normalized_term"))) if domain == "sensor_telemetry" else kept


def synonym_edges(terms: DataFrame, reason: str) -> DataFrame:
    """Edges of score 1 between a term and its synonym where both occur."""
    pairs = terms.sparkSession.createDataFrame(
        sorted((min(p), max(p)) for p in SYNONYMS.items() if p[0] != p[1]), "l string, r string"
    )
    known = F.broadcast(pairs)  # as many as the fixed dictionary has
    return (
        known.join(terms.select(F.col("term").alias("l")), "l", "left_semi")
        .join(terms.select(F.col("term").alias("r")), "r", "left_semi")
        .select("l", "r", F.lit(1.0).alias("score"), F.lit(reason).alias("reason"))
    )


def token_set_edges(terms: DataFrame, threshold: float, reason: str, *, exact: bool = False) -> DataFrame:
    """Edges between terms whose words are alike as sets."""
    scored = candidate_pairs(terms, exact=exact).withColumn("score", token_set_ratio("l", "r"))
    return scored.where(F.round("score", DIGITS) >= threshold).select("l", "r", "score", F.lit(reason).alias("reason"))


def char_grams(word: str) -> list[str]:
    """Runs of 3 to 5 characters of a word with a space on either side; shorter words give themselves once."""
    padded = f" {word} "
    return [padded[at : at + n] for n in range(3, max(3, min(5, len(padded))) + 1) for at in range(len(padded) - n + 1)]


def _cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``l, r, score`` of pairs that follow all terms of their block, blocks one after another.

    Of a block only its number of terms and that of each run of characters are held.
    """
    grams = lru_cache(maxsize=100_000)(char_grams)
    block, n, held = None, 0, Counter()

    @lru_cache(maxsize=2_000)
    def weights(term: str) -> tuple[dict[str, float], float]:
        counted = Counter(chain.from_iterable(grams(w) for w in term.split(" ") if w))
        weighed = {g: tf * (math.log((1 + n) / (1 + held[g])) + 1) for g, tf in counted.items()}
        return weighed, math.sqrt(sum(w * w for w in weighed.values()))

    for batch in batches:
        found = []
        for at, l, r in zip(batch["block"], batch["l"], batch["r"], strict=True):
            if at != block:
                block, n = at, 0
                held.clear()
                weights.cache_clear()
            if r is None:
                n += 1
                held.update(set(chain.from_iterable(grams(w) for w in l.split(" ") if w)))
                continue
            (a, norm_a), (b, norm_b) = weights(l), weights(r)
            found.append((l, r, sum(a[g] * b[g] for g in a.keys() & b.keys()) / (norm_a * norm_b)))
        yield pd.DataFrame(found, columns=["l", "r", "score"])


def tfidf_scores(blocks: DataFrame, pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """``l, r, score``: the best cosine of two terms over the blocks they share, if at least ``least``, weights being fitted in each block.

    ``pairs`` has ``block, l, r``. The terms of a block and then its pairs pass through one task, which holds only counts.
    """
    pairs = checkpoint(pairs)
    asked = pairs.select("block").distinct()
    live = blocks.join(asked, "block", "left_semi").select("block", F.col("term").alias("l"), F.lit(None).cast("string").alias("r"))
    rows = live.unionByName(pairs.select("block", "l", "r")).repartition("block").sortWithinPartitions("block", F.col("r").isNotNull(), "l")
    scored = rows.mapInPandas(_cosines, "l string, r string, score double").where(F.round("score", DIGITS) >= least)
    return scored.groupBy("l", "r").agg(F.max("score").alias("score"))


def tfidf_edges(terms: DataFrame, threshold: float, reason: str, *, exact: bool = False) -> DataFrame:
    """Edges between terms whose character runs are alike."""
    if exact:
        blocks = keyed_terms(terms).select(F.col("key").alias("block"), "term")
        shared = all_pairs(terms).withColumn("block", F.explode(F.array_intersect(block_keys(F.col("l")), block_keys(F.col("r")))))
        pairs = shared.select("block", "l", "r")
    else:
        blocks = checkpoint(comparison_blocks(terms))
        pairs = block_pairs(blocks)
    scored = tfidf_scores(blocks, pairs, threshold)
    return scored.where(F.round("score", DIGITS) >= threshold).select("l", "r", "score", F.lit(reason).alias("reason"))


def vector_edges(vectors: DataFrame, threshold: float, *, key: str = "term", vector: str = "vector") -> DataFrame:
    """Edges between rows whose vectors have a cosine of at least ``threshold``.

    Exact: rows are dealt to blocks and every pair of blocks is compared once, so that no task sees more than two blocks.
    Null and zero vectors pair with nothing.
    """
    size = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.select(F.col(key).alias("term"), F.col(vector).alias("_v"), size.alias("_n")).where("_n > 0")
    unit = rows.select("term", F.transform("_v", lambda x: x.cast("double") / F.col("_n")).alias("_v"))
    count = max(1, -(-unit.count() // 2000))
    placed = unit.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(count)).cast("int"))
    left = placed.select(F.col("term").alias("l"), F.col("_v").alias("_x"), F.col("_b").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_j"))
    right = placed.select(F.col("term").alias("r"), F.col("_v").alias("_y"), F.col("_b").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_i"))
    dot = F.aggregate(F.zip_with("_x", "_y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = left.join(right, ["_i", "_j"]).where(F.col("l") < F.col("r")).withColumn("score", dot)
    return pairs.where(F.round("score", DIGITS) >= threshold).select("l", "r", "score", F.lit("embedding").alias("reason"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair: the highest score, of equal scores any reason before ``exact``."""
    return (
        edges.where("l <> r")
        .select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "score", "reason")
        .groupBy("l", "r")
        .agg(F.max(F.struct("score", (F.col("reason") == "exact").alias("e"), "reason")).alias("b"))
        .select("l", "r", "b.score", "b.reason")
    )


def build_edges(
    terms: DataFrame, *, method: str = "hybrid", threshold: float = 0.82, vectors: DataFrame | None = None, exact: bool = False, most: int = MOST_TFIDF_TERMS
) -> DataFrame:
    """Edges of one method, ``fuzzy``, ``tfidf``, ``hybrid`` or ``embedding``; synonyms always count.

    Above ``most`` terms the n-gram part is left out, and so are blocks that stay too large; ``exact`` leaves out neither.
    ``embedding`` needs a table of vectors by term.
    """
    reason = "hybrid" if method == "hybrid" else None
    edges = synonym_edges(terms, reason or "exact")
    if method in ("fuzzy", "hybrid"):
        edges = edges.unionByName(token_set_edges(terms, threshold, reason or "fuzzy", exact=exact))
    if method in ("tfidf", "hybrid") and (exact or terms.count() <= most):
        edges = edges.unionByName(tfidf_edges(terms, threshold, reason or "tfidf", exact=exact))
    if method == "embedding":
        if vectors is None:
            raise RuntimeError("method embedding needs a table of vectors by term")
        edges = edges.unionByName(vector_edges(vectors.join(terms, "term", "left_semi"), threshold))
    return dedupe_edges(edges)


def assign_clusters(terms: DataFrame, edges: DataFrame, most: int | None = MOST_CLUSTER_TERMS) -> DataFrame:
    """``term, root, cluster_id``: components numbered by their least term.

    Those of more than ``most`` terms fall apart, numbered after all others; with none, every component stays whole.
    """
    roots = connected_components(terms, edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    split = roots.join(sizes, "root").withColumn("_apart", F.col("n") > most if most is not None else F.lit(False))
    head = split.withColumn("_head", F.when(F.col("_apart"), F.struct("root", "term")).otherwise(F.struct("root", F.col("root").alias("term"))))
    heads = head.select("_apart", "_head").distinct()
    return head.join(_numbered(heads), ["_apart", "_head"]).select("term", "root", "cluster_id")


def _numbered(heads: DataFrame) -> DataFrame:
    """Consecutive numbers in order, without one task for all rows: places in sorted partitions, then their offsets."""
    placed = checkpoint(
        heads.repartitionByRange("_apart", "_head").sortWithinPartitions("_apart", "_head").withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", 33)
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, at = {}, 0
    for p in sorted(counts):
        offset[p] = at
        at += counts[p]
    before = F.element_at(F.create_map(*(F.lit(x) for pair in offset.items() for x in pair)), part) if offset else F.lit(0)
    return placed.select("_apart", "_head", (before + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("cluster_id"))


def elect_canonical(members: DataFrame) -> DataFrame:
    """``cluster_id, canonical_term``: the least preferred term of a cluster, else its most counted one, least of equals.

    ``members`` has ``cluster_id, term, count``.
    """
    preferred = F.min(F.when(F.col("term").isin(sorted(set(SYNONYMS.values()))), F.col("term")))
    counted = F.min_by("term", F.struct((-F.col("count")).alias("c"), "term"))
    return members.groupBy("cluster_id").agg(F.coalesce(preferred, counted).alias("canonical_term"))


def _first_values(rows: DataFrame, value: str, limit: int, name: str) -> DataFrame:
    """The first distinct values of a column for each normalized term, by ``ord``, in one cell."""
    parts = rows.select("normalized_term", F.trim(F.col(value)).alias("v"), "ord").where("v <> ''")
    first = parts.groupBy("normalized_term", "v").agg(F.min("ord").alias("ord"))
    rank = Window.partitionBy("normalized_term").orderBy("ord", "v")
    kept = first.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("n", "v")))
    return kept.groupBy("normalized_term").agg(F.array_join(F.transform(listed, lambda x: x["v"]), SEPARATOR).alias(name))


def cluster_rows(terms: DataFrame, assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """The cluster table of nine columns, one row a normalized term, ordered by cluster, count and observed term."""
    filled = terms.withColumn("examples", text_or_empty(terms, "example_titles"))
    if "ord" not in terms.columns:
        filled = filled.withColumn("ord", F.struct(F.lit(0).alias("o"), F.col("term")))
    base = filled.groupBy("normalized_term").agg(F.sum("count").alias("count"))
    for value, limit, name in (("source_field", 10, "source_fields"), ("term", 10, "observed_term"), ("examples", 5, "examples")):
        base = base.join(_first_values(filled, value, limit, name), "normalized_term", "left")
    base = base.join(assignments.select(F.col("term").alias("normalized_term"), "cluster_id"), "normalized_term")
    canonical = elect_canonical(base.select("cluster_id", F.col("normalized_term").alias("term"), "count"))
    named = base.join(canonical, "cluster_id").withColumn("l", F.least("canonical_term", "normalized_term")).withColumn(
        "r", F.greatest("canonical_term", "normalized_term")
    )
    scored = named.join(edges, ["l", "r"], "left")
    reason = F.when(F.col("canonical_term") == F.col("normalized_term"), "exact").otherwise(F.coalesce("reason", F.lit("exact")))
    rows = scored.select(
        "cluster_id",
        "canonical_term",
        F.coalesce(F.nullif("observed_term", F.lit("")), "normalized_term").alias("observed_term"),
        "normalized_term",
        F.coalesce("source_fields", F.lit("")).alias("source_fields"),
        "count",
        F.bround(F.coalesce("score", F.lit(1.0)), 3).alias("similarity_score"),
        reason.alias("cluster_reason"),
        F.coalesce("examples", F.lit("")).alias("examples"),
    )
    return rows.orderBy("cluster_id", F.desc("count"), "observed_term").select(*CLUSTER_COLUMNS)


def drop_singletons(rows: DataFrame) -> DataFrame:
    """Rows of clusters with more than one normalized term."""
    many = rows.groupBy("cluster_id").agg(F.count_distinct("normalized_term").alias("n")).where("n > 1")
    return rows.join(many, "cluster_id", "left_semi")


def cluster_metrics(rows: DataFrame) -> DataFrame:
    """One row: terms, clusters, the largest, those of one and of more terms, and a warning above a twentieth of all rows."""
    sizes = rows.groupBy("cluster_id").agg(F.count_distinct("normalized_term").alias("n"), F.count("*").alias("m"))
    by_cluster = sizes.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("_rows"),
        F.count("*").alias("total_clusters"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster_size"),
        F.count_if(F.col("n") == 1).alias("singleton_clusters"),
        F.count_if(F.col("n") > 1).alias("multi_term_clusters"),
        # A normalized term is in one cluster, so that the sizes add up to the distinct terms.
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_terms"),
    )
    size = F.col("largest_cluster_size")
    warning = F.when(
        size > F.col("_rows") * 0.05, F.concat(F.lit("largest cluster has "), size, F.lit(" rows (>5% of clustered rows)"))
    ).otherwise("")
    return by_cluster.select(
        "total_terms", "total_clusters", "largest_cluster_size", "singleton_clusters", "multi_term_clusters", warning.alias("warning")
    )


def cluster_terms(
    terms: DataFrame,
    *,
    method: str = "hybrid",
    min_count: int = 2,
    threshold: float = 0.82,
    domain: str = "",
    include_singletons: bool = True,
    vectors: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """The cluster table of a term table. An empty term table gives an empty table of the same columns.

    ``exact`` drops the feature's limits: no block, no n-gram edge and no large component is left out.
    """
    kept = stored(filter_terms(terms, min_count=min_count, domain=domain))
    distinct = checkpoint(kept.select(F.col("normalized_term").alias("term")).where(F.trim("term") != "").distinct())
    edges = checkpoint(build_edges(distinct, method=method, threshold=threshold, vectors=vectors, exact=exact))
    rows = cluster_rows(kept, assign_clusters(distinct, edges, None if exact else MOST_CLUSTER_TERMS), edges)
    return rows if include_singletons else drop_singletons(rows)


def format_metrics(row) -> list[str]:  # noqa: ANN001
    """Lines that tell a metrics row."""
    labels = {
        "total_terms": "total terms",
        "total_clusters": "total clusters",
        "largest_cluster_size": "largest cluster size",
        "singleton_clusters": "singleton clusters",
        "multi_term_clusters": "multi-term clusters",
    }
    lines = [f"{label}: {row[name]}" for name, label in labels.items()]
    return [*lines, f"WARNING: {row['warning']}"] if row["warning"] else lines
