"""Aggregates of flat metadata, terms and clusters: distinct and value counts, completeness, heterogeneity, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.constants import COMPLETENESS
from lexistrata.engine import text_or_empty
from lexistrata.functions.text import SEPARATOR

TOP = 10
OBSERVED = 5


def _parts(df: DataFrame, column: str) -> DataFrame:
    split = df.select(F.explode(F.split(text_or_empty(df, column), r"\|")).alias("value"))
    return split.select(F.trim("value").alias("value")).where("value <> ''")


def distinct_filled(df: DataFrame, column: str) -> Column:
    """Aggregate: distinct values of a column that are not empty."""
    return F.count_distinct(F.nullif(text_or_empty(df, column), F.lit("")))


def distinct_parts(df: DataFrame, column: str) -> DataFrame:
    """One row ``n``: distinct parts of the cells of a column, between bars."""
    return _parts(df, column).agg(F.count_distinct("value").alias("n"))


def part_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n``: how often each part of the cells of a column occurs."""
    return _parts(df, column).groupBy("value").agg(F.count("*").alias("n"))


def top_parts(df: DataFrame, column: str, limit: int = TOP) -> DataFrame:
    """The most frequent parts, of equals the least."""
    return part_counts(df, column).orderBy(F.desc("n"), "value").limit(limit)


def heterogeneity(metadata: DataFrame, limit: int = 8) -> DataFrame:
    """``label, value, n``: the most frequent formats, media types and labels of distributions."""
    columns = {"Formats": "distribution_formats", "Media types": "distribution_media_types", "Distribution labels": "distribution_titles"}
    parts = [top_parts(metadata, column, limit).select(F.lit(label).alias("label"), "value", "n") for label, column in columns.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _filled(df: DataFrame, columns: list[str]) -> Column:
    """Whether any of the columns holds something other than blank or zero."""
    found = F.lit(False)
    for column in columns:
        if column in df.columns:
            text = F.trim(text_or_empty(df, column))
            found = found | ((text != "") & (text != "0"))
    return found


def completeness(metadata: DataFrame, order: str = "ord") -> DataFrame:
    """``field, count_present, total, percent_present, examples_missing`` of ten fields, in one pass over the table.

    Examples are the titles of the first three records without the field. An empty table has zeros.
    """
    checks = {field: _filled(metadata, columns) for field, columns in COMPLETENESS.items()}
    long = metadata.select(
        F.col(order).alias("_o"),
        text_or_empty(metadata, "title").alias("_t"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c.alias("ok")) for f, c in checks.items()))).alias("x"),
    ).select("_o", "_t", "x.field", "x.ok")
    counts = long.groupBy("field").agg(F.count_if("ok").alias("count_present"), F.count("*").alias("total"))
    rank = Window.partitionBy("field").orderBy("_o", "_t")
    missing = long.where("not ok").withColumn("_n", F.row_number().over(rank)).where("_n <= 3")
    titles = missing.groupBy("field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), SEPARATOR).alias("examples_missing")
    )
    fields = metadata.sparkSession.createDataFrame([(f, i) for i, f in enumerate(COMPLETENESS)], "field string, _i int")
    joined = fields.join(counts, "field", "left").join(titles, "field", "left").orderBy("_i")
    percent = F.coalesce(F.col("count_present") / F.col("total") * 100, F.lit(0.0))
    return joined.select(
        "field",
        F.coalesce("count_present", F.lit(0)).alias("count_present"),
        F.coalesce("total", F.lit(0)).alias("total"),
        percent.alias("percent_present"),
        F.coalesce("examples_missing", F.lit("")).alias("examples_missing"),
    )


def distribution_total(metadata: DataFrame, distributions: DataFrame | None) -> Column | int:
    """Rows of the distribution table if there are any, else the sum of the counts in the metadata."""
    if distributions is not None and not distributions.isEmpty():
        return distributions.count()
    column = next((c for c in ("distribution_count", "resources_count") if c in metadata.columns), None)
    if column is None:
        return 0
    return metadata.agg(F.sum(F.col(column).try_cast("long"))).first()[0] or 0


def top_duplicates(terms: DataFrame, limit: int = TOP) -> DataFrame:
    """``normalized_term, source_field, count``: the terms counted most."""
    summed = terms.groupBy("normalized_term", "source_field").agg(F.sum("count").alias("count"))
    return summed.orderBy(F.desc("count"), "normalized_term", "source_field").limit(limit)


def grouped_clusters(clusters: DataFrame) -> DataFrame:
    """``cluster_id, canonical_term, observed_term, count, cluster_reason``: one row a cluster.

    Of its rows, by count and observed term, the first five observed terms are joined.
    """
    keys = ["cluster_id", "canonical_term"]
    rank = Window.partitionBy(*keys).orderBy(F.desc("count"), "observed_term", "normalized_term")
    kept = clusters.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= OBSERVED)
    listed = F.array_sort(F.collect_list(F.struct("_n", "observed_term")))
    observed = kept.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["observed_term"]), SEPARATOR).alias("observed_term"))
    sums = clusters.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.array_join(F.array_sort(F.collect_set("cluster_reason")), SEPARATOR).alias("cluster_reason")
    )
    return observed.join(sums, keys).select(*keys, "observed_term", "count", "cluster_reason")


def top_clusters(clusters: DataFrame, limit: int = TOP) -> DataFrame:
    """The clusters counted most whose observed terms are several."""
    several = grouped_clusters(clusters).where(F.col("observed_term").contains("|"))
    return several.orderBy(F.desc("count"), "cluster_id").limit(limit)


def cluster_examples(clusters: DataFrame, minimum: int = 5) -> DataFrame:
    """The top clusters of several terms, or of all where those are fewer than ``minimum``."""
    top = top_clusters(clusters)
    if top.count() < minimum:
        top = grouped_clusters(clusters).orderBy(F.desc("count"), "cluster_id").limit(minimum)
    return top.limit(max(minimum, 5))
