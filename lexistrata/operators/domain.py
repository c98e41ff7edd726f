"""Summary of the terms and clusters about sensors and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.constants import EXCLUDED_TERMS, SENSOR_PATTERNS
from lexistrata.functions.text import SEPARATOR, filter_form, is_sensor_term, literals

DOMAIN = "sensor_telemetry"


def check_domain(domain: str) -> None:
    """Only one domain has a summary."""
    if domain != DOMAIN:
        raise ValueError(f"Only domain='{DOMAIN}' is currently supported")


def pattern_counts(terms: DataFrame) -> DataFrame:
    """``label, n``: sums of counts of terms that have one of a label's words in them; a missing or zero count is one."""
    value = filter_form(F.col("normalized_term"))
    weight = F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count")) if "count" in terms.columns else F.lit(1)
    hits = [
        F.struct(F.lit(label).alias("label"), F.exists(literals(words), lambda w: value.contains(w)).alias("hit"))
        for label, words in SENSOR_PATTERNS.items()
    ]
    long = terms.select(weight.alias("w"), F.explode(F.array(*hits)).alias("x"))
    return long.groupBy("x.label").agg(F.coalesce(F.sum(F.when(F.col("x.hit"), F.col("w"))), F.lit(0)).alias("n"))


def noisy_terms(terms: DataFrame) -> DataFrame:
    """``term``: excluded terms that occur."""
    return terms.select(filter_form(F.col("normalized_term")).alias("term")).where(F.col("term").isin(EXCLUDED_TERMS)).distinct()


def domain_clusters(clusters: DataFrame, limit: int = 20) -> DataFrame:
    """``cluster_id, canonical_term, observed_terms, count``: the domain's clusters counted most, with eight spellings."""
    kept = clusters.where(is_sensor_term(F.col("normalized_term")))
    observed = F.array_join(F.slice(F.array_sort(F.collect_set("observed_term")), 1, 8), SEPARATOR)
    grouped = kept.groupBy("cluster_id", "canonical_term").agg(observed.alias("observed_terms"), F.sum("count").alias("count"))
    return grouped.orderBy(F.desc("count"), "cluster_id").limit(limit)
