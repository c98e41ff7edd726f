"""Samples of clusters for human review, and scores of the labels they come back with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.constants import VALID_LABELS
from lexistrata.functions.text import SEPARATOR


def validation_sample(clusters: DataFrame, sample_size: int = 100) -> DataFrame:
    """The first clusters with their spellings, examples cut at 500 characters, and columns to fill in."""
    keys = ["cluster_id", "canonical_term"]
    examples = F.array_sort(F.collect_list(F.when(F.col("examples") != "", F.struct((-F.col("count")).alias("c"), "observed_term", "examples"))))
    grouped = clusters.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("observed_term")), SEPARATOR).alias("observed_terms"),
        F.substring(F.array_join(F.transform(examples, lambda x: x["examples"]), SEPARATOR), 1, 500).alias("example_records"),
    )
    first = grouped.orderBy(*keys).limit(sample_size)
    return first.select("*", F.lit(True).alias("predicted_equivalent"), F.lit("").alias("human_label"), F.lit("").alias("human_notes"))


def validation_scores(labelled: DataFrame) -> DataFrame:
    """One row: ``reviewed``, a count a label, ``precision``: the share of equivalent and related ones, 0 without any.

    Labels are trimmed and lower-cased; others, null and a missing column count as not reviewed.
    """
    label = F.lower(F.trim(F.col("human_label"))) if "human_label" in labelled.columns else F.lit(None).cast("string")
    counts = [F.count_if(label == name).alias(name) for name in VALID_LABELS]
    summed = labelled.agg(F.count_if(label.isin(VALID_LABELS)).alias("reviewed"), *counts)
    good = F.col("equivalent") + F.col("related")
    return summed.withColumn("precision", F.when(F.col("reviewed") > 0, good / F.col("reviewed")).otherwise(0.0))
