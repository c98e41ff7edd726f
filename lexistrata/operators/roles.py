"""Roles of columns from their names and a sample of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.constants import ROLE_PATTERNS
from lexistrata.functions.text import SEPARATOR, field_form

SAMPLE_ROWS = 50
TESTED_VALUES = 20
_EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
_URL = r"https?://|www\."
_DATE = r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
_NUMBER = r"^-?\d+(\.\d+)?%?$"
_NUMERIC_NAME = {"metric_field": 0.72, "count_field": 0.72}


def column_samples(df: DataFrame, order: str | None = None) -> DataFrame:
    """``field_name, values``: the non-blank values, as text, of each column's first rows: the feature's sample of 50."""
    columns = [c for c in df.columns if c != order]
    head = (df.orderBy(order) if order else df).limit(SAMPLE_ROWS).select(
        *(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns))
    )
    head = head.withColumn("_n", F.monotonically_increasing_id())
    cells = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(f"c{i}").alias("v")) for i, c in enumerate(columns)))
    long = head.select("_n", F.explode(cells).alias("x")).select("_n", "x.field_name", "x.v")
    kept = F.array_sort(F.collect_list(F.when(F.trim(F.coalesce("v", F.lit(""))) != "", F.struct("_n", "v"))))
    return long.groupBy("field_name").agg(F.transform(kept, lambda x: x["v"]).alias("values"))


def _value_score(role: str, values: Column) -> tuple[Column, Column]:
    first = F.slice(values, 1, TESTED_VALUES)
    if role == "contact_email_field":
        hit = F.exists(first, lambda v: v.rlike(_EMAIL))
        return F.when(hit, 0.9).otherwise(0.0), F.when(hit, "email-like sample values")
    if role == "url_field":
        hit = F.exists(first, lambda v: v.rlike(_URL))
        return F.when(hit, 0.9).otherwise(0.0), F.when(hit, "URL-like sample values")
    if role in ("date_field", "time_field"):
        hit = F.exists(first, lambda v: v.rlike(_DATE))
        return F.when(hit, 0.8).otherwise(0.0), F.when(hit, "date-like sample values")
    numeric = F.size(F.filter(values, lambda v: F.trim(v).rlike(_NUMBER))) / F.greatest(F.size(values), F.lit(1)) >= 0.7
    if role in _NUMERIC_NAME:
        return F.when(numeric, _NUMERIC_NAME[role]).otherwise(0.0), F.when(numeric, "mostly numeric sample values")
    if role == "percentage_field":
        hit = numeric & F.exists(values, lambda v: v.contains("%"))
        return F.when(hit, 0.86).otherwise(0.0), F.when(hit, "percentage-like sample values")
    return F.lit(0.0), F.lit(None).cast("string")


def score_roles(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``field_name, inferred_role, confidence, reason`` of columns with their sample ``values``.

    A matching name gives 0.75, telling values more; a column that nothing fits is a category of 0.35. Word boundaries in
    the patterns see the underscores of a name as letters.
    """
    name, values = field_form(F.col("field_name")), F.col("values")
    found = []
    for role, patterns in ROLE_PATTERNS.items():
        by_name = name.rlike("|".join(patterns))
        score, why = _value_score(role, values)
        best = F.greatest(F.when(by_name, 0.75).otherwise(0.0), score)
        found.append(
            F.struct(
                F.lit(role).alias("inferred_role"),
                F.bround(F.least(best, F.lit(0.98)), 2).alias("confidence"),
                F.array_join(F.array_compact(F.array(F.when(by_name, "header name match"), why)), "; ").alias("reason"),
            )
        )
    fits = F.filter(F.array(*found), lambda x: x["confidence"] > 0)
    fallback = F.array(
        F.struct(
            F.lit("category_field").alias("inferred_role"),
            F.lit(0.35).alias("confidence"),
            F.lit("fallback low-cardinality/string candidate").alias("reason"),
        )
    )
    rows = samples.select(*keys, "field_name", F.explode(F.when(F.size(fits) > 0, fits).otherwise(fallback)).alias("x"))
    return rows.select(*keys, "field_name", "x.inferred_role", "x.confidence", "x.reason")


def infer_roles(df: DataFrame, order: str | None = None) -> DataFrame:
    """Roles of all columns of a table, by column, confidence and role."""
    return score_roles(column_samples(df, order)).orderBy("field_name", F.desc("confidence"), "inferred_role")


def fields_by_role(roles: list, role: str) -> str:
    """Names of the fields of a role with a confidence of one half or more, in one cell."""
    return SEPARATOR.join(r["field_name"] for r in roles if r["inferred_role"] == role and r["confidence"] >= 0.5)
