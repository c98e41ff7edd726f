"""Suggested fields of the standard vocabulary for the fields of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.constants import FIELD_ALIASES, REQUIRED_FIELDS
from lexistrata.functions.similarity import token_set_ratio
from lexistrata.functions.text import field_form, literals, lookup

LEAST = 0.82


def suggest_fields(fields: DataFrame, *, include_identity: bool = False) -> DataFrame:
    """``input_field, suggested_dcat_field, confidence, reason, example_value, warning_if_required_field_missing``.

    ``fields`` has ``input_field, example_value``, one row a field. A field is an alias, or most like one by at least
    0.82 of its characters, the first of equals; ``include_identity`` lets the standard names stand for themselves, which
    they do not do by themselves. Every row names the required fields that nothing was mapped to.
    """
    aliases = FIELD_ALIASES | ({name: name for name in REQUIRED_FIELDS} if include_identity else {})
    named = fields.withColumn("_f", F.regexp_replace(field_form(F.col("input_field")), "^distribution_", ""))
    exact = lookup(aliases, F.col("_f"))
    # Each field meets every alias of the fixed dictionary as items of one array, so that nothing is joined.
    tried = named.where(exact.isNull()).select("input_field", "_f", F.posexplode(literals(list(aliases))).alias("_p", "_alias"))
    scored = tried.withColumn("_s", F.bround(token_set_ratio("_f", "_alias"), 3))
    best = scored.groupBy("input_field").agg(F.max_by(F.struct("_alias", "_s"), F.struct("_s", (-F.col("_p")).alias("p"))).alias("_b"))
    joined = named.join(best, "input_field", "left")
    sure = F.col("_b._s") >= LEAST
    rows = joined.select(
        "input_field",
        F.coalesce(exact, F.when(sure, lookup(aliases, F.col("_b._alias"))), F.lit("")).alias("suggested_dcat_field"),
        F.when(exact.isNotNull(), 1.0).when(sure, F.col("_b._s")).otherwise(0.0).alias("confidence"),
        F.when(exact.isNotNull(), "seed alias dictionary")
        .when(sure, F.concat(F.lit("fuzzy alias match: "), F.col("_b._alias")))
        .otherwise("no confident mapping")
        .alias("reason"),
        F.coalesce("example_value", F.lit("")).alias("example_value"),
    )
    warning = missing_required(rows).first()  # one text, whatever the number of fields
    return rows.withColumn("warning_if_required_field_missing", F.lit(warning[0] if warning else ""))


def missing_required(rows: DataFrame) -> DataFrame:
    """One row: the warning that names the required fields without a mapping, empty if there is none."""
    present = F.collect_set(F.when(F.col("suggested_dcat_field").isin(REQUIRED_FIELDS), F.col("suggested_dcat_field")))
    missing = F.array_except(literals(REQUIRED_FIELDS), present)
    warning = F.when(F.size(missing) > 0, F.concat(F.lit("Missing likely required fields: "), F.array_join(missing, ", "))).otherwise("")
    return rows.agg(warning.alias("warning_if_required_field_missing"))

