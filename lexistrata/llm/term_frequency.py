"""Frequency of every distinct value over a collection, with bounds for the useful ones.

Each row first yields one count per (field, term, record), combined by hash on the map side, so that a
redelivered record or a term repeated inside a record never crosses the network twice from one task. A second
aggregate sums occurrences and counts records. Nothing is collected and no group is gathered: a term that a
third of all rows hold is only ever a partial count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.functions.cleaning import clean


def _items(name: str, values: Column) -> Column:
    """One (field, cleaned term) for each array item."""
    return F.transform(
        F.coalesce(values, F.array().cast("array<string>")),
        lambda value: F.struct(F.lit(name).alias("field"), clean(value).alias("term")),
    )


def term_frequency(
    df: DataFrame,
    fields: Mapping[str, Column],
    record_id: Column,
    row_id: Column,
    *,
    rare_at_most: int = 2,
    common_share: tuple[int, int] = (1, 10),
) -> DataFrame:
    """Occurrences and records of every cleaned term of each field.

    ``fields`` maps a name to an array-of-string expression over ``df``. Records are distinct ``record_id``s; a row
    whose id is null counts as a record of its own, told apart by ``row_id``. Returns ``field, term, occurrences,
    records, all_records, mark``; ``mark`` is ``rare`` (at most ``rare_at_most`` records), else ``common`` (more than
    ``common_share`` of all records), else null.

    Null arrays, null items and items that are blank after cleaning hold no term. Rows with no term still count as
    records. Repeated rows of an id add occurrences, not records. An empty table gives no rows. Other columns of
    ``df``, whatever their names, are dropped before anything is shuffled.
    """
    record = F.coalesce(F.concat(F.lit("i"), record_id.cast("string")), F.concat(F.lit("r"), row_id.cast("string")))
    items = F.flatten(F.array(*(_items(name, values) for name, values in fields.items())))
    rows = df.select(record.alias("_record"), items.alias("_items"))
    # In each field a marker without term stands for the record itself, so that one scan gives both counts.
    marker = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("term")) for f in fields))
    kept = F.filter(F.col("_items"), lambda x: F.length(x["term"]) > 0)
    per_record = (
        rows.select("_record", F.explode(F.concat(marker, kept)).alias("_x"))
        .groupBy("_x.field", "_x.term", "_record")
        .agg(F.count("*").alias("_n"))
    )
    counted = per_record.groupBy("field", "term").agg(
        F.sum("_n").alias("occurrences"), F.count("*").alias("records")
    )
    # One row a field: its number is that of the given fields, whatever the data.
    total = counted.where(F.col("term").isNull()).select("field", F.col("records").alias("all_records"))
    joined = counted.where(F.col("term").isNotNull()).join(F.broadcast(total), "field")
    over, of = common_share
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(
        F.col("records") * of > F.col("all_records") * over, "common"
    )
    return joined.withColumn("mark", mark)
