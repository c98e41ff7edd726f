"""Queries of the general data problems: nested records, packed fields and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint, table
from lexistrata.operators import nested, packed, timestamps


def _values(rows: DataFrame, src: str, key: str, path: str | Column, rec_pos: Column, pos: Column, value: Column) -> DataFrame:
    """Rows with a value. Keys are unique and a place holds one value, so that nothing needs to be made distinct."""
    return (
        rows.select(
            F.lit(src).alias("src"),
            F.col(key).cast("long").alias("row_id"),
            rec_pos.cast("int").alias("rec_pos"),
            (F.lit(path) if isinstance(path, str) else path).alias("path"),
            pos.cast("int").alias("pos"),
            value.alias("value"),
        )
        .where(F.length("value") > 0)
    )


def _of_lines(raw: DataFrame) -> DataFrame:
    """Child rows of feed lines, whose records stand alone or in a ``results`` list: every line is parsed once.

    The schema over all lines tells where lists of records are; each line then gives its records, each record its children.
    """
    seen = checkpoint(nested.merged_schema(raw, "payload", maps=["extras"]))
    kinds = {(row.path, row.kind) for row in seen.select("path", "kind").collect()}
    listed = [at for at in ("results", "data.results") if (at, "array") in kinds]
    docs = raw.select("line_no", nested.parse_object(F.col("payload")).alias("_doc")).where("_doc is not null")
    lists = [F.try_variant_get(nested.member(F.col("_doc"), *at.split(".")), "$", "array<variant>") for at in listed]
    found = docs.select("line_no", F.posexplode(F.coalesce(*lists, F.array("_doc"))).alias("_rec", "_item"))
    records = found.where(nested.is_object(F.col("_item")))
    dcat, extras = nested.member(F.col("_item"), "dcat"), nested.member(F.col("_item"), "extras")
    holder = F.when(nested.is_object(dcat), dcat).otherwise(F.col("_item"))
    children = nested.child_rows(
        records,
        ["line_no", "_rec"],
        {
            "resources.downloadURL": nested.member(F.col("_item"), "resources"),
            "extras.key": F.when(~nested.is_object(extras), extras),
            "contactPoint.hasEmail": nested.member(holder, "contactPoint"),
            "extras keys": nested.keys_as_list(extras),
        },
    )
    text = lambda name: F.try_variant_get(F.col("_item"), f"$['{name}']", "string")
    name = F.col("_path")
    own = F.when(nested.is_object(F.col("_item")), F.when(name == "resources.downloadURL", text("downloadURL")).when(name == "extras.key", text("key")).otherwise(text("hasEmail")))
    is_key = name == "extras keys"
    value = F.when(is_key, F.try_variant_get("_item", "$", "string")).otherwise(own)
    pos = F.when(is_key, F.lit(-1)).otherwise(F.col("_ord"))
    path = F.when(is_key, F.lit("extras.key")).otherwise(name)
    return _values(children, "raw_records", "line_no", path, F.col("_rec"), pos, value)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download links, extra keys and contact addresses of all nested records, with their places."""
    sample = table(spark, sf_dir, "sample_records")
    catalog = table(spark, sf_dir, "catalog_records")
    raw = table(spark, sf_dir, "raw_records")
    none = F.lit(0)
    links = nested.shred_struct(sample, ["row_id"], "resources")["resources[]"]
    extras = nested.shred_struct(sample, ["row_id"], "extras")["extras[]"]
    parts = [
        _values(links, "sample_records", "row_id", "resources.downloadURL", none, F.col("_ord"), F.col("_item.downloadURL")),
        _values(extras, "sample_records", "row_id", "extras.key", none, F.col("_ord"), F.col("_item.key")),
        _values(
            catalog, "catalog_records", "row_id", "contactPoint.hasEmail", none, none, F.col("dcat.contactPoint.hasEmail")
        ),
        _of_lines(raw),
    ]
    return reduce(DataFrame.unionByName, parts)


def _packed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, catalog = table(spark, sf_dir, "sample_records"), table(spark, sf_dir, "catalog_records")

    def items(rows: DataFrame, field: str, values: Column) -> DataFrame:
        return rows.select("row_id", F.lit(field).alias("field"), F.posexplode(values).alias("item_pos", "item"))

    return (
        items(sample, "tags.name", F.col("tags.name"))
        .unionByName(items(catalog, "dcat.keyword", F.col("dcat.keyword")))
        .unionByName(items(catalog, "dcat.bureauCode", F.col("dcat.bureauCode")))
        .where(F.col("item").isNotNull())
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of every item that holds two or more."""
    split = packed.unpack(_packed_items(spark, sf_dir), "item").where(F.size("_values") >= 2)
    return split.select(
        "row_id", "field", "item_pos", F.posexplode("_values").alias("value_pos", "value")
    )


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, catalog = table(spark, sf_dir, "sample_records"), table(spark, sf_dir, "catalog_records")

    def field(rows: DataFrame, name: str, value: str) -> DataFrame:
        return rows.select("row_id", "portal_id", F.lit(name).alias("field"), F.col(value).alias("text"))

    rows = (
        field(sample, "metadata_modified", "metadata_modified")
        .unionByName(field(catalog, "dcat.modified", "dcat.modified"))
        .unionByName(field(catalog, "dcat.issued", "dcat.issued"))
        .where(F.col("text").isNotNull())
    )
    portals = table(spark, sf_dir, "portals").select("portal_id", "tz", "date_order")
    return timestamps.normalise_times(rows.join(portals, "portal_id", "left"), "text", "portal_id", "tz", "date_order")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every text that states a time."""
    return _times(spark, sf_dir).where(F.col("utc_micros").isNotNull()).select("row_id", "field", "utc_micros").distinct()


def p6_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by field and format family, with those left open or unread."""
    return (
        _times(spark, sf_dir)
        .groupBy("field", F.coalesce("family", F.lit("none")).alias("family"))
        .agg(
            F.count("*").alias("values"),
            F.count_if(F.col("utc_micros").isNotNull()).alias("resolved"),
            F.count_if("ambiguous").alias("ambiguous"),
        )
    )


def queries() -> dict:
    """Callables by query name."""
    return {"p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_formats": p6_formats}
