"""Catalog records as streams: read page by page or from files as they come, flattened on the way, written once each.

Flattening is one projection, so that a stream needs no state for it. Counts by time need some: they are kept for as long as
the watermark says that late records may still come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexistrata.operators.flatten import flatten_records
from lexistrata.operators.nested import parse_object


def read_search(spark: SparkSession, endpoint: str, *, source: str = "catalog_search", **options: str) -> DataFrame:
    """``ord, record`` of search pages as they are read; ``source`` is the registered name of the data source."""
    rows = spark.readStream.format(source).options(endpoint=endpoint, **options).load()
    return rows.select("ord", parse_object(F.col("record")).alias("record"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``record`` of the lines of JSONL files that come into a folder; lines that are no object are left out."""
    lines = spark.readStream.text(folder)
    return lines.select(parse_object(F.col("value")).alias("record")).where("record is not null")


def flattened(records: DataFrame, *keep: str) -> DataFrame:
    """The 48 metadata columns of every record of a stream."""
    return flatten_records(records, "record", *keep)


def counts_by_time(records: DataFrame, time: Column, key: Column, *, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start, key, n``: records by window of time and key; those later than ``late`` behind the newest are left out."""
    timed = records.select(time.alias("_time"), key.alias("key")).withWatermark("_time", late)
    counted = timed.groupBy(F.window("_time", window).alias("_w"), "key").agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("start"), "key", "n")


def write_table(rows: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Write all that has come so far to Parquet, each row once, and stop; the next call goes on from there."""
    writer = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
