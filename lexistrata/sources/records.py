"""Reading and writing records: JSON lines, JSON documents, CSV without type inference."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistrata.operators.nested import as_list, is_object, member, parse_object


def read_jsonl(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """``ord, record``: the objects of a JSONL file in the order of its lines.

    Blank lines are skipped, other JSON values dropped. A line that is no JSON stops the read in ``strict`` mode, with its
    number, and is dropped otherwise. Lines are only numbered to tell of a wrong one: ``ord`` orders them, with gaps.
    """
    lines = spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("ord"), F.col("value").alias("line"))
    if strict:
        wrong = lines.where((F.trim("line") != "") & F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit("]"))).isNull())
        first = wrong.agg(F.min("ord")).first()[0]
        if first is not None:
            raise ValueError(f"Invalid JSONL at {path}:{lines.where(F.col('ord') <= first).count()}")
    return lines.select("ord", parse_object(F.col("line")).alias("record")).where(F.col("record").isNotNull())


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``ord, record``: the objects of a JSON document: of a list, of its ``results`` list, or the one object itself."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("d"))
    results = member(F.col("d"), "results")
    listed = F.schema_of_variant(results).startswith("ARRAY")
    items = as_list(F.when(F.coalesce(listed, F.lit(False)), results).otherwise(F.col("d")))
    rows = doc.select(F.posexplode(items).alias("ord", "record"))
    return rows.select(F.col("ord").cast("long"), "record").where(is_object(F.col("record")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``ord, record`` of a JSON or JSONL file, by its ending."""
    return read_jsonl(spark, path) if PurePosixPath(path).suffix.lower() == ".jsonl" else read_json(spark, path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a string, blanks as empty strings, and ``ord``, the place of the row."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return rows.na.fill("").withColumn("ord", F.monotonically_increasing_id())


def read_optional_csv(spark: SparkSession, path: str | None) -> DataFrame | None:
    """``read_csv``, or nothing where there is no such file."""
    if not path:
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return read_csv(spark, path) if exists else None


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``ord, record`` of a CSV, JSON or JSONL file."""
    if PurePosixPath(path).suffix.lower() != ".csv":
        return read_records(spark, path)
    rows = read_csv(spark, path)
    columns = [c for c in rows.columns if c != "ord"]
    return rows.select("ord", F.parse_json(F.to_json(F.struct(*columns))).alias("record"))


def with_counts(df: DataFrame, *names: str) -> DataFrame:
    """Columns read as text made whole numbers, null where they are none."""
    return df.withColumns({n: F.col(n).try_cast("double").cast("long") for n in names if n in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file in the folder ``path``; lists and objects are the caller's to put into cells."""
    flat = df.drop("ord")
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in flat.schema.fields):
        raise ValueError("nested columns have no place in CSV")
    flat.coalesce(1).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_jsonl(df: DataFrame, path: str, record: str = "record") -> None:
    """One JSON object a line."""
    df.select(F.to_json(record).alias("value")).write.mode("overwrite").text(path)
