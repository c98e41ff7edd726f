"""Session helpers shared by every operator: table access and fault-tolerant lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``.

    Only where the session has none, and runs inside one machine, a temporary folder is made; it goes when the process ends.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        made = tempfile.mkdtemp(prefix="lexistrata-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        set_dir = f"file://{made}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, read back: for what is large beside the input. Order is not kept."""
    path = unique_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lexistrata-{name}-{uuid.uuid4().hex}"


def col_or(df: DataFrame, name: str, default: Column | str | None = "") -> Column:
    """A column of ``df``, or a default where ``df`` has none of that name."""
    if name in df.columns:
        return F.col(f"`{name}`")
    return default if isinstance(default, Column) else F.lit(default)


def text_or_empty(df: DataFrame, name: str) -> Column:
    """A column as a string, with null and missing as the empty string."""
    return F.coalesce(col_or(df, name, "").cast("string"), F.lit(""))
