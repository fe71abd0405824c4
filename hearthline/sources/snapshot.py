"""Snapshots and files: JSON and CSV written by Spark and read with an explicit schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and lost executors cost no lineage."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines; ``by``: one folder for each value, such as one for each job."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Writes a frame out and returns what its files hold, read with the same schema."""
    write_json(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with the sorted column names as header."""
    df.select(sorted(df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)
