"""A table of the latest row of each key, kept in buckets that a batch rewrites only where it has rows.

Below a path: delta=N/bucket=B holds what batch N has for a bucket, base=N/bucket=B a bucket merged at batch N, and
versions/version=N which of them make up the table after batch N. Files are never changed; a batch that is repeated starts from the
version before it, and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version long, bucket int, place int, folder string"


def _latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("x")).select(key, "x.*").select(*rows.columns)


def folders(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each bucket in the newest version, or the newest one before a number; as many rows as buckets times deltas."""
    try:
        stored = spark.read.schema(VERSION).parquet(f"{path}/versions")
        stored = stored if before is None else stored.filter(F.col("version") < before)
        newest = stored.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out: dict[int, list[str]] = {}
    for r in stored.filter(F.col("version") == newest).orderBy("bucket", "place").collect() if newest is not None else []:
        out.setdefault(r["bucket"], []).append(r["folder"])
    return out


def upsert(path: str, key: str, order: list[str], buckets: int = 64, deltas: int = 8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts the rows of a batch into the table at ``path``; of a key the row that is last by ``order`` stays.

    A batch writes one delta for each bucket it touches. A bucket with more than ``deltas`` of them is merged into a new base."""

    def put(rows: DataFrame, folder: str) -> list[int]:
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
        try:
            return [r[0] for r in rows.sparkSession.read.parquet(folder).select("bucket").distinct().collect()]
        except AnalysisException:  # no rows, so no files
            return []

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = folders(spark, path, number)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        for b in put(_latest(batch, key, order).withColumn("bucket", bucket), f"{path}/delta={number}"):
            state[b] = [*state.get(b, []), f"{path}/delta={number}/bucket={b}"]
        full = [b for b, held in state.items() if len(held) > deltas]
        if full:
            rows = spark.read.schema(batch.schema).parquet(*(f for b in full for f in state[b]))
            put(_latest(rows, key, order).withColumn("bucket", bucket), f"{path}/base={number}")
            state |= {b: [f"{path}/base={number}/bucket={b}"] for b in full}
        version = [(number, b, i, f) for b, held in sorted(state.items()) for i, f in enumerate(held)]
        spark.createDataFrame(version, VERSION).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={number}")

    return each


def latest(spark: SparkSession, path: str, key: str, order: list[str], schema) -> DataFrame:
    """The table as its newest version has it."""
    held = [f for fs in folders(spark, path).values() for f in fs]
    return _latest(spark.read.schema(schema).parquet(*held), key, order) if held else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the folders of buckets that none of the newest ``keep`` versions has, and older versions."""
    versions = sorted(r[0] for r in spark.read.schema(VERSION).parquet(f"{path}/versions").select("version").distinct().collect())
    held = {f for v in versions[-keep:] for fs in folders(spark, path, v + 1).values() for f in fs}
    older = [f for v in versions[:-keep] for fs in folders(spark, path, v + 1).values() for f in fs]
    files = spark._jvm.org.apache.hadoop.fs
    for f in {*older, *(f"{path}/versions/version={v}" for v in versions[:-keep])} - held:
        at = files.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
