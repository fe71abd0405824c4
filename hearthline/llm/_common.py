"""Helpers that the operators share: tables, the shared folder, and pickling for the workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 4 << 20


def ship(name: str) -> None:
    """Pickle the functions of module ``name`` by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share. On one machine alone, where nothing is shared, it
    may be unset, and a temporary folder serves; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_hearthline_dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark._hearthline_dir = base
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once, and lost executors cost no lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the table that ``written`` gave, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES, as texts may be long; a lower bound in bytes that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(key).rstrip("bB")
    if not known.isdigit() or int(known) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that is free back to the system: workers live on, and the next operator needs it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and ``more``) of ``docs``, whatever other columns it carries."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(docs[c] for c in more))


def local_path(uri: str) -> str:
    return uri[len("file://"):] if uri.startswith("file://") else uri


def ensure_dir(uri: str) -> None:
    """Makes a folder of the shared store (any store that pyarrow opens by its address)."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        os.makedirs(local_path(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri), exist_ok=True)
        return
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
