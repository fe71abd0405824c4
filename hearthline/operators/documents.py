"""Scores of JSON documents that share no schema: a walk over their nodes, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.snapshot import written


def walk(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, counted, filled, leaf) of every node below the root of each document ``text``, at any depth.

    ``path``: keys joined by dots, places in lists in brackets. ``counted``: every key of an object and every plain item of a list, but no
    container in a list. ``filled``: counted, and neither null nor blank; containers are never blank. ``leaf``: plain, and neither null, blank,
    0 nor false. A text that is null, no JSON, a plain value, larger than a Variant may be (128 MB) or has a key of an object twice has no
    nodes; what follows the first value in a text is not looked at. Repeated keys of rows and extra columns don't matter.

    Each round explodes the containers of one level, so there are as many as the deepest document has levels. A level is written to the
    shared folder, where only containers keep their value."""
    level = docs.select(F.col(key).alias("__key"), F.lit("").alias("__at"), F.try_parse_json(F.col(text).cast("string")).alias("__in")).filter(_container(F.schema_of_variant("__in")))
    found = []
    while True:
        d = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("__in").outer()))
        named, kind = F.col("key").isNotNull(), F.schema_of_variant("value")
        below = F.when(~named, F.concat("__at", F.lit("["), "pos", F.lit("]"))).when(F.col("__at") == "", F.col("key")).otherwise(F.concat("__at", F.lit("."), "key"))
        d = d.select("__key", below.alias("__at"), named.alias("__named"), kind.alias("__kind"), F.col("value").alias("__in")).withColumn("__many", _container(F.col("__kind")))
        plain = strip(F.try_variant_get("__in", "$", "string"))
        there = F.coalesce(F.when(F.col("__many"), F.lit(True)).otherwise(plain != ""), F.lit(False))
        number = F.coalesce(F.try_variant_get("__in", "$", "double") != 0, F.lit(True))
        weighs = F.when(F.col("__kind") == "BOOLEAN", F.try_variant_get("__in", "$", "boolean")).when(F.col("__kind") == "STRING", F.lit(True)).otherwise(number)
        counted = F.col("__named") | ~F.col("__many")
        kept = F.when(F.col("__many"), F.col("__in")).alias("__in")
        level = written(d.select("__key", "__at", counted.alias("counted"), (counted & there).alias("filled"), (~F.col("__many") & there & weighs).alias("leaf"), kept), "nodes")
        found.append(level.select(F.col("__key").alias(key), F.col("__at").alias("path"), "counted", "filled", "leaf"))
        level = level.filter("__in IS NOT NULL").select("__key", "__at", "__in")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _container(kind):
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def scores(docs: DataFrame, key: str, text: str) -> DataFrame:
    """total, filled, completeness (their ratio, 0 without fields) and leaves of each key of ``docs``, also where it has no nodes."""
    one = lambda c: F.col(c).cast("long").alias(c)
    none = docs.select(key, *(F.lit(0).cast("long").alias(c) for c in ("counted", "filled", "leaf")))
    every = none.unionByName(walk(docs, key, text).select(key, one("counted"), one("filled"), one("leaf")))
    d = every.groupBy(key).agg(F.sum("counted").alias("total"), F.sum("filled").alias("filled"), F.sum("leaf").alias("leaves"))
    return d.withColumn("completeness", F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(0.0))


def presence(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, present): 1 for each counted path that is filled in any node of it, else 0."""
    return walk(docs, key, text).filter("counted").groupBy(key, "path").agg(F.max(F.col("filled").cast("int")).alias("present"))
