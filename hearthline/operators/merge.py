"""Merging of partial records: nodes into listings, tenancies onto configurations, features from several places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import key, slug, strip


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows of each key the one that comes first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def nodes_to_listing(nodes: DataFrame, job: str, node: str, value: str, names: list[int]) -> DataFrame:
    """One row a job with the largest value of each node as a column node_<n>."""
    return nodes.groupBy(job).pivot(node, names).agg(F.max(value)).select(job, *(F.col(str(n)).alias(f"node_{n}") for n in names))


def resolve(pairs: list[tuple[Column, Column]]) -> tuple[list[Column], Column]:
    """For pairs of the same field from two nodes: the value (the first node's unless blank), and how many pairs conflict."""
    filled = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    values = [F.when(filled(a), a).otherwise(b) for a, b in pairs]
    return values, sum(((filled(a) & filled(b) & (a != b)).cast("int") for a, b in pairs), F.lit(0))


def attach(options: DataFrame, configurations: DataFrame, id_column: str, name_column: str, scope: list[str]) -> DataFrame:
    """Options with the configuration (``cfg``) they belong to: by id, else by the slug of the name; of equal names the last.

    Both frames have ``scope``, ``id_column`` and ``name_column``; configurations have ``cfg`` and ``pos`` as well."""
    by_id = configurations.filter(F.col(id_column).isNotNull()).groupBy(*scope, id_column).agg(F.max_by("cfg", "pos").alias("__by_id"))
    by_name = configurations.withColumn("__slug", slug(F.col(name_column))).groupBy(*scope, "__slug").agg(F.max_by("cfg", "pos").alias("__by_name"))
    out = options.withColumn("__slug", slug(F.col(name_column))).join(by_id, [*scope, id_column], "left").join(by_name, [*scope, "__slug"], "left")
    return out.withColumn("cfg", F.coalesce("__by_id", "__by_name")).withColumn("matched_by", F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_name").isNotNull(), "name")).drop("__slug", "__by_id", "__by_name")


def distinct_options(options: DataFrame, scope: list[str], weeks: str, length: str, price: str, order: list) -> DataFrame:
    """One option for each length (in weeks, or as text if unknown) and price."""
    by = options.withColumn("__key", F.coalesce(F.col(weeks).cast("string"), key(F.col(length))))
    return first_of(by, [*scope, "__key", price], order).drop("__key")


def union_features(sources: list[DataFrame], scope: list[str], name: str) -> DataFrame:
    """Names of all sources, each once by its compared form, as the earliest source spells it."""
    ranked = [s.select(*scope, name, F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, ranked).withColumn("__key", key(F.col(name))).filter("__key <> ''")
    return first_of(every, [*scope, "__key"], ["rank", name]).drop("__key")


def default_names(configurations: DataFrame, scope: list[str], name: str, order: list) -> DataFrame:
    """Blank names become unnamed_config_<n> (n by order); then one row a compared name."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    named = configurations.withColumn("__n", n).withColumn(name, F.when(F.coalesce(strip(F.col(name)), F.lit("")) == "", F.concat(F.lit("unnamed_config_"), F.col("__n"))).otherwise(F.col(name)))
    return first_of(named.withColumn("__key", key(F.col(name))), [*scope, "__key"], ["__n"]).drop("__n", "__key")


def with_missing(preferred: DataFrame, others: DataFrame, scope: list[str], name: str) -> DataFrame:
    """``preferred`` and those rows of ``others`` whose compared name it lacks."""
    k = key(F.col(name)).alias("__key")
    have = preferred.select(*scope, k).distinct()
    return preferred.unionByName(others.withColumn("__key", key(F.col(name))).join(have, [*scope, "__key"], "left_anti").drop("__key"))


def without_empty(c: Column) -> Column:
    """A JSON text of the record without null fields; 0 and false stay."""
    return F.to_json(c, {"ignoreNullFields": "true"})
