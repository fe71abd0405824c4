"""Shapes in which listings leave: flat, long, wide, and as records of other systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame, options: str, prefix: str) -> DataFrame:
    """One row for each option with its fields under ``prefix``; a record without options stays as one row."""
    fields = df.schema[options].dataType.elementType.names
    rest = [c for c in df.columns if c != options]
    opened = df.select(*rest, F.explode_outer(options).alias("__o"))
    return opened.select(*rest, *(F.col(f"__o.{f}").alias(prefix + f) for f in fields))


def long_rows(df: DataFrame, keys: list[str], section: str, fields: list[str], node: int) -> DataFrame:
    """(section, field, value, node): one row for each field."""
    rows = df.select(*keys, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(keys, fields, "field", "value")
    return rows.select(*keys, F.lit(section).alias("section"), "field", "value", F.lit(node).alias("node"))


def numbered_rows(df: DataFrame, keys: list[str], section: str, label: str, items: str, node: int) -> DataFrame:
    """The same for the items of an array, numbered from 1."""
    rows = df.select(*keys, F.posexplode(items).alias("i", "value"))
    return rows.select(*keys, F.lit(section).alias("section"), F.concat_ws(" ", F.lit(label), F.col("i") + 1).alias("field"), "value", F.lit(node).alias("node"))


def wide(records: DataFrame) -> DataFrame:
    """Nested parts as columns with a prefix; features joined."""
    basic = [F.col(f"basic_info.{f}").alias(f"basic_{f}") for f in records.schema["basic_info"].dataType.names]
    place = [F.col(f"location.{f}").alias(f"location_{f}") for f in records.schema["location"].dataType.names]
    return records.select("property_id", *basic, *place, F.array_join("features", ", ").alias("features"))


def crm(records: DataFrame) -> DataFrame:
    """Title, place and counts."""
    return records.select("property_id", F.col("basic_info.name").alias("title"), F.concat_ws(", ", "location.city", "location.region").alias("place"), F.size("features").cast("long").alias("features"), F.size("configurations").cast("long").alias("configurations"))


def header(records: DataFrame) -> DataFrame:
    """Counts and the first ten features."""
    return records.select("property_id", F.size("configurations").cast("long").alias("configurations"), F.size("features").cast("long").alias("features"), F.array_join(F.slice("features", 1, 10), ", ").alias("first_features"))


SHAPES = {"standard": lambda d: d, "airtable": wide, "crm": crm}


def shaped(records: DataFrame, form: str = "standard") -> DataFrame:
    """The records in the named form; an unknown form is the standard one."""
    return SHAPES.get(form, SHAPES["standard"])(records)
