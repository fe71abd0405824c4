"""Model responses: JSON objects in fences or between words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column) -> Column:
    """The text inside a code fence, else from the first brace to the last; null if there is neither."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    greedy = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(fenced, greedy)


def parsed(c: Column, schema: str) -> Column:
    """A struct of ``schema``; its fields are null where the text holds no such object."""
    return F.from_json(json_text(c), schema)


def structure_error(c: Column) -> Column:
    """What keeps a text from being a JSON object, or null."""
    v, alone = F.try_parse_json(c), F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))  # in brackets, what follows the object shows
    whole = v.isNotNull() & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    return F.when(~F.coalesce(whole, F.lit(False)), "Invalid JSON format").when(~F.schema_of_variant(v).startswith("OBJECT"), "must be a JSON object")
