"""Completeness, confidence and quality of records, as column expressions built from their schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_of, strip

# The weight of each field of a node when it is filled.
NODE1_WEIGHTS = {
    "basic_info.name": 1.0, "basic_info.guarantor_required": 0.8, "basic_info.property_type": 0.6, "basic_info.contact.phone": 0.5, "location.location_name": 1.0, "location.latitude": 0.9, "location.longitude": 0.9, "location.address": 0.7,
    "location.city": 0.8, "location.region": 0.8, "location.country": 0.7, "location.postcode": 0.6, "features": 0.7, "property_rules": 0.5, "safety_and_security": 0.5,
}
NODE2_WEIGHTS = {"description.about": 1.0, "description.features": 0.8, "description.commute": 0.6, "description.faqs": 0.7}
LOCATION_FIELDS = ("latitude", "longitude", "address", "city", "region", "country", "postcode")


def _at(c: Column, path: str) -> Column:
    for part in path.split("."):
        c = c[part]
    return c


def _has(kind: T.DataType, path: str) -> T.DataType | None:
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def present(c: Column, kind: T.DataType) -> Column:
    """Neither null nor blank; containers are there if they are not null."""
    return c.isNotNull() if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.coalesce(strip(c.cast("string")) != "", F.lit(False))


def truthy(c: Column, kind: T.DataType) -> Column:
    """Neither null, empty, zero nor false."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.StructType):
        return c.isNotNull()
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce(c.cast("double") != 0, F.lit(False)) if not isinstance(kind, T.BooleanType) else F.coalesce(c, F.lit(False))


def counts(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(total, filled): every key of a struct and every plain item of a list counts, at all depths."""
    total, filled = [], []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            total.append(F.lit(1))
            filled.append(present(c[f.name], f.dataType).cast("int"))
            if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                a, b = counts(c[f.name], f.dataType)
                total.append(a)
                filled.append(b)
    elif isinstance(kind, T.ArrayType):
        nested = isinstance(kind.elementType, (T.StructType, T.ArrayType))
        items = (lambda x: counts(x, kind.elementType)) if nested else (lambda x: (F.lit(1), present(x, kind.elementType).cast("int")))
        total.append(F.aggregate(c, F.lit(0), lambda acc, x: acc + items(x)[0]))
        filled.append(F.aggregate(c, F.lit(0), lambda acc, x: acc + items(x)[1]))
    add = lambda cs: F.when(c.isNotNull(), sum(cs, F.lit(0))).otherwise(0)
    return add(total), add(filled)


def completeness(c: Column, kind: T.DataType) -> Column:
    total, filled = counts(c, kind)
    return F.when(total > 0, filled / total).otherwise(0.0)


def presence(c: Column, kind: T.StructType, prefix: str = "") -> list[Column]:
    """Structs (path, present) of every key of a struct, at all depths of structs."""
    out = []
    for f in kind.fields:
        path = f"{prefix}{f.name}"
        out.append(F.struct(F.lit(path).alias("path"), F.coalesce(present(c[f.name], f.dataType), F.lit(False)).cast("int").alias("present")))
        if isinstance(f.dataType, T.StructType):
            out += presence(c[f.name], f.dataType, path + ".")
    return out


def non_empty(c: Column, kind: T.DataType) -> Column:
    """Leaves that are neither null nor blank."""
    if isinstance(kind, T.StructType):
        out = F.lit(0)
        for f in kind.fields:
            out = out + non_empty(c[f.name], f.dataType)
        return F.coalesce(out, F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0), lambda acc, x: acc + non_empty(x, kind.elementType)), F.lit(0))
    return present(c, kind).cast("int")


def richness(c: Column, kind: T.DataType) -> Column:
    return F.least(F.lit(0.1), non_empty(c, kind) * 0.005)


def weighted_presence(c: Column, kind: T.DataType, weights: dict[str, float]) -> Column:
    """Share of the weights whose field is filled."""
    got = F.lit(0.0)
    for path, w in weights.items():
        if (k := _has(kind, path)) is not None:
            got = got + F.when(truthy(_at(c, path), k), w).otherwise(0.0)
    return got / sum(weights.values())


def node1_bonus(c: Column, kind: T.DataType) -> Column:
    """Location .15 by share, guarantor .05, property type .03, phone .02, features .01 each up to .05."""
    filled = lambda p: truthy(_at(c, p), k) if (k := _has(kind, p)) is not None else F.lit(False)
    share = sum((filled(f"location.{f}").cast("int") for f in LOCATION_FIELDS), F.lit(0)) / len(LOCATION_FIELDS)
    guarantor = filled("basic_info.guarantor_required") & (c["basic_info"]["guarantor_required"] != "Information unavailable")
    n = F.coalesce(F.size(c["features"]), F.lit(0)) if _has(kind, "features") is not None else F.lit(0)
    return share * 0.15 + F.when(guarantor, 0.05).otherwise(0.0) + F.when(filled("basic_info.property_type"), 0.03).otherwise(0.0) + F.when(filled("basic_info.contact.phone"), 0.02).otherwise(0.0) + F.least(F.lit(0.05), F.greatest(n, F.lit(0)) * 0.01)


def node3_bonus(n: Column, mean_detail: Column) -> Column:
    """By the number of configurations, up to .1, and a tenth of their mean detail."""
    return F.least(F.lit(0.1), n * 0.02) + mean_detail * 0.1


def configuration_detail(name: Column, price: Column, area: Column, types: Column, n_features: Column) -> Column:
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return one(name, 0.2) + one(price, 0.2) + one(area, 0.1) + one(types, 0.1) + F.least(F.lit(1.0), n_features / 3) * 0.1


def option_detail(priced: Column, dated: Column, available: Column) -> Column:
    return F.when(priced, 0.5).otherwise(0.0) + F.when(dated, 0.3).otherwise(0.0) + F.when(available, 0.2).otherwise(0.0)


def tenancy_richness(n_options: Column, mean_detail: Column) -> Column:
    return F.least(F.lit(1.0), n_options / 3) * 0.5 + mean_detail * 0.5


def confidence(base: Column, bonus: Column, rich: Column) -> Column:
    return F.least(F.lit(1.0), base + bonus + rich)


def merge_quality(complete: Column, nodes: Column) -> Column:
    """.4 completeness, .3 share of the four nodes, .3 of a fixed consistency of .9."""
    return complete * 0.4 + nodes / 4 * 0.3 + F.lit(0.3 * 0.9)


def job_quality(mean_confidence: Column, complete: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_confidence * 0.7 + complete * 0.3))


def configuration_quality(name: Column, price: Column, options: Column, area: Column, features: Column) -> Column:
    """.2 name, .2 price, .3 tenancies, .2 area, .1 features."""
    return sum((F.when(c, w).otherwise(0.0) for c, w in ((name, 0.2), (price, 0.2), (options, 0.3), (area, 0.2), (features, 0.1))), F.lit(0.0))


# Error categories in order, with the words that tell them.
ERRORS = {"timeout": ("timeout", "timed out"), "rate_limit": ("rate limit", "429"), "network": ("connection", "network"), "parsing": ("json", "parse"), "validation": ("validation", "invalid")}


def error_category(message: Column) -> Column:
    m, out = F.lower(F.coalesce(message, F.lit(""))), F.lit("unknown")
    for name, words in reversed(ERRORS.items()):
        out = F.when(any_of(m, words), name).otherwise(out)
    return out
