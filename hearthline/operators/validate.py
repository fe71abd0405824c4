"""Validation: every check gives rows (key, section, error); a valid record gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import number
from ..functions.text import strip

# The feature types that a listing may use.
FEATURE_TYPES = (
    "Air Conditioner & Heating", "Balcony or Patios", "Barbeque & Grill", "Business Center", "Cafe & Restaurant", "Fan", "Cinema Room", "Clubhouse", "Courtyard", "Disability Access",
    "Fireplace", "Tile Flooring", "Wooden Flooring", "Carpet Flooring", "Food & Meals", "Garbage Disposal", "Gas Stove", "Gym & Fitness", "Prayer Room", "Internet Access", "Wifi", "Jogging",
    "Kitchen with Appliance", "Laundry Facility", "Library & Study Area", "Lounge", "Maintenance", "Medical Facility", "Microwave", "Parking", "Electronic Payments", "Pet Friendly", "Playground",
    "Snow Removal", "Social Events", "Spa & Salon", "Sport Golf", "Room Storage", "Swimming Pool", "Television", "Sports", "Pets Not Allowed", "Blinds", "Telephone", "Breakfast Bar", "Home Linen",
    "Industry Accreditation & Awards", "Common Social Area", "Unfurnished Accommodations", "Mattress", "Games Area", "Household Supplies", "Sundeck", "Vending Machine", "Bean Bag", "Terrace",
    "Noticeboard", "Property Rules", "Content Insurance", "Ironing Facility", "Flatmate", "Alarm Clock", "Classroom", "Den", "Newly Refurbished", "Fire Extinguisher", "Coffee Machine",
    "Basic Essentials", "Parcel Collection", "Location Benefit", "Dining Area", "Locker & Safes", "Shuttle & Cab Service", "Shops", "Electric Vehicle Charging Station", "Double Occupancy",
    "Guarantor Requirement", "Reception & Staff", "Common Service", "Fully Furnished", "Fridge", "Accommodation Features", "Bathroom", "Others",
)
# What a listing may say of guarantors.
GUARANTOR = (
    "No guarantor required",
    "International and local guarantors allowed",
    "Local guarantor only (third party guarantor service not allowed)",
    "Local guarantor only (third party guarantor service allowed)",
    "Information unavailable",
)
# Least completeness by node, in percent.
COMPLETENESS_GOALS = {1: 80.0, 2: 75.0, 3: 85.0, 4: 80.0}


def url_error(c: Column) -> Column:
    """What is wrong with a web address, or null."""
    s = strip(c)
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(c.isNull() | (c == ""), "URL must be a non-empty string")
        .when(~scheme.isin("http", "https"), "URL must use HTTP or HTTPS protocol")
        .when(host == "", "URL must have a valid domain")
        .when(~host.contains("."), "URL must have a valid domain with at least one dot")
    )


def is_email(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\s()+-]", "").rlike("^[0-9]{7,15}$"), F.lit(False))


def is_date(c: Column) -> Column:
    """In one of the four accepted shapes."""
    return F.coalesce(strip(c).rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{1,2}\s+\w+\s+[0-9]{4})$"), F.lit(False))


def _errors(df: DataFrame, keys: list[str], section: str, checks: list[Column]) -> DataFrame:
    """One row for each check that gives a message."""
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(*keys, F.lit(section).alias("section"), F.explode(found).alias("error"))


def basic_info(df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Required fields, the guarantor choice and the source link. ``columns`` maps the fields to columns."""
    fields = ("name", "guarantor_required", "source", "source_link")
    c = {f: F.col(columns[f]) for f in fields}
    empty = [F.when(c[f].isNull() | (c[f] == ""), F.lit(f"Field '{f}' must be a non-empty string")) for f in fields]
    choice = F.when(~F.coalesce(c["guarantor_required"].isin(*GUARANTOR), F.lit(False)), F.concat(F.lit("Invalid guarantor requirement: "), F.coalesce(c["guarantor_required"], F.lit("None"))))
    link = F.when(c["source_link"] != "", F.concat(F.lit("Invalid source link: "), url_error(c["source_link"])))
    return _errors(df, keys, "basic_info", [*empty, choice, link])


def location(df: DataFrame, keys: list[str], latitude: str, longitude: str) -> DataFrame:
    """Coordinates that are numbers within range; empty ones are not checked."""
    checks = []
    for name, column, most in (("Latitude", latitude, 90), ("Longitude", longitude, 180)):
        text = F.col(column).cast("string")
        value = number(text)
        checks.append(F.when(strip(text) != "", F.when(value.isNull(), f"{name} must be a valid number").when(~value.between(-most, most), f"{name} must be between -{most} and {most}")))
    return _errors(df, keys, "location", checks)


def features(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Items of an array of structs (type, name): the type is one of FEATURE_TYPES, the name is not blank."""
    item = df.select(*keys, F.posexplode(column).alias("i", "f"))
    at = F.concat(F.lit("Feature "), F.col("i").cast("string"))
    kind = F.when(~F.coalesce(F.col("f.type").isin(*FEATURE_TYPES), F.lit(False)), F.concat(at, F.lit(" has invalid type: "), F.coalesce("f.type", F.lit("None"))))
    name = F.when(F.coalesce(strip(F.col("f.name")), F.lit("")) == "", F.concat(at, F.lit(" 'name' must be a non-empty string")))
    return _errors(item, keys, "features", [kind, name])


def pricing(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Filled price fields are numbers, but for signs and white space; ``columns`` maps field names to columns."""
    checks = []
    for field, column in columns.items():
        text = F.col(column).cast("string")
        checks.append(F.when((text != "") & number(F.regexp_replace(text, r"[£$€¥,\s]", "")).isNull(), F.lit(f"Pricing field '{field}' must be a valid number")))
    return _errors(df, keys, "pricing", checks)


def document(keys: list[str], *found: DataFrame) -> DataFrame:
    """All errors of a document by section, with their number: errors of the single checks put together."""
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*keys, "section").agg(F.sort_array(F.collect_list("error")).alias("errors"), F.count(F.lit(1)).alias("n_errors"))


def valid(df: DataFrame, keys: list[str], errors: DataFrame) -> DataFrame:
    """The records without an error."""
    return df.join(errors.select(*keys).distinct(), keys, "left_anti")


def meets_goal(df: DataFrame, node: Column, completeness: Column) -> DataFrame:
    """With the goal of the node and whether its completeness (percent) reaches it."""
    goal = F.element_at(F.create_map(*(F.lit(x) for p in COMPLETENESS_GOALS.items() for x in p)), node)
    return df.withColumn("goal", goal).withColumn("met", completeness >= goal)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is(v: Column, *kinds: str) -> Column:
    return reduce(lambda a, k: a | _kind(v).startswith(k), kinds, F.lit(False))


def _at(v: Column, path: str) -> Column:
    """What stands at a path of a document, JSON nulls too; null where the path is missing."""
    return F.try_variant_get(v, path, "variant")


def _items(df: DataFrame, keys: list[str], list_: Column, where: Column) -> DataFrame:
    """Rows (keys, at, v): the items of a list with their place, after ``where``."""
    items = F.when(_is(list_, "ARRAY"), F.try_variant_get(list_, "$", "array<variant>"))
    return df.select(*keys, where.alias("__where"), F.posexplode(items).alias("__i", "v")).select(*keys, F.concat("__where", F.col("__i").cast("string")).alias("at"), "v")


# The messages of the checks below.
def node2(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """A JSON text with a description: its email, if filled, and its questions."""
    d = df.select(*keys, F.try_parse_json(document).alias("doc"))
    told, email, faqs = _at(F.col("doc"), "$.description"), _at(F.col("doc"), "$.description.email"), _at(F.col("doc"), "$.description.faqs")
    text = F.try_variant_get(F.col("doc"), "$.description.email", "string")
    missing = F.when(told.isNull(), "Missing 'description' section").when(~_is(told, "OBJECT"), "Description must be a dictionary")
    mail = F.when(_is(told, "OBJECT") & _is(email, "STRING") & (text != "") & ~is_email(text), "Invalid email format")
    filled = faqs.isNotNull() & ~_is(faqs, "VOID") & ~F.coalesce(F.to_json(faqs).isin('""', "[]", "{}", "0", "false"), F.lit(False))
    whole = _errors(d, keys, "description", [missing, mail, F.when(_is(told, "OBJECT") & filled & ~_is(faqs, "ARRAY"), F.lit("FAQs must be a list"))])
    item = _items(d, keys, faqs, F.lit("FAQ "))
    both = _at(F.col("v"), "$.question").isNotNull() & _at(F.col("v"), "$.answer").isNotNull()
    shape = F.when(~_is(F.col("v"), "OBJECT"), F.concat("at", F.lit(" must be a dictionary"))).when(~both, F.concat("at", F.lit(" must have 'question' and 'answer' fields")))
    return whole.unionByName(_errors(item, keys, "description", [shape]))


def node3(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """A JSON text with configurations, each with its three required sections."""
    d = df.select(*keys, F.try_parse_json(document).alias("doc"))
    told = _at(F.col("doc"), "$.configurations")
    whole = _errors(d, keys, "configurations", [F.when(told.isNull(), "Missing 'configurations' section").when(~_is(told, "ARRAY"), "Configurations must be a list")])
    item = _items(d, keys, told, F.lit("Configuration "))
    shape = F.when(~_is(F.col("v"), "OBJECT"), F.concat("at", F.lit(" must be a dictionary")))
    lacks = [F.when(_is(F.col("v"), "OBJECT") & _at(F.col("v"), f"$['{x}']").isNull(), F.concat("at", F.lit(f" missing '{x}' section"))) for x in ("Basic", "Source Details", "Pricing")]
    return whole.unionByName(_errors(item, keys, "configurations", [shape, *lacks]))


def node4(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """A JSON text with what holds for the property, and the types of the tenancy options of each configuration."""
    d = df.select(*keys, F.try_parse_json(document).alias("doc"))
    level, told = _at(F.col("doc"), "$.property_level"), _at(F.col("doc"), "$.configurations")
    whole = [F.when(level.isNotNull() & ~_is(level, "OBJECT"), "Property level data must be a dictionary"), F.when(told.isNotNull() & ~_is(told, "ARRAY"), "Configurations must be a list")]
    item = _items(d, keys, told, F.lit("Configuration "))
    options = _at(F.col("v"), "$.tenancy_options")
    shape = F.when(~_is(F.col("v"), "OBJECT"), F.concat("at", F.lit(" must be a dictionary"))).when(options.isNotNull() & ~_is(options, "ARRAY"), F.concat("at", F.lit(" tenancy_options must be a list")))
    option = _items(item, keys, options, F.concat("at", F.lit(" tenancy_options["))).withColumn("at", F.concat("at", F.lit("]")))
    weeks = _at(F.col("v"), "$.tenancy_length_weeks")
    found = [F.when(~_is(F.col("v"), "OBJECT"), F.concat("at", F.lit(" must be a dictionary"))), F.when(weeks.isNotNull() & ~_is(weeks, "BIGINT", "BOOLEAN"), F.concat("at", F.lit(".tenancy_length_weeks must be int")))]
    for x in ("price_per_week", "price_total"):
        price = _at(F.col("v"), f"$.{x}")
        found.append(F.when(price.isNotNull() & ~_is(price, "BIGINT", "BOOLEAN", "DECIMAL", "DOUBLE", "FLOAT"), F.concat("at", F.lit(f".{x} must be number"))))
    return _errors(d, keys, "tenancy", whole).unionByName(_errors(item, keys, "tenancy", [shape])).unionByName(_errors(option, keys, "tenancy", found))
