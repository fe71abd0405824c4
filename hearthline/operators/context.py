"""One text for each site out of its pages, by category and within a budget of signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Categories in order of priority, with the share (1 / n) of the budget that a page may take.
CATEGORIES = {
    "room_config_detail": (1, 5), "tenancy_pricing": (2, 5), "tenancy_academic": (3, 6), "room_config": (4, 6), "tenancy": (5, 7), "pricing": (6, 7),
    "room_visual": (7, 8), "academic": (8, 9), "features": (9, 10), "policies": (10, 12), "general": (99, 15),
}
# Patterns of an address that tell its category; the second group, where there is one, tells the finer one.
RULES = (
    (("room", "studio", "apartment", "flat", "accommodation", "ensuite", "en-suite"), ("detail", "info", "spec", "configuration", "option", "variant"), "room_config_detail", "room_config"),
    (("configuration", "config", "option", "variant", "type", "style"), (), "", "room_config"),
    ((r"floor\s*plan", "layout", "diagram", "gallery", "photo", "view"), (), "", "room_visual"),
    (("tenancy", "contract", "lease", "term", "duration", "agreement"), ("price", "cost", "fee", "rent", "deposit", "rate"), "tenancy_pricing", "tenancy"),
    (("price", "pricing", "cost", "fee", "rent", "deposit"), ("weekly", "monthly", "pw", "pm", r"per\s*week", r"per\s*month"), "tenancy_pricing", "pricing"),
    (("booking", "reservation", "availability", "apply", "enquire"), (), "", "tenancy"),
    (("semester", r"academic\s*year", "term", "session"), ("tenancy", "contract", "booking", "availability"), "tenancy_academic", "academic"),
    (("feature", "amenity", "facility", "furniture", "equipped"), (), "", "features"),
    (("faq", "policy", "policies", "rule", "condition", "requirement"), (), "", "policies"),
)
LEAST_HEADER = 16  # signs of the shortest header: so many pages at most share a budget


def category(url: Column) -> Column:
    u, out = F.lower(url), F.lit("general")
    for words, finer, special, plain in reversed(RULES):
        name = F.when(u.rlike("|".join(finer)), special).otherwise(plain) if finer else F.lit(plain)
        out = F.when(u.rlike("|".join(words)), name).otherwise(out)
    return out


def _table(c: Column, i: int) -> Column:
    return F.create_map(*(F.lit(x) for k, v in CATEGORIES.items() for x in (k, v[i])))[c]


def priority(c: Column) -> Column:
    return _table(c, 0)


def budget(pages: DataFrame, site: str, most: int, url: str = "url", text: str = "text", order: str = "page_id") -> DataFrame:
    """site, order, url and __text (a hash of the text) of the pages that a site's context holds, with category, rank, header and take:
    the signs of their text in it. Works on rows without texts.

    The site's first page leads with up to a quarter of ``most``. As the sum of what pages ask for passes ``most`` for good
    once a page is cut, a running sum decides for all pages at once. A site's pages beyond most / LEAST_HEADER cannot
    fit; they go before the running sum, first within each part of a site, so a site of any size costs bounded sorts."""
    own, room = Window.partitionBy(site), most // LEAST_HEADER
    slim = pages.select(site, order, url, F.xxhash64(text).alias("__text"), F.length(text).alias("__length"))
    d = slim.dropDuplicates([site, order, url, "__text"]).withColumn("category", category(F.col(url)))
    first = slim.groupBy(site).agg(F.min(order).alias("__first"))
    d = d.join(first, site).withColumn("__main", F.col(order) == F.col("__first")).drop("__first")
    place = [F.desc("__main"), priority(F.col("category")), F.col(order), F.col(url), F.col("__text")]
    part = Window.partitionBy(site, F.pmod(F.xxhash64(order), F.lit(64)))
    d = d.withColumn("rank", F.row_number().over(part.orderBy(*place))).filter(F.col("rank") <= room)
    d = d.withColumn("rank", F.row_number().over(own.orderBy(*place))).filter(F.col("rank") <= room)
    label = F.when(F.col("__main"), "MAIN PAGE").otherwise(F.upper("category"))
    d = d.withColumn("header", F.concat(F.lit("\n\n=== "), label, F.lit(": "), F.col(url), F.lit(" ===\n")))
    d = d.withColumn("__want", F.least(F.col("__length"), _asked(F.col("__main"), F.col("category"), most))).withColumn("__h", F.length("header"))
    before = F.coalesce(F.sum(F.col("__h") + F.col("__want")).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("__before", before).filter(F.col("__before") < most)
    take = F.when(F.col("__main"), F.col("__want")).otherwise(F.greatest(F.lit(0), F.least("__want", F.lit(most) - F.col("__before") - F.col("__h"))))
    return d.withColumn("take", take.cast("int")).select(site, order, url, "__text", "category", "rank", "header", "take")


def _asked(main: Column, category_: Column, most: int) -> Column:
    return F.when(main, most // 4).otherwise(F.floor(F.lit(most) / _table(category_, 1)))


def pack(pages: DataFrame, site: str, most: int, url: str = "url", text: str = "text", order: str = "page_id") -> DataFrame:
    """Pages with category, rank, header and take (see ``budget``), and their texts cut to what they may take at most.

    The pages to keep are found without texts; these are cut where they are before they travel to them. Rows equal in site, order,
    address and text are one page."""
    most_taken = F.greatest(F.lit(most // 4), _asked(F.lit(False), category(F.col(url)), most))
    keys = [site, order, url, "__text"]
    cut = pages.withColumn("__text", F.xxhash64(text)).withColumn(text, F.substring(F.col(text), F.lit(1), most_taken.cast("int"))).dropDuplicates(keys)
    return cut.join(budget(pages, site, most, url, text, order), keys).drop("__text")


def context(packed: DataFrame, site: str, text: str = "text") -> DataFrame:
    """The pieces of each site in order, as one text."""
    piece = F.concat("header", F.substring(F.col(text), F.lit(1), F.col("take")))
    return packed.groupBy(site).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))), lambda x: x["piece"]), "").alias("context"))


def highlight(text: Column, phrases: tuple[str, ...]) -> Column:
    """Every phrase and what follows it on the line, up to a stop, marked as important."""
    return F.regexp_replace(text, "((?:" + "|".join(phrases) + r")[^\n.!?]*)", "[IMPORTANT] $1 [/IMPORTANT]")
