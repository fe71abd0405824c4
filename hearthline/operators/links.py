"""Addresses, links and the link graph of stored pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import any_of, title_case
from ..sources.snapshot import written

# Words that make a link worth following, with their weights; on the path in full, on the anchor by half.
CONFIGURATION_WORDS = {
    "room": 8, "studio": 8, "apartment": 8, "flat": 8, "accommodation": 8, "ensuite": 9, "en-suite": 9, "bedroom": 8, "bathroom": 7, "kitchen": 6, "configuration": 10, "config": 9, "option": 8, "variant": 8, "type": 7,
    "detail": 8, "specification": 8, "spec": 7, "info": 6, "information": 6, r"floor\s*plan": 9, "layout": 8, "diagram": 7, "gallery": 6, "photo": 5, "premium": 7, "deluxe": 7, "standard": 6, "basic": 5, "economy": 5,
}
TENANCY_WORDS = {
    "tenancy": 10, "contract": 10, "lease": 10, "duration": 9, "agreement": 8, "booking": 8, "reservation": 8, "availability": 7, "price": 9, "pricing": 9, "cost": 8, "fee": 8, "rent": 9, "deposit": 8, "weekly": 8, "monthly": 7,
    r"per\s*week": 8, r"per\s*month": 7, "pw": 8, "pm": 7, "start": 7, "end": 7, "date": 6, "move": 6, "arrival": 6, "departure": 6, "semester": 8, r"academic\s*year": 8, "term": 7, "session": 6, "guarantor": 8, "guarantee": 7,
    "reference": 6, "requirement": 6, "cancellation": 7, "refund": 7, "modification": 6, "transfer": 6, "offer": 6, "deal": 6, "promotion": 6, "discount": 6, "incentive": 6,
}
WEIGHTS = {**CONFIGURATION_WORDS, **TENANCY_WORDS}
# Pairs of word groups that together on a path add a bonus.
PAIRED_WORDS = (
    (("room", "studio", "apartment", "ensuite"), ("detail", "info", "spec", "configuration"), 8),
    (("price", "cost", "fee", "rent"), ("tenancy", "contract", "lease", "booking"), 8),
    (("semester", "academic", "term"), ("tenancy", "contract", "booking", "availability"), 6),
    (("premium", "deluxe", "standard", "basic", "economy"), ("room", "studio", "apartment"), 6),
    (("weekly", "monthly", "pw", "pm"), ("price", "cost", "rent", "fee"), 6),
)
# Patterns by node of which a link's address or anchor must match one.
ALLOWED = {
    1: ("about", "contact", "location", "address", "map", "facility", "facilities", "amenity", "amenities", "feature", "policy", "rule", "safety", "security"),
    2: ("about", "faq", "policy", "policies", "terms", "cancellation", "refund", "payment", "deposit", "guarantor", "commute", "transport", "nearby", "distance", "area"),
    3: ("room", "studio", "ensuite", "en-suite", "apartment", "flat", "accommodation", "unit", "suite", "residence", "price", "pricing", "floor", "area", "layout", "detail", "feature"),
    4: ("tenancy", "contract", "lease", "term", "duration", "booking", "availability", "price", "pricing", "cost", "fee", "rent", "deposit", "semester", r"academic\s*year", "offer"),
}
# Crawl budget by node: depth, links a page, pages, signs of context.
BUDGETS = {1: (1, 10, 20, 120000), 2: (1, 10, 20, 120000), 3: (2, 15, 40, 120000), 4: (2, 15, 40, 120000)}
# Display names of known hosts.
HOST_NAMES = {
    "homesforstudents.com": "Homes for Students", "iqstudentaccommodation.com": "iQ Student Accommodation", "unite-students.com": "Unite Students", "freshstudentliving.com": "Fresh Student Living", "studentroost.co.uk": "Student Roost",
    "chapter-living.com": "Chapter Living", "downtownstudentliving.com": "Downtown Student Living", "amberstudent.com": "Amber Student", "studentuniverse.com": "Student Universe", "accommodationforstudents.com": "Accommodation for Students",
}

# a link: its address in double, single or no quotes, and what stands in it
ANCHOR = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""


# where a page says that its references start
BASE = r"""(?is)<base\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def normalize_url(c: Column) -> Column:
    """Without query, fragment and one trailing slash, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/$", ""))


def host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def same_domain(base: Column, target: Column) -> Column:
    """A target without a host is on the base's."""
    return F.coalesce(F.nullif(host(target), F.lit("")), host(base)) == host(base)


def allowed_domain(base: Column, target: Column, extra: list[str]) -> Column:
    """On the base's host, or on or below one of ``extra`` (a short list, so no join)."""
    h = F.lower(host(target))
    return reduce(lambda a, d: a | (h == d) | h.endswith("." + d), [x.lower() for x in extra], same_domain(base, target))


# the parts of an address or a reference: scheme, host with //, path, query with ?, fragment with #
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` at the root goes."""
    segments = F.split(p, "/")
    rest = F.slice(segments, F.when(p.startswith("/"), 2).otherwise(1), F.size(segments))
    fold = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(rest, F.array().cast("array<string>"), fold)
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p == "", p).otherwise(F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(kept, "/")))


def join_url(base: Column, href: Column) -> Column:
    """The address that a reference means on a page, as RFC 3986 resolves it (5.2.2, strictly)."""
    of = lambda c, i: F.regexp_extract(c, PARTS, i)
    scheme, host_, path_, query, fragment = (of(href, i) for i in range(1, 6))
    folder = F.when((of(base, 2) != "") & (of(base, 3) == ""), "/").otherwise(F.regexp_replace(of(base, 3), r"[^/]*\z", ""))
    start = F.concat(of(base, 1), F.lit(":"))
    merged = without_dots(F.when(path_.startswith("/"), path_).otherwise(F.concat(folder, path_)))
    return (
        F.when(scheme != "", F.concat(scheme, F.lit(":"), host_, F.when(path_.startswith("/"), without_dots(path_)).otherwise(path_), query, fragment)).when(host_ != "", F.concat(start, host_, without_dots(path_), query, fragment))
        .when(path_ != "", F.concat(start, of(base, 2), merged, query, fragment)).otherwise(F.concat(start, of(base, 2), of(base, 3), F.when(query != "", query).otherwise(of(base, 4)), fragment))
    )


def unescaped(c: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, anchor and target of every link, in order of the page; tags within a link are left out."""
    group = lambda i: F.regexp_extract("m", ANCHOR, i)
    base = unescaped(F.concat(*(F.regexp_extract("html", BASE, i) for i in (1, 2, 3))))
    pages = pages.withColumn("base", F.when(base == "", F.col("url")).otherwise(join_url(F.col("url"), base)))
    rows = pages.select("page_id", "url", "base", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), 0)).alias("pos", "m"))
    text = F.trim(F.regexp_replace(F.regexp_replace(group(4), "<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("page_id", "url", "base", "pos", unescaped(F.concat(group(1), group(2), group(3))).alias("href"), unescaped(text).alias("anchor"))
    return rows.withColumn("target", join_url(F.col("base"), F.col("href"))).drop("base")


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(patterns))


def _weight(text: Column, words: dict[str, int], halves: bool) -> Column:
    """Weights of the words in a text, each once: single words by its list of words, the others by pattern."""
    n = {w: v // 2 if halves else v for w, v in words.items()}
    single = {w: v for w, v in n.items() if w.isalpha()}
    known = F.create_map(*(F.lit(x) for p in single.items() for x in p))
    told = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1))
    total = F.aggregate(told, F.lit(0), lambda s, w: s + F.coalesce(F.try_element_at(known, w), F.lit(0)))
    return reduce(lambda x, y: x + y, (F.when(text.rlike(rf"\b{w}\b"), v).otherwise(0) for w, v in n.items() if w not in single), total)


def score(url: Column, anchor: Column, patterns: tuple[str, ...]) -> Column:
    """One expression: word weights, pattern hits, depth and paired words."""
    p, a = F.lower(path(url)), F.lower(F.coalesce(anchor, F.lit("")))
    hit = lambda cond, n: F.when(cond, n).otherwise(0)
    parts = [_weight(p, WEIGHTS, False), _weight(a, WEIGHTS, True)]
    for w in patterns:
        parts += [hit(F.lower(url).rlike(w), 4), hit(a.rlike(w), 3)]
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    parts.append(F.when(depth.between(1, 3), 4).when(depth > 3, -F.least(depth - 3, F.lit(4))).otherwise(0))
    parts += [hit(any_of(p, one) & any_of(p, other), n) for one, other, n in PAIRED_WORDS]
    return reduce(lambda x, y: x + y, parts)


def best_links(links: DataFrame, k: int) -> DataFrame:
    """Each target of a page once (its first link), the ``k`` highest scores, earlier links first on a tie."""
    once = links.groupBy("page_id", "target").agg(F.min_by(F.struct("pos", "anchor", "score"), "pos").alias("l")).select("page_id", "target", "l.*")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return once.withColumn("rank", n).filter(F.col("rank") <= k)


def frontier(links: DataFrame, seeds: DataFrame, depth: int, pages: int, links_a_page: int) -> DataFrame:
    """site, url and level of what a crawl visits: from ``seeds`` (site, url) over ``links`` (src, dst, score, pos), level by level, up to
    ``depth`` steps, ``links_a_page`` links of a page (the highest scores, earlier ones first) and ``pages`` pages of each site.

    A page goes to the first level that reaches it; where a level has more than the site has left, its best links go first (by
    score, then address). They are chosen in two steps, first among parts of a site. Each level is written to the shared folder, so
    none is computed twice."""
    order = [F.desc("score"), F.asc("url")]

    def best(d: DataFrame) -> DataFrame:
        d = d.withColumn("__part", F.pmod(F.xxhash64("url"), F.lit(32))).withColumn("__n", F.row_number().over(Window.partitionBy("site", "__part").orderBy(*order))).filter(F.col("__n") <= F.col("room"))
        return d.withColumn("__n", F.row_number().over(Window.partitionBy("site").orderBy(*order))).filter(F.col("__n") <= F.col("room")).drop("__part", "__n")

    each = links.groupBy("src", "dst").agg(F.min_by(F.struct("pos", "score"), "pos").alias("l")).select("src", "dst", "l.*")
    n = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "pos"))
    each = written(each.withColumn("__n", n).filter(F.col("__n") <= links_a_page).select("src", "dst", "score"), "links")
    first = seeds.select("site", "url").distinct().withColumns({"score": F.lit(0), "room": F.lit(pages)})
    seen = new = written(best(first).select("site", "url", F.lit(0).alias("level")), "level")
    for level in range(1, depth + 1):
        reached = new.join(each.withColumnRenamed("src", "url"), "url").groupBy("site", F.col("dst").alias("url")).agg(F.max("score").alias("score"))
        reached = reached.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        room = seen.groupBy("site").agg((F.lit(pages) - F.count(F.lit(1))).cast("int").alias("room"))
        new = written(best(reached.join(room, "site")).select("site", "url", F.lit(level).alias("level")), "level")
        seen = seen.unionByName(new)
    return seen


def first_pages(pages: DataFrame) -> DataFrame:
    """Each normalised address once, as the page with the smallest id."""
    p = pages.withColumn("norm_url", normalize_url(F.col("url")))
    return p.groupBy("norm_url").agg(F.min_by(F.struct(*(c for c in p.columns if c != "norm_url")), "page_id").alias("p")).select("norm_url", "p.*")


def display_name(url: Column) -> Column:
    """The known name of a host, else the host without its ending in title case."""
    h = F.regexp_replace(F.lower(host(url)), r"^www\.", "")
    known = F.create_map(*(F.lit(x) for p in HOST_NAMES.items() for x in p))[h]
    return F.coalesce(known, title_case(F.replace(F.replace(h, F.lit(".com"), F.lit("")), F.lit(".co.uk"), F.lit(""))))
