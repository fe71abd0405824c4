"""Hints drawn from all pages of a site: the first page that tells something wins. Policies and questions in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import any_of, key, strip

# a word begins or ends here, in letters of any script
BEGIN, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
# What tells a postcode, a city and a street, a mail address, and the classes of guarantor wording.
POSTCODE = BEGIN + r"([A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})" + END
CITY = BEGIN + r"(?:in|at|near)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)" + END
STREET = BEGIN + r"([0-9]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|Road|Avenue|Lane|Drive|Close|Way))" + END
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
GUARANTOR = (
    (r"guarantor\s+(?:is\s+)?(?:required|needed|mandatory)", "guarantor_required"),
    (r"(?:no|not\s+required)\s+guarantor", "no_guarantor"),
    (r"guarantor\s+(?:not\s+)?(?:required|needed)", "guarantor_optional"),
    (r"international\s+guarantor", "international_guarantor"),
    (r"local\s+guarantor\s+only", "local_guarantor_only"),
    (r"third\s+party\s+guarantor\s+service", "third_party_guarantor"),
    (r"parent.*signature.*required", "parent_signature_required"),
    (r"co.?signer", "co_signer_required"),
)
# Wording of cancellation policies and the key of each; words of policy texts; all twelve keys.
POLICIES = (
    (r"cooling\s*off", "cooling_off_period"),
    (r"no\s*visa\s*no\s*pay|visa\s*(rejected|refused)", "no_visa_no_pay"),
    (r"no\s*place\s*no\s*pay", "no_place_no_pay"),
    (r"course\s*(cancel|change|modif)", "university_course_cancellation_or_modification"),
    (r"early\s*(termination|release|surrender)", "early_termination_by_student"),
    (r"delayed\s*arrivals|travel\s*restriction|quarantine", "delayed_arrivals_or_travel_restrictions"),
    (r"replacement\s*tenant|re[- ]?let|reassign", "replacement_tenant_found"),
    (r"defer|deferral|postpone", "deferring_studies"),
    (r"intake\s*delayed|semester\s*delayed|term\s*delayed", "university_intake_delayed"),
    (r"no\s*questions\s*asked", "no_questions_asked"),
    (r"extenuating\s*circumstances|exceptional\s*circumstances|medical\s*reason", "extenuating_circumstances"),
)
PLACE = r"lat(?:itude)?\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)\s*[,;]\s*(?:lng|lon|longitude)\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)"
POLICY_WORDS = ("policy", "policies", "term", "rule", "cancellation", "refund")
# Words of which each pattern needs one: texts without them are told apart before a pattern runs.
NEEDED = {
    "cooling_off_period": ("cooling",), "no_visa_no_pay": ("visa",), "no_place_no_pay": ("place",), "university_course_cancellation_or_modification": ("course",), "early_termination_by_student": ("early",),
    "delayed_arrivals_or_travel_restrictions": ("delayed", "travel", "quarantine"), "replacement_tenant_found": ("tenant", "let", "reassign"), "deferring_studies": ("defer", "postpone"),
    "university_intake_delayed": ("delayed",), "no_questions_asked": ("questions",), "extenuating_circumstances": ("circumstances", "medical"),
}
POLICY_KEYS = (*(k for _, k in POLICIES), "other_policies")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_by(df: DataFrame, site: str, order: str, values: dict[str, Column]) -> DataFrame:
    """For each site and key the value of its first page (by ``order``) that has one."""
    d = df.select(site, order, *(v.alias(k) for k, v in values.items()))
    return d.groupBy(site).agg(*(F.min_by(k, F.when(F.col(k).isNotNull(), F.col(order))).alias(k) for k in values))


def longest(df: DataFrame, site: str, name: str, order: str) -> DataFrame:
    """The longest name of each site, the first of several."""
    return df.groupBy(site).agg(F.max_by(name, F.struct(F.length(name), -F.col(order))).alias(name))


def coordinates(df: DataFrame, site: str) -> DataFrame:
    """The first valid pair of each site, by source, page and place (columns source_rank, page_id, seq, lat, lng as text)."""
    lat, lng = F.col("lat").try_cast("double"), F.col("lng").try_cast("double")
    ok = df.filter(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng))
    return ok.groupBy(site).agg(F.min_by(F.struct("lat", "lng"), F.struct("source_rank", "page_id", "seq")).alias("p")).select(site, "p.*")


def linked_data(fragments: DataFrame) -> DataFrame:
    """page_id, seq and doc (a variant) of the JSON-LD fragments that parse; lists give each of their items."""
    d = fragments.filter("kind = 'jsonld'").select("page_id", "seq", F.try_parse_json("body").alias("v")).filter("v IS NOT NULL")
    many = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return d.select("page_id", "seq", F.explode(many).alias("doc"))


def linked_names(data: DataFrame) -> DataFrame:
    """page_id, seq and name of what has a name."""
    text = lambda path: F.nullif(strip(F.try_variant_get("doc", path, "string")), F.lit(""))
    return data.select("page_id", "seq", F.coalesce(text("$.name"), text("$['@name']")).alias("name")).filter("name IS NOT NULL")


def places(fragments: DataFrame, data: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, seq, source_rank, lat, lng: from map scripts and data attributes, then JSON-LD, then ``texts`` (page_id, text)."""
    of = lambda *keys: F.coalesce(*(F.col("attrs")[k] for k in keys))
    marks = fragments.filter(F.col("kind").isin("coords", "data_coords")).select("page_id", "seq", F.lit(0).alias("source_rank"), of("lat", "data-lat").alias("lat"), of("lng", "data-lng").alias("lng"))
    geo = lambda k: F.try_variant_get("doc", f"$.geo.{k}", "string").alias({"latitude": "lat", "longitude": "lng"}[k])
    linked = data.select("page_id", "seq", F.lit(1).alias("source_rank"), geo("latitude"), geo("longitude"))
    first = F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(PLACE), 0), 1, 1)).alias("m")
    part = lambda i: F.regexp_extract("m", PLACE, i)
    free = texts.select("page_id", first).select("page_id", F.lit(0).alias("seq"), F.lit(2).alias("source_rank"), part(1).alias("lat"), part(2).alias("lng"))
    return marks.unionByName(linked).unionByName(free).filter("lat IS NOT NULL AND lng IS NOT NULL")


def amenities(data: DataFrame) -> DataFrame:
    """page_id, seq, i and name of the amenity features in JSON-LD, objects with a name or plain texts."""
    items = F.posexplode(F.try_variant_get("doc", "$.amenityFeature", "array<variant>")).alias("i", "f")
    name = F.coalesce(F.try_variant_get("f", "$.name", "string"), F.when(F.schema_of_variant("f") == "STRING", F.try_variant_get("f", "$", "string")))
    return data.select("page_id", "seq", items).select("page_id", "seq", "i", strip(name).alias("name")).filter("name <> ''")


def definitions(df: DataFrame, site: str, order: str, text: str) -> DataFrame:
    """key and value of lines "key: value": in a page the last line of a key, among pages the first page."""
    lines = df.select(site, order, F.posexplode(F.split(text, "\n")).alias("line", "l")).filter(F.col("l").contains(":"))
    parts = lines.withColumn("k", key(F.split("l", ":", 2)[0])).withColumn("v", strip(F.split("l", ":", 2)[1])).filter("k <> '' AND v <> ''")
    in_page = parts.groupBy(site, "k", order).agg(F.max_by("v", "line").alias("v"))
    return in_page.groupBy(site, "k").agg(F.min_by("v", order).alias("v"))


def guarantor_class(text: Column) -> Column:
    t, out = F.lower(text), F.when(F.lower(text).contains("guarantor"), "guarantor_mentioned")
    for pattern, name in reversed(GUARANTOR):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def is_policy(text: Column) -> Column:
    return any_of(F.lower(text), POLICY_WORDS)


def policy_snippets(text: Column, low: Column) -> list[tuple[str, Column]]:
    """For each policy key the words around its first mention: 120 signs before it and 240 after, or null. ``low``: the text in
    small letters."""
    out = []
    for pattern, name in POLICIES:
        at = F.regexp_instr(low, F.lit(pattern))
        n = F.length(F.regexp_extract(low, pattern, 0))
        start = F.greatest(F.lit(1), at - 120)
        out.append((name, F.when(any_of(low, NEEDED[name]), F.when(at > 0, strip(F.substring(text, start, at + n + 240 - start))))))
    return out


def policies(df: DataFrame, keys: list[str], text: str, existing: str | None = None) -> DataFrame:
    """(key, value) rows for all twelve policy keys of each text; what exists stays, what is not told is empty."""
    old = F.col(existing) if existing else F.create_map().cast("map<string,string>")
    d = df.select(*keys, F.col(text).alias("__text"), F.lower(text).alias("__low"), old.alias("old"))
    told = F.create_map(*(x for k, v in policy_snippets(F.col("__text"), F.col("__low")) for x in (F.lit(k), v)))
    # a generator runs before what is selected beside it: the snippets are worked out below it, once a text
    rows = d.select(*keys, told.alias("told"), "old").select(*keys, "told", "old", F.explode(F.array(*map(F.lit, POLICY_KEYS))).alias("key"))
    kept = F.nullif(F.try_element_at("old", F.col("key")), F.lit(""))
    return rows.select(*keys, "key", F.coalesce(kept, F.try_element_at("told", F.col("key")), F.lit("")).alias("value"))


def question_pairs(lines: DataFrame, scope: list[str], order: str, text: str) -> DataFrame:
    """Questions ("Q: …" or a line ending in a question mark) with the lines that follow up to the next one."""
    low = F.lower(strip(F.col(text)))
    asks = low.startswith("q:") | (low.endswith("?") & ~low.startswith("a:"))
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumn("__q", asks).withColumn("pair", F.sum(F.col("__q").cast("int")).over(w)).filter("pair > 0")
    bare = strip(F.regexp_replace(F.col(text), r"^\s*[QqAa]:", ""))
    g = d.groupBy(*scope, "pair").agg(F.min_by(bare, F.when(F.col("__q"), F.col(order))).alias("question"), F.min_by(bare, F.when(~F.col("__q") & (strip(F.col(text)) != ""), F.col(order))).alias("answer"))
    return g.filter("question <> '' AND answer <> ''")


def turn_pairs(turns: DataFrame, scope: str, order: str, role: str, text: str) -> DataFrame:
    """User turns with the assistant turn that follows directly."""
    w = Window.partitionBy(scope).orderBy(order)
    d = turns.withColumn("answer", F.lead(text).over(w)).withColumn("__r", F.lead(role).over(w))
    return d.filter((F.col(role) == "user") & (F.col("__r") == "assistant")).select(scope, F.col(order), F.col(text).alias("question"), "answer")


def distinct_pairs(pairs: DataFrame, scope: list[str], order: list) -> DataFrame:
    """Each pair of a scope once, whatever its case."""
    w = Window.partitionBy(*scope, F.lower("question"), F.lower("answer")).orderBy(*order)
    return pairs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def enriched(records: DataFrame, pairs: DataFrame, key: str, present: str, least: int = 2) -> DataFrame:
    """key and faqs: a record's ``present`` questions (an array of question, answer), and where these are fewer than ``least`` also
    those of ``pairs`` (key, place, question, answer) that it hasn't yet, whatever their case."""
    few = records.filter(F.size(F.coalesce(present, F.array())) < least)
    had = few.select(key, F.posexplode(present).alias("place", "f")).select(key, F.lit(0).alias("rank"), "place", "f.question", "f.answer")
    new = pairs.join(few.select(key), key).select(key, F.lit(1).alias("rank"), "place", "question", "answer")
    once = distinct_pairs(had.unionByName(new), [key], ["rank", "place"])
    more = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "place", "question", "answer"))).alias("x"))
    more = more.select(key, F.transform("x", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("__more"))
    return records.join(more, key, "left").select(key, F.coalesce("__more", present).alias("faqs"))


def blocks(fragments: DataFrame, kinds: tuple[str, ...], key: str = "page_id") -> DataFrame:
    """key, kind and the bodies of a page's fragments of these kinds, in order: what marked blocks of a text would hold."""
    g = fragments.filter(F.col("kind").isin(*kinds)).groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("x"))
    return g.select(key, "kind", F.transform("x", lambda x: x["body"]).alias("bodies"))


def sparseness(*conditions: Column) -> Column:
    """Points of a description, one for each condition that holds."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))
