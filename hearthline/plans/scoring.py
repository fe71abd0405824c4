"""Queries of scores (Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import score as S
from .registry import query
from .tables import Tables

DOC = "struct<basic_info:struct<name:string,guarantor_required:string,property_type:string,contact:struct<phone:string>>,location:struct<location_name:string,latitude:string,longitude:string,city:string,region:string,postcode:string>,features:array<string>>"


def node1(t: Tables) -> DataFrame:
    """property_id and doc: a nested node-1 record of each listing, with gaps by rule."""
    k = F.col("property_id")
    names = t.feature.groupBy("property_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    contact = F.struct(F.when(k % 2 == 0, F.concat(F.lit("+44"), k.cast("string"))).alias("phone"))
    basic = F.struct("name", F.when(k % 4 == 0, "").when(k % 4 == 1, "Information unavailable").otherwise("No guarantor required").alias("guarantor_required"), F.when(k % 5 > 0, "Studio").alias("property_type"), contact.alias("contact"))
    at = F.struct(F.col("city").alias("location_name"), F.when(k % 3 == 0, F.lit(None)).otherwise("51.5").alias("latitude"), F.when(k % 3 == 0, F.lit(None)).otherwise("0").alias("longitude"), "city", "region", F.lit(" ").alias("postcode"))
    return t.listing.join(names, "property_id", "left").select("property_id", F.struct(basic.alias("basic_info"), at.alias("location"), F.col("names").alias("features")).cast(DOC).alias("doc"))


NODE1 = """
, f AS (SELECT property_id, count(DISTINCT name) AS n FROM feature GROUP BY 1),
n1 AS (SELECT l.property_id AS k, coalesce(n, 0) AS n, n IS NOT NULL AS has_features FROM listing l LEFT JOIN f USING (property_id)),
s AS (SELECT k, n, (k % 4 > 0)::INT AS g, (k % 4 > 1)::INT AS g_known, (k % 5 > 0)::INT AS p, (k % 2 = 0)::INT AS ph, (k % 3 > 0)::INT AS co, has_features::INT AS fe FROM n1),
-- keys: 3 sections, 4 + 1 of basic_info, 6 of location, and the features
q AS (SELECT *, 14 + n AS total, 2 + fe + (1 + g + p + 1 + ph) + (1 + 2 * co + 1 + 1) + n AS filled, 1 + g + p + ph + 3 + 2 * co + n AS leaves FROM s)
"""


def _schema(t: Tables) -> tuple:
    d = node1(t)
    return d, d.schema["doc"].dataType


@query("q1_completeness", NODE1 + "SELECT k AS property_id, total, filled, filled / total AS completeness FROM q")
def q1(t: Tables) -> DataFrame:
    d, kind = _schema(t)
    total, filled = S.counts(F.col("doc"), kind)
    return d.select("property_id", total.cast("long").alias("total"), filled.cast("long").alias("filled"), S.completeness(F.col("doc"), kind).alias("completeness"))


PRESENT = {
    "basic_info": "1", "basic_info.name": "1", "basic_info.guarantor_required": "g", "basic_info.property_type": "p", "basic_info.contact": "1", "basic_info.contact.phone": "ph", "location": "1", "location.location_name": "1",
    "location.latitude": "co", "location.longitude": "co", "location.city": "1", "location.region": "1", "location.postcode": "0", "features": "fe",
}


@query("q2_presence", NODE1 + f"""
SELECT k AS property_id, unnest({list(PRESENT)}) AS path, unnest([{', '.join(PRESENT.values())}]) AS present FROM q""")
def q2(t: Tables) -> DataFrame:
    d, kind = _schema(t)
    return d.select("property_id", F.explode(F.array(*S.presence(F.col("doc"), kind))).alias("x")).select("property_id", "x.*")


# documents of five shapes around the properties of an event; the last is no JSON
SHAPES = (
    "{p}", '{"a":{"b":{"c":{"d":{"e":{"f":{p},"g":[]}}},"h":" "}}}', '[[1,[null,""," x",[{p}]]],[],{},{p},false]',
    '{"list":[{p},{"x":[]},"",0,false,true,2.5],"empty":{},"name":"\u00e9 ","none":null}', "{p",
)


def mixed(t: Tables) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    return t.read("events").select("event_id", F.replace(text, F.lit("{p}"), F.col("props")).alias("doc"))


MIXED = f"""
, docs AS (SELECT event_id, replace(({list(SHAPES)})[(event_id % {len(SHAPES)} + 1)::INT], '{{p}}', props) AS doc FROM events),
tree AS (SELECT event_id, x.key, x.type, x.id, x.parent, x.atom ->> '$' AS plain, x.fullkey FROM (SELECT * FROM docs WHERE json_valid(doc)) d, json_tree(d.doc) x),
nodes AS (SELECT c.event_id, CASE WHEN c.fullkey LIKE '$.%' THEN substr(c.fullkey, 3) ELSE substr(c.fullkey, 2) END AS path, c.type IN ('OBJECT', 'ARRAY') AS many,
  p.type = 'OBJECT' OR NOT many AS counted, many OR coalesce(c.type <> 'NULL' AND trim(c.plain) <> '', false) AS there, c.type = 'VARCHAR' OR (c.type = 'BOOLEAN' AND c.plain = 'true') OR coalesce(try_cast(c.plain AS DOUBLE) <> 0, false) AS weighs
  FROM tree c JOIN tree p ON p.event_id = c.event_id AND p.id = c.parent)
"""


@query("q1_any_document", MIXED + """
SELECT event_id, count(path) FILTER (counted) AS total, count(path) FILTER (counted AND there) AS filled, count(path) FILTER (NOT many AND there AND weighs) AS leaves,
  CASE WHEN count(path) FILTER (counted) > 0 THEN count(path) FILTER (counted AND there) / count(path) FILTER (counted) ELSE 0 END AS completeness FROM docs LEFT JOIN nodes USING (event_id) GROUP BY 1""")
def q1_any(t: Tables) -> DataFrame:
    """Completeness and non-empty leaves (q4) of documents without a common schema."""
    return D.scores(mixed(t), "event_id", "doc")


@query("q2_any_presence", MIXED + "SELECT event_id, path, max(there::INT) AS present FROM nodes WHERE counted GROUP BY 1, 2")
def q2_any(t: Tables) -> DataFrame:
    return D.presence(mixed(t), "event_id", "doc")


@query("q3_confidence_node1", NODE1 + """
, b AS (SELECT k AS property_id, (1 + .8 * g + .6 * p + .5 * ph + 1 + 1.8 * co + .8 + .8 + .6 + .7 * fe) / 10.9 AS base,
  (2 * co + 3) / 7.0 * .15 + .05 * g_known + .03 * p + .02 * ph + least(.05, n * .01) AS bonus, least(.1, leaves * .005) AS rich FROM q)
SELECT property_id, base::DOUBLE AS base, bonus::DOUBLE AS bonus, least(1, base + bonus + rich)::DOUBLE AS confidence FROM b""".replace("10.9", str(round(sum(S.NODE1_WEIGHTS.values()), 6))))
def q3(t: Tables) -> DataFrame:
    d, kind = _schema(t)
    doc = F.col("doc")
    base, bonus = S.weighted_presence(doc, kind, S.NODE1_WEIGHTS), S.node1_bonus(doc, kind)
    return d.select("property_id", base.alias("base"), bonus.alias("bonus"), S.confidence(base, bonus, S.richness(doc, kind)).alias("confidence"))


@query("q3b_confidence_node3", """
, c AS (SELECT property_id, count(*) AS n, avg(.2 + .2 * (price > 0)::INT + .1 * (area > 5)::INT + .1 + least(1, options / 3.0) * .1) AS detail FROM configuration GROUP BY 1)
SELECT property_id, least(1, 1 + (least(.1, n * .02) + detail * .1))::DOUBLE AS confidence, (least(.1, n * .02) + detail * .1)::DOUBLE AS bonus FROM c""")
def q3b(t: Tables) -> DataFrame:
    detail = S.configuration_detail(F.col("config_name") != "", F.col("price") > 0, F.col("area") > 5, F.col("unit_type") != "", F.col("options"))
    c = t.configuration.groupBy("property_id").agg(F.count(F.lit(1)).alias("n"), F.avg(detail).alias("detail"))
    bonus = S.node3_bonus(F.col("n"), F.col("detail"))
    return c.select("property_id", S.confidence(F.lit(1.0), bonus, F.lit(0.0)).alias("confidence"), bonus.alias("bonus"))


@query("q3c_confidence_node4", """
, o AS (SELECT property_id, config_name, count(*) AS n, avg(.5 + .3 * (l_linestatus = 'F')::INT + .2 * (l_returnflag <> 'R')::INT) AS detail FROM tenancy GROUP BY ALL)
SELECT property_id, least(.2, avg(least(1, n / 3.0) * .5 + detail * .5))::DOUBLE AS bonus FROM o GROUP BY 1""")
def q3c(t: Tables) -> DataFrame:
    detail = S.option_detail(F.col("price_text") != "", F.col("l_linestatus") == "F", F.col("l_returnflag") != "R")
    o = t.tenancy.groupBy("property_id", "config_name").agg(F.count(F.lit(1)).alias("n"), F.avg(detail).alias("detail"))
    return o.groupBy("property_id").agg(F.least(F.lit(0.2), F.avg(S.tenancy_richness(F.col("n"), F.col("detail")))).alias("bonus"))


@query("q4_non_empty", NODE1 + "SELECT k AS property_id, leaves AS n, least(.1, leaves * .005)::DOUBLE AS richness FROM q")
def q4(t: Tables) -> DataFrame:
    d, kind = _schema(t)
    return d.select("property_id", S.non_empty(F.col("doc"), kind).cast("long").alias("n"), S.richness(F.col("doc"), kind).alias("richness"))


@query("q5_merge_quality", """
, j AS (SELECT job_id, count(DISTINCT node) AS nodes, avg((status = 'completed')::INT) AS complete FROM node GROUP BY 1)
SELECT job_id, complete * .4 + nodes / 4 * .3 + .27 AS quality FROM j""")
def q5(t: Tables) -> DataFrame:
    j = t.node.groupBy("job_id").agg(F.count_distinct("node").alias("nodes"), F.avg((F.col("status") == "completed").cast("int")).alias("complete"))
    return j.select("job_id", S.merge_quality(F.col("complete"), F.col("nodes")).alias("quality"))


@query("q6_job_quality", """
, j AS (SELECT job_id, avg(confidence) AS c, avg((status = 'completed')::INT) AS complete FROM node GROUP BY 1)
SELECT job_id, greatest(0, least(1, c * .7 + complete * .3)) AS quality FROM j""")
def q6(t: Tables) -> DataFrame:
    j = t.node.groupBy("job_id").agg(F.avg("confidence").alias("c"), F.avg((F.col("status") == "completed").cast("int")).alias("complete"))
    return j.select("job_id", S.job_quality(F.col("c"), F.col("complete")).alias("quality"))


@query("q7_configuration_quality", "SELECT property_id, config_name, (.2 + .2 * (price > 1000)::INT + .3 * (options > 1)::INT + .2 * (area > 10)::INT + .1 * (unit_type LIKE 'P%')::INT)::DOUBLE AS quality FROM configuration")
def q7(t: Tables) -> DataFrame:
    q = S.configuration_quality(F.col("config_name") != "", F.col("price") > 1000, F.col("options") > 1, F.col("area") > 10, F.col("unit_type").startswith("P"))
    return t.configuration.select("property_id", "config_name", q.alias("quality"))


MESSAGES = ("Request timed out", "HTTP 429 from service", "Connection reset", "JSON parse error", "Invalid value", "boom")


@query("q8_error_category", "SELECT event_id, ['timeout', 'rate_limit', 'network', 'parsing', 'validation', 'unknown'][event_id % 6 + 1] AS category FROM events WHERE event_type = 'error'")
def q8(t: Tables) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 6 + 1).cast("int"))
    return t.read("events").filter("event_type = 'error'").select("event_id", S.error_category(message).alias("category"))


@query("q9_counts", "SELECT property_id, count(DISTINCT config_name) AS configurations, count(*) AS tenancies FROM tenancy GROUP BY 1")
def q9(t: Tables) -> DataFrame:
    return t.configuration.groupBy("property_id").agg(F.count(F.lit(1)).alias("configurations"), F.sum("options").alias("tenancies"))
