"""Queries of validation (V)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate as V
from .registry import query
from .tables import Tables

URL_ERROR = """CASE WHEN u = '' THEN 'URL must be a non-empty string' WHEN NOT regexp_matches(u, '^https?:') THEN 'URL must use HTTP or HTTPS protocol'
 WHEN regexp_extract(u, '^https?://([^/?#]*)', 1) = '' THEN 'URL must have a valid domain' WHEN NOT contains(regexp_extract(u, '^https?://([^/?#]*)', 1), '.') THEN 'URL must have a valid domain with at least one dot' END"""


def spoiled(t: Tables) -> DataFrame:
    """Page addresses, some of them made wrong by rule."""
    u = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("page_id") % 7 == 1, "").when(F.col("page_id") % 7 == 2, "http://localhost/x").when(F.col("page_id") % 7 == 3, "http:///only/path").otherwise(F.col("url"))
    return t.read("pages").select("page_id", u.alias("u"))


SPOILED = ", s AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '^https?', 'ftp') WHEN 1 THEN '' WHEN 2 THEN 'http://localhost/x' WHEN 3 THEN 'http:///only/path' ELSE url END AS u FROM pages)"


@query("v1_url", SPOILED + f" SELECT page_id, {URL_ERROR} AS error FROM s")
def v1(t: Tables) -> DataFrame:
    return spoiled(t).select("page_id", V.url_error(F.col("u")).alias("error"))


def basic(t: Tables) -> DataFrame:
    k = F.col("property_id") % 5
    return t.listing.select(
        "property_id", F.when(k == 1, "").otherwise(F.col("name")).alias("name"), F.when(k == 2, "Perhaps").otherwise("No guarantor required").alias("guarantor_required"),
        F.when(k == 3, F.lit(None)).otherwise(F.col("city")).alias("source"), F.when(k == 4, "nowhere").otherwise("https://a.example/x").alias("source_link"),
    )


BASIC_ERRORS = """
, basic_errors AS (
SELECT property_id, 'basic_info' AS section, CASE property_id % 5 WHEN 1 THEN 'Field ''name'' must be a non-empty string' WHEN 2 THEN 'Invalid guarantor requirement: Perhaps'
  WHEN 3 THEN 'Field ''source'' must be a non-empty string' ELSE 'Invalid source link: URL must use HTTP or HTTPS protocol' END AS error FROM listing WHERE property_id % 5 > 0)
"""
LOCATION_ERRORS = """
, location_errors AS (
SELECT property_id, 'location' AS section, CASE WHEN property_id % 4 = 0 THEN 'Latitude must be a valid number' ELSE 'Latitude must be between -90 and 90' END AS error FROM listing WHERE property_id % 4 = 0 OR abs(balance / 100) > 90
UNION ALL SELECT property_id, 'location', 'Longitude must be between -180 and 180' FROM listing WHERE abs(balance / 30) > 180)
"""


def places(t: Tables) -> DataFrame:
    return t.listing.select("property_id", F.when(F.col("property_id") % 4 == 0, F.when(F.col("property_id") % 8 == 0, "nan").otherwise("north")).otherwise((F.col("balance") / 100).cast("string")).alias("latitude"), (F.col("balance") / 30).alias("longitude"))


@query("v2_basic_info", BASIC_ERRORS + "SELECT * FROM basic_errors")
def v2(t: Tables) -> DataFrame:
    return V.basic_info(basic(t), ["property_id"], name="name", guarantor_required="guarantor_required", source="source", source_link="source_link")


@query("v3_location", LOCATION_ERRORS + "SELECT * FROM location_errors")
def v3(t: Tables) -> DataFrame:
    return V.location(places(t), ["property_id"], "latitude", "longitude")


def with_features(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("Wifi"), F.lit("Fridge"), F.col("p_type")), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name"))
    return t.read("part").select((F.col("p_partkey") % 50).alias("property_id"), F.struct(F.lit("Others").alias("type"), F.lit("x").alias("name")).alias("first"), F.struct(kind.alias("type"), name.alias("name")).alias("f"), "p_partkey").select(
        "p_partkey", F.array("first", "f").alias("features")
    )


FEATURE_ERRORS = """
, feature_errors AS (
SELECT p_partkey, 'features' AS section, 'Feature 1 has invalid type: ' || p_type AS error FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT p_partkey, 'features', 'Feature 1 ''name'' must be a non-empty string' FROM part WHERE p_partkey % 5 = 0)
"""


@query("v4_features", FEATURE_ERRORS + "SELECT * FROM feature_errors")
def v4(t: Tables) -> DataFrame:
    return V.features(with_features(t), ["p_partkey"], "features")


@query("v5_pricing", """
SELECT p_partkey, 'pricing' AS section, 'Pricing field ''Deposit'' must be a valid number' AS error FROM part WHERE p_partkey % 4 = 0""")
def v5(t: Tables) -> DataFrame:
    d = t.read("part").select("p_partkey", F.concat(F.lit("£ "), F.format_number("p_retailprice", 2)).alias("price"), F.when(F.col("p_partkey") % 4 == 0, "on request").when(F.col("p_partkey") % 4 == 1, "").otherwise("€1,500").alias("deposit"))
    return V.pricing(d, ["p_partkey"], {"Price": "price", "Deposit": "deposit"})


@query("v6_email", r"""
, w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (regexp_matches(w, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')) AS emails FROM w GROUP BY doc_id HAVING count(*) FILTER (regexp_matches(w, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')) > 0""")
def v6(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w.contains("@") & V.is_email(w))
    return t.read("documents").select("doc_id", F.size(words).cast("long").alias("emails")).filter("emails > 0")


@query("v7_phone", r"""
, p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+[0-9][0-9 ()-]+[0-9]')) AS phone, unnest(range(len(regexp_extract_all(text, '\+[0-9][0-9 ()-]+[0-9]')))) AS pos FROM documents)
SELECT doc_id, pos, phone, regexp_matches(regexp_replace(phone, '[\s()+-]', '', 'g'), '^[0-9]{7,15}$') AS ok FROM p""")
def v7(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\+[0-9][0-9 ()-]+[0-9]"), 0)).alias("pos", "phone")).withColumn("pos", F.col("pos").cast("long"))
    return d.withColumn("ok", V.is_phone(F.col("phone")))


@query("v8_date", """
SELECT o_orderkey, o_orderkey % 4 <> 3 AS ok FROM orders""")
def v8(t: Tables) -> DataFrame:
    shape = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return t.read("orders").select("o_orderkey", V.is_date(shape).alias("ok"))


# node documents by rule: (text, its errors); # stands for a number of the listing
NODE2 = (
    ('{"x": #}', ("Missing 'description' section",)), ('{"description": [#]}', ("Description must be a dictionary",)), ('{"description": {"email": "none#", "faqs": "x"}}', ("Invalid email format", "FAQs must be a list")),
    ('{"description": {"email": "a#@b.example", "faqs": [{"question": "Q"}, 7, {"question": "Q", "answer": null}]}}', ("FAQ 0 must have 'question' and 'answer' fields", "FAQ 1 must be a dictionary")), ('{"description": {"email": "", "faqs": []}}', ()),
)
NODE3 = (
    ("{}", ("Missing 'configurations' section",)), ('{"configurations": {"n": #}}', ("Configurations must be a list",)), ('{"configurations": [{"Basic": #, "Source Details": {}, "Pricing": null}]}', ()),
    ('{"configurations": [{"Basic": {"Name": "#"}}, "x"]}', ("Configuration 0 missing 'Source Details' section", "Configuration 0 missing 'Pricing' section", "Configuration 1 must be a dictionary")),
)
NODE4 = (
    ("{}", ()), ('{"property_level": "#", "configurations": 1}', ("Property level data must be a dictionary", "Configurations must be a list")),
    ('{"property_level": {}, "configurations": [#, {"tenancy_options": {}}, {"tenancy_options": [{"tenancy_length_weeks": 44, "price_per_week": 99.5, "price_total": #}]}]}', ("Configuration 0 must be a dictionary", "Configuration 1 tenancy_options must be a list")),
    ('{"configurations": [{"tenancy_options": [1, {"tenancy_length_weeks": 44.5, "price_per_week": "#", "price_total": null}]}]}',
     ("Configuration 0 tenancy_options[0] must be a dictionary", "Configuration 0 tenancy_options[1].tenancy_length_weeks must be int", "Configuration 0 tenancy_options[1].price_per_week must be number", "Configuration 0 tenancy_options[1].price_total must be number")),
)


def node_documents(t: Tables, rules: tuple) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(x) for x, _ in rules)), (F.pmod("property_id", F.lit(len(rules))) + 1).cast("int"))
    return t.listing.select("property_id", F.replace(text, F.lit("#"), F.col("property_id").cast("string")).alias("doc"))


def node_errors(rules: tuple, section: str) -> str:
    rows = ", ".join("({}, '{}')".format(i, e.replace("'", "''")) for i, (_, errors) in enumerate(rules) for e in errors)
    return f"SELECT property_id, '{section}' AS section, error FROM listing JOIN (VALUES {rows}) r(i, error) ON property_id % {len(rules)} = i"


@query("v9_node2", node_errors(NODE2, "description"))
def v9(t: Tables) -> DataFrame:
    return V.node2(node_documents(t, NODE2), ["property_id"], "doc")


@query("v10_node3", node_errors(NODE3, "configurations"))
def v10(t: Tables) -> DataFrame:
    return V.node3(node_documents(t, NODE3), ["property_id"], "doc")


@query("v11_node4", node_errors(NODE4, "tenancy"))
def v11(t: Tables) -> DataFrame:
    return V.node4(node_documents(t, NODE4), ["property_id"], "doc")


@query("v12_node1_rollup", BASIC_ERRORS + LOCATION_ERRORS + "SELECT property_id, section || '.' || error AS error FROM basic_errors UNION ALL SELECT property_id, section || '.' || error FROM location_errors")
def v12(t: Tables) -> DataFrame:
    return v2(t).unionByName(v3(t)).select("property_id", F.concat_ws(".", "section", "error").alias("error"))


@query("v13_document", BASIC_ERRORS + LOCATION_ERRORS + """
, e AS (SELECT * FROM basic_errors UNION ALL SELECT * FROM location_errors)
SELECT property_id, section, string_agg(error, ' | ' ORDER BY error) AS errors, count(*) AS n_errors FROM e GROUP BY ALL""")
def v13(t: Tables) -> DataFrame:
    return V.document(["property_id"], v2(t), v3(t)).withColumn("errors", F.array_join("errors", " | "))


@query("v13_valid_listings", BASIC_ERRORS + LOCATION_ERRORS + """
SELECT property_id, name FROM listing WHERE property_id NOT IN (SELECT property_id FROM basic_errors) AND property_id NOT IN (SELECT property_id FROM location_errors)""")
def v13_valid(t: Tables) -> DataFrame:
    return V.valid(t.listing.select("property_id", "name"), ["property_id"], v2(t).unionByName(v3(t)))


@query("v14_dispatch", BASIC_ERRORS + LOCATION_ERRORS + f"""
, e AS (SELECT 1 AS node, error FROM basic_errors UNION ALL SELECT 1, error FROM location_errors UNION ALL SELECT 2, error FROM ({node_errors(NODE2, '')}) UNION ALL SELECT 3, error FROM ({node_errors(NODE3, '')}) UNION ALL SELECT 4, error FROM ({node_errors(NODE4, '')}))
SELECT node, count(*) FILTER (error LIKE '%must be%') AS errors, count(*) FILTER (error NOT LIKE '%must be%') AS warnings FROM e GROUP BY node""")
def v14(t: Tables) -> DataFrame:
    """The checks of each node, with counts of what has a wrong form (errors) and of the rest (warnings)."""
    checks = {1: v2(t).unionByName(v3(t)), 2: v9(t), 3: v10(t), 4: v11(t)}
    e = reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("node"), "error") for n, d in checks.items()))
    return e.groupBy("node").agg(F.count_if(F.col("error").contains("must be")).alias("errors"), F.count_if(~F.col("error").contains("must be")).alias("warnings"))


@query("v15_completeness_goals", """
, c AS (SELECT node, job_id, avg(confidence) * 100 AS completeness FROM node GROUP BY ALL)
SELECT node, CASE node WHEN 1 THEN 80.0 WHEN 2 THEN 75.0 WHEN 3 THEN 85.0 ELSE 80.0 END::DOUBLE AS goal, count(*) AS jobs FROM c WHERE round(completeness, 6) >= CASE node WHEN 1 THEN 80.0 WHEN 2 THEN 75.0 WHEN 3 THEN 85.0 ELSE 80.0 END GROUP BY ALL""")
def v15(t: Tables) -> DataFrame:
    c = t.node.groupBy("node", "job_id").agg((F.avg("confidence") * 100).alias("completeness"))
    return V.meets_goal(c, F.col("node"), F.round("completeness", 6)).filter("met").groupBy("node", "goal").agg(F.count(F.lit(1)).alias("jobs"))
