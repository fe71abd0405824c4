"""Queries of merging (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators import merge as M
from .normalizing import PRICED, WEEKS, priced
from .registry import query
from .tables import Tables


@query("m1_merge_nodes", """
SELECT job_id, max(confidence) FILTER (node = 1) AS node_1, max(confidence) FILTER (node = 2) AS node_2, max(confidence) FILTER (node = 3) AS node_3, max(confidence) FILTER (node = 4) AS node_4 FROM node GROUP BY 1""")
def m1(t: Tables) -> DataFrame:
    return M.nodes_to_listing(t.node, "job_id", "node", "confidence", [1, 2, 3, 4])


@query("m2_conflicts", """
SELECT property_id, CASE WHEN property_id % 3 = 0 THEN region ELSE name END AS name, city, ((property_id % 3 > 0 AND property_id % 2 = 0)::INT + (property_id % 5 = 0)::INT)::INT AS conflicts FROM listing""")
def m2(t: Tables) -> DataFrame:
    k = F.col("property_id")
    d = t.listing.withColumn("name1", F.when(k % 3 == 0, "  ").otherwise(F.col("name"))).withColumn("name4", F.when(k % 3 == 0, F.col("region")).when(k % 2 == 0, F.lit("other")).otherwise(F.col("name")))
    (name, city), n = M.resolve([(F.col("name1"), F.col("name4")), (F.col("city"), F.when(k % 5 == 0, "elsewhere").otherwise(F.col("city")))])
    return d.select("property_id", name.alias("name"), city.alias("city"), n.alias("conflicts"))


@query("m3_attach_tenancies", """
, o AS (SELECT property_id, l_partkey % 2 = 0 AS by_id, config_name FROM tenancy)
SELECT property_id, config_name AS cfg, CASE WHEN by_id THEN 'id' ELSE 'name' END AS matched_by, count(*) AS options FROM o GROUP BY ALL""")
def m3(t: Tables) -> DataFrame:
    c = t.configuration.select("property_id", F.upper("config_name").alias("config_name"), F.md5("config_name").alias("configuration_id"), F.col("config_name").alias("cfg"), F.col("area").alias("pos"))
    o = t.tenancy.select("property_id", F.regexp_replace("config_name", " ", "  ").alias("config_name"), F.when(F.col("l_partkey") % 2 == 0, F.md5("config_name")).alias("configuration_id"))
    return M.attach(o, c, "configuration_id", "config_name", ["property_id"]).groupBy("property_id", "cfg", "matched_by").agg(F.count(F.lit(1)).alias("options"))


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]


@query("m4_distinct_tenancies", f"""
, o AS (SELECT *, CASE WHEN l_linenumber % 7 = 0 THEN lower(length_text) ELSE ({WEEKS})::VARCHAR END AS k, (floor(l_extendedprice / 1000))::BIGINT AS price FROM tenancy),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id, config_name, k, price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS n FROM o)
SELECT property_id, config_name, length_text, price, l_orderkey FROM r WHERE n = 1""")
def m4(t: Tables) -> DataFrame:
    o = priced(t).withColumn("weeks", F.when(F.col("l_linenumber") % 7 > 0, F.col("weeks"))).withColumn("price", F.floor(F.col("l_extendedprice") / 1000))
    return M.distinct_options(o, ["property_id", "config_name"], "weeks", "length_text", "price", ORDER).select("property_id", "config_name", "length_text", "price", "l_orderkey")


@query("m5_price_range", PRICED + "SELECT property_id, config_name, min(price_per_week) AS min_price, max(price_per_week) AS max_price FROM priced GROUP BY ALL")
def m5(t: Tables) -> DataFrame:
    return priced(t).groupBy("property_id", "config_name").agg(F.min("price_per_week").alias("min_price"), F.max("price_per_week").alias("max_price"))


@query("m6_union_features", """
, u AS (SELECT DISTINCT property_id, name, 0 AS rank FROM feature WHERE type LIKE 'P%' UNION SELECT DISTINCT property_id, upper(name), 1 FROM feature UNION SELECT DISTINCT property_id, type, 2 FROM feature),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id, lower(name) ORDER BY rank, name) AS n FROM u)
SELECT property_id, name, rank FROM r WHERE n = 1""")
def m6(t: Tables) -> DataFrame:
    a = t.feature.filter(F.col("type").startswith("P")).select("property_id", "name")
    b = t.feature.select("property_id", F.concat(F.upper("name"), F.lit(" ")).alias("name"))
    c = t.feature.select("property_id", F.col("type").alias("name"))
    return M.union_features([a, b, c], ["property_id"], "name").withColumn("name", F.rtrim("name"))


@query("m7_location_fill", "SELECT property_id, CASE WHEN property_id % 2 = 0 THEN region ELSE city END AS city, region, 'X' || property_id AS postcode FROM listing")
def m7(t: Tables) -> DataFrame:
    """City from the record, else its region; the postcode stays."""
    own = F.when(F.col("property_id") % 2 == 0, " ").otherwise(F.col("city"))
    return t.listing.select("property_id", F.coalesce(blank_to_null(own), F.col("region")).alias("city"), "region", F.concat(F.lit("X"), F.col("property_id").cast("string")).alias("postcode"))


@query("m8_without_empty", """
SELECT property_id, '{"id":' || property_id || CASE WHEN property_id % 2 = 0 THEN ',"name":"' || name || '"' ELSE '' END || ',"zero":0,"no":false}' AS doc FROM listing""")
def m8(t: Tables) -> DataFrame:
    return t.listing.select("property_id", M.without_empty(F.struct(F.col("property_id").alias("id"), F.when(F.col("property_id") % 2 == 0, F.col("name")).alias("name"), F.lit(0).alias("zero"), F.lit(False).alias("no"))).alias("doc"))


@query("m9_ordered", f"""
, o AS (SELECT DISTINCT property_id, config_name, coalesce({WEEKS}, 0) AS w, length_text FROM tenancy)
SELECT property_id, config_name, string_agg(length_text, ',' ORDER BY w, length_text) AS lengths FROM o GROUP BY ALL""")
def m9(t: Tables) -> DataFrame:
    """Options in order of their length, ties by text, inside each configuration."""
    o = priced(t).groupBy("property_id", "config_name").agg(F.array_sort(F.collect_set(F.struct("weeks", "length_text"))).alias("o"))
    return o.select("property_id", "config_name", F.array_join(F.transform("o", lambda x: x["length_text"]), ",").alias("lengths"))


@query("m10_default_names", """
, c AS (SELECT property_id, config_name, row_number() OVER (PARTITION BY property_id ORDER BY config_name) AS n FROM configuration),
d AS (SELECT property_id, n, CASE WHEN n % 9 = 0 THEN 'unnamed_config_' || n WHEN n % 5 = 0 THEN 'STUDIO' ELSE config_name END AS config_name FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id, lower(config_name) ORDER BY n) AS k FROM d)
SELECT property_id, config_name FROM r WHERE k = 1""")
def m10(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("property_id").orderBy("config_name"))
    c = t.configuration.select("property_id", n.alias("pos"), "config_name").withColumn("config_name", F.when(F.col("pos") % 9 == 0, " ").when(F.col("pos") % 5 == 0, "STUDIO").otherwise(F.col("config_name")))
    return M.default_names(c, ["property_id"], "config_name", ["pos"]).select("property_id", "config_name")


@query("m11_fan_out", """
, o AS (SELECT property_id, config_name, CASE WHEN l_linenumber = 1 THEN NULL ELSE length_text END AS length_text, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate FROM tenancy),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id, config_name, length_text ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS k FROM o)
SELECT property_id, config_name, count(*) AS options FROM r WHERE k = 1 OR length_text IS NULL GROUP BY ALL""")
def m11(t: Tables) -> DataFrame:
    """Appended options once per duration text; those without one all stay."""
    o = t.tenancy.withColumn("length_text", F.when(F.col("l_linenumber") > 1, F.col("length_text")))
    known = M.first_of(o.filter("length_text IS NOT NULL"), ["property_id", "config_name", "length_text"], ORDER)
    return known.unionByName(o.filter("length_text IS NULL")).groupBy("property_id", "config_name").agg(F.count(F.lit(1)).alias("options"))


@query("m12_node_map", """
, n AS (SELECT job_id, node, max(status) AS status FROM node GROUP BY ALL)
SELECT job_id, count(*) AS nodes, max(status) FILTER (node = 1) AS node1, max(status) FILTER (node = 4) AS node4 FROM n GROUP BY 1""")
def m12(t: Tables) -> DataFrame:
    n = t.node.groupBy("job_id", "node").agg(F.max("status").alias("status"))
    m = n.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "status"))).alias("m"))
    return m.select("job_id", F.size("m").cast("long").alias("nodes"), F.try_element_at("m", F.lit(1)).alias("node1"), F.try_element_at("m", F.lit(4)).alias("node4"))


@query("m13_prefer_tenancies", """
SELECT property_id, config_name, CASE WHEN options > 1 THEN 'tenancy' ELSE 'root' END AS origin FROM configuration""")
def m13(t: Tables) -> DataFrame:
    a = t.configuration.filter("options > 1").select("property_id", "config_name", F.lit("tenancy").alias("origin"))
    b = t.configuration.select("property_id", "config_name", F.lit("root").alias("origin"))
    return M.with_missing(a, b, ["property_id"], "config_name")
