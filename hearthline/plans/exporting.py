"""Queries of export shapes (E) and of the sinks (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export as E
from .registry import query
from .tables import Tables


@query("e1_flat_options", """
SELECT property_id, config_name, area, CASE WHEN options > 1 THEN i END AS "tenancy.position" FROM configuration, LATERAL (SELECT unnest(CASE WHEN options > 1 THEN range(1, options + 1) ELSE [0] END) AS i) x""")
def e1(t: Tables) -> DataFrame:
    c = t.configuration.withColumn("tenancy_options", F.when(F.col("options") > 1, F.transform(F.sequence(F.lit(1).cast("long"), "options"), lambda i: F.struct(i.alias("position")))))
    return E.flat(c.select("property_id", "config_name", "area", "tenancy_options"), "tenancy_options", "tenancy.")


@query("e2_long_rows", """
, u AS (SELECT property_id, 'Basic Info' AS section, unnest(['name', 'city', 'region']) AS field, unnest([name, city, region]) AS value, 1 AS node FROM listing),
f AS (SELECT property_id, name, row_number() OVER (PARTITION BY property_id ORDER BY name) AS n FROM (SELECT DISTINCT property_id, name FROM feature))
SELECT * FROM u UNION ALL SELECT property_id, 'Features', 'Feature ' || n, name, 1 FROM f""")
def e2(t: Tables) -> DataFrame:
    names = t.feature.groupBy("property_id").agg(F.sort_array(F.collect_set("name")).alias("features"))
    return E.long_rows(t.listing, ["property_id"], "Basic Info", ["name", "city", "region"], 1).unionByName(E.numbered_rows(names, ["property_id"], "Features", "Feature", "features", 1))


@query("e3_wide", """
, f AS (SELECT property_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS features FROM feature GROUP BY 1)
SELECT property_id, name AS basic_name, city AS location_city, region AS location_region, features FROM listing JOIN f USING (property_id)""")
def e3(t: Tables) -> DataFrame:
    return E.wide(record(t))


@query("e4_crm", """
, f AS (SELECT property_id, count(DISTINCT name) AS features FROM feature GROUP BY 1), c AS (SELECT property_id, count(*) AS configurations FROM configuration GROUP BY 1)
SELECT property_id, name AS title, city || ', ' || region AS place, features, configurations FROM listing JOIN f USING (property_id) JOIN c USING (property_id)""")
def e4(t: Tables) -> DataFrame:
    return E.crm(record(t))


def record(t: Tables) -> DataFrame:
    """One nested record a listing."""
    f = t.feature.groupBy("property_id").agg(F.sort_array(F.collect_set("name")).alias("features"))
    c = t.configuration.groupBy("property_id").agg(F.collect_list("config_name").alias("configurations"))
    return t.listing.join(f, "property_id").join(c, "property_id").select("property_id", F.struct("name").alias("basic_info"), F.struct("city", "region").alias("location"), "features", "configurations")


@query("e5_format_dispatch", """
, f AS (SELECT property_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS features, count(DISTINCT name) AS n FROM feature GROUP BY 1), c AS (SELECT property_id, count(*) AS configurations FROM configuration GROUP BY 1),
r AS (SELECT * FROM listing JOIN f USING (property_id) JOIN c USING (property_id))
SELECT property_id, 'standard' AS format, name || '|' || city || '|' || region || '|' || features || '|' || configurations AS record FROM r
UNION ALL SELECT property_id, 'airtable', name || '|' || city || '|' || region || '|' || features FROM r
UNION ALL SELECT property_id, 'crm', name || '|' || city || ', ' || region || '|' || n || '|' || configurations FROM r""")
def e5(t: Tables) -> DataFrame:
    """The three formats of each record, each as one text of all its fields."""
    fields = {
        "standard": ("basic_info.name", "location.city", "location.region", F.array_join("features", ", "), F.size("configurations")),
        "airtable": ("basic_name", "location_city", "location_region", "features"), "crm": ("title", "place", "features", "configurations"),
    }
    kinds = [E.shaped(record(t), f).select("property_id", F.lit(f).alias("format"), F.concat_ws("|", *c).alias("record")) for f, c in fields.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("e6_job_detail", """
SELECT job_id, any_value(j.status) AS status, count(*) AS nodes, string_agg(node || ':' || n.status, ',' ORDER BY node || ':' || n.status) AS detail FROM job j JOIN node n USING (job_id) GROUP BY 1""")
def e6(t: Tables) -> DataFrame:
    n = t.node.groupBy("job_id").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "node", "status"))), ",").alias("detail"))
    return t.job.select("job_id", "status").join(n, "job_id")


@query("e7_header", """
, f AS (SELECT property_id, list(DISTINCT name ORDER BY name) AS names FROM feature GROUP BY 1), c AS (SELECT property_id, count(*) AS configurations FROM configuration GROUP BY 1)
SELECT property_id, configurations, len(names) AS features, array_to_string(names[1:10], ', ') AS first_features FROM f JOIN c USING (property_id)""")
def e7(t: Tables) -> DataFrame:
    return E.header(record(t))


@query("s5_snapshot", "SELECT job_id, status, priority, created_at FROM job")
def s5(t: Tables) -> DataFrame:
    """A snapshot written as JSON and read back with its schema."""
    from ..sources.snapshot import shared_folder, snapshot

    return snapshot(t.job.select("job_id", "status", "priority", "created_at"), shared_folder(t.spark, "snapshot"))


@query("s7_csv_sink", "SELECT property_id::VARCHAR AS property_id, config_name, area::VARCHAR AS area, options::VARCHAR AS options FROM configuration")
def s7(t: Tables) -> DataFrame:
    """CSV with sorted columns as header, read back as text."""
    from ..sources.snapshot import read_csv, shared_folder, write_csv

    folder = shared_folder(t.spark, "csv")
    write_csv(t.configuration.select("property_id", "config_name", "area", "options"), folder)
    return read_csv(t.spark, folder)
