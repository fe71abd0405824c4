"""Queries of normalisation (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from .registry import query
from .tables import Tables

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
WEEKS = "CASE WHEN length_text LIKE '% weeks' THEN regexp_extract(length_text, '([0-9]+)', 1)::INT ELSE round_even(regexp_extract(length_text, '([0-9]+)', 1)::DOUBLE * 4.33, 0)::INT END"
MONTHS = "CASE WHEN length_text LIKE '% weeks' THEN round_even(regexp_extract(length_text, '([0-9]+)', 1)::INT / 4.345::DOUBLE, 0)::INT ELSE regexp_extract(length_text, '([0-9]+)', 1)::INT END"


def priced(t: Tables) -> DataFrame:
    """Tenancies with weeks, amount, price per week and in total."""
    d = N.with_length_weeks(t.tenancy, "length_text", "weeks").withColumn("amount", N.parsed_price(F.col("price_text"))["amount"])
    d = d.withColumn("__kind", N.price_type(F.col("price_type"), F.col("price_text")))
    weekly, total = N.weekly_and_total(F.col("amount"), F.col("__kind"), F.col("weeks"))
    return d.withColumn("price_per_week", weekly).withColumn("price_total", total).drop("__kind")


PRICED = f"""
, w AS (SELECT *, {WEEKS} AS weeks, substr(price_text, 2)::DOUBLE AS amount FROM tenancy),
priced AS (SELECT *, CASE price_type WHEN 'per_month' THEN amount / 4.33 WHEN 'total' THEN amount / nullif(weeks, 0) ELSE amount END AS price_per_week,
                  CASE price_type WHEN 'per_week' THEN amount * nullif(weeks, 0) WHEN 'per_month' THEN amount / 4.33 * nullif(weeks, 0) ELSE amount END AS price_total FROM w)
"""


@query("n1_currency", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor(l_extendedprice) AS value, 'GBP' AS currency,
       CASE price_type WHEN 'per_week' THEN 'PW' WHEN 'per_month' THEN 'PM' END AS period FROM tenancy""")
def n1(t: Tables) -> DataFrame:
    return t.tenancy.withColumn("x", N.currency_amount(F.col("price_text"), F.translate("price_type", "_", " "))).select(*ROW, "x.*")


@query("n2_duration_months", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {MONTHS} AS months FROM tenancy")
def n2(t: Tables) -> DataFrame:
    return t.tenancy.select(*ROW, N.duration_months(F.col("length_text")).alias("months"))


@query("n3_nested_normalize", f"""
SELECT property_id, config_name, count(*) AS options, sum(floor(l_extendedprice)) AS value_sum, sum({MONTHS})::BIGINT AS months_sum FROM tenancy GROUP BY ALL""")
def n3(t: Tables) -> DataFrame:
    """Normalises inside the nested options, without exploding them."""
    nested = t.tenancy.groupBy("property_id", "config_name").agg(F.collect_list(F.struct("length_text", "price_text")).alias("options"))
    fixed = nested.withColumn("options", F.transform("options", lambda o: F.struct(N.currency_amount(o["price_text"], F.lit(""))["value"].alias("value"), N.duration_months(o["length_text"]).alias("months"))))
    total = lambda f, kind: F.aggregate("options", F.lit(0).cast(kind), lambda acc, o: acc + o[f].cast(kind))
    return fixed.select("property_id", "config_name", F.size("options").cast("long").alias("options"), total("value", "double").alias("value_sum"), total("months", "long").alias("months_sum"))


@query("n4_length_weeks", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {WEEKS} AS weeks FROM tenancy")
def n4(t: Tables) -> DataFrame:
    return t.tenancy.select(*ROW, N.length_weeks(F.col("length_text")).alias("weeks"))


@query("n5_parse_price", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'AUD' ELSE '' END AS currency, floor(p_retailprice * 100) / 100 AS amount FROM part""")
def n5(t: Tables) -> DataFrame:
    figure = F.format_number(F.floor(F.col("p_retailprice") * 100) / 100, 2)
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("£"), figure)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("from aud "), figure, F.lit(" per month"))).otherwise(figure)
    return t.read("part").select("p_partkey", N.parsed_price(text).alias("x")).select("p_partkey", "x.*")


@query("n6_price_type", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, price_type AS given, CASE l_returnflag WHEN 'A' THEN 'per_week' WHEN 'N' THEN 'per_month' ELSE 'total' END AS told FROM tenancy""")
def n6(t: Tables) -> DataFrame:
    words = F.when(F.col("l_returnflag") == "A", F.concat("price_text", F.lit(" PW"))).when(F.col("l_returnflag") == "N", F.concat("price_text", F.lit(" / monthly"))).otherwise(F.concat("price_text", F.lit(" for the stay")))
    return t.tenancy.select(*ROW, N.price_type(F.translate("price_type", "_", " "), F.lit(None).cast("string")).alias("given"), N.price_type(F.lit(" "), words).alias("told"))


@query("n7_weekly_and_total", PRICED + "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, weeks, price_per_week, price_total FROM priced")
def n7(t: Tables) -> DataFrame:
    return priced(t).select(*ROW, "weeks", "price_per_week", "price_total")


@query("n8_configuration_id", r"""
SELECT p_partkey, left(regexp_replace(lower(p_name), '\s+', '-', 'g') || '-' || lower(regexp_replace(p_type, '\s+', '-', 'g')) || '-' || CASE WHEN p_size < 25 THEN p_size::VARCHAR || '-' || (p_size + 5)::VARCHAR || 'sqm' ELSE p_size::VARCHAR || 'sqm' END
       || CASE WHEN p_partkey % 2 = 0 THEN '-dual' ELSE '' END, 120) AS configuration_id FROM part""")
def n8(t: Tables) -> DataFrame:
    high = F.when(F.col("p_size") < 25, F.col("p_size") + 5).otherwise(F.col("p_size"))
    return t.read("part").select("p_partkey", N.configuration_id(F.col("p_name"), F.col("p_type"), F.col("p_size"), high, F.when(F.col("p_partkey") % 2 == 0, "Yes").otherwise("no")).alias("configuration_id"))


@query("n9_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def n9(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", T.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


@query("n10_config_name", "SELECT p_partkey, lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END) AS name_key FROM part")
def n10(t: Tables) -> DataFrame:
    """The first filled of the places where a name may stand."""
    pick = lambda i, c: F.when(F.col("p_partkey") % 3 == i, F.concat(F.lit("  "), c, F.lit("\n"))).otherwise(" ")
    return t.read("part").select("p_partkey", T.key(F.coalesce(*(T.blank_to_null(pick(i, c)) for i, c in enumerate(("p_name", "p_type", "p_brand"))))).alias("name_key"))


@query("n11_sanitize", r"""
, s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[<>"'']', '', 'g') AS c FROM documents)
SELECT doc_id, coalesce(CASE WHEN length(c) > 200 THEN regexp_replace(left(c, 200), '^\s+|\s+$', '', 'g') ELSE c END, '') AS clean FROM s""")
def n11(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", T.sanitize(F.col("text"), 200).alias("clean"))


@query("n13_display_price", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice) ELSE p_size::DOUBLE END AS price FROM part")
def n13(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", N.first_price(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("£ "), F.format_number(F.floor("p_retailprice"), 0))), F.lit(" "), F.concat(F.col("p_size").cast("string"), F.lit("€"))).alias("price"))


@query("n14_duration_key", "SELECT DISTINCT length_text, CASE WHEN length_text LIKE '% months' THEN regexp_extract(length_text, '([0-9]+)', 1) || 'm' ELSE length_text END AS duration_key FROM tenancy")
def n14(t: Tables) -> DataFrame:
    return t.tenancy.select("length_text").distinct().select("length_text", N.duration_key(F.col("length_text")).alias("duration_key"))


@query("n15_fallback_tenancy", "SELECT property_id, config_name, CASE WHEN options > 2 THEN options ELSE 1 END AS n, options <= 2 AS made FROM configuration")
def n15(t: Tables) -> DataFrame:
    """One option made from the configuration itself where none is known (here: where two or fewer are)."""
    c = t.configuration.withColumn("known", F.when(F.col("options") > 2, F.sequence(F.lit(1).cast("long"), "options")).otherwise(F.array().cast("array<bigint>")))
    own = F.transform("known", lambda i: F.struct(i.alias("position"), F.lit(False).alias("made")))
    made = F.array(F.struct(F.lit(1).cast("long").alias("position"), F.lit(True).alias("made")))
    c = c.withColumn("tenancy_options", F.when(F.size("known") == 0, made).otherwise(own))
    return c.select("property_id", "config_name", F.size("tenancy_options").cast("long").alias("n"), F.exists("tenancy_options", lambda o: o["made"]).alias("made"))


@query("n16_safe_names", "SELECT p_partkey, left(regexp_replace(p_brand || '/' || p_name, '[^a-zA-Z0-9_]', '_', 'g'), 50) AS safe FROM part")
def n16(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", T.safe_name(F.concat_ws("/", "p_brand", "p_name")).alias("safe"))


@query("n17_split_features", r"""
, s AS (SELECT doc_id, unnest(string_split_regex(text, '[,;\n]')) AS x FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM s)
SELECT d.doc_id, count(x) FILTER (x <> '') AS n, coalesce(sum(length(x)), 0)::BIGINT AS signs FROM documents d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id""")
def n17(t: Tables) -> DataFrame:
    f = F.coalesce(T.features_of(F.col("text")), F.array())
    return t.read("documents").select("doc_id", f.alias("f")).select("doc_id", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("signs"))
