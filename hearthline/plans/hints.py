"""Queries of hints (H) and of questions and policies (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fragments as X
from ..operators import hints as H
from ..operators import links as L
from ..operators.scan import paged
from .crawling import ANCHORS, FRAGMENTS, HOST, fragments
from .registry import query
from .tables import Tables

# whole texts behind an opening by rule, as the given documents have little of such wording
WORDED = """
, w AS (SELECT doc_id, source, CASE doc_id % 8 WHEN 0 THEN 'A guarantor is required here. ' WHEN 1 THEN 'No guarantor ' WHEN 2 THEN 'We have a Guarantor. ' WHEN 3 THEN 'Our refund policy: cooling off of 14 days. ' WHEN 4 THEN 'Flats in Leeds West, LS1 4AB, 12 High Street. ' WHEN 5 THEN E'Deposit: 100\\nRent: 5\\nDeposit: 200\\nWhat deposit?: 100\\n' WHEN 6 THEN 'If the visa refused you, no questions asked. Terms apply. ' ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL)
"""


def worded(t: Tables) -> DataFrame:
    texts = ("A guarantor is required here. ", "No guarantor ", "We have a Guarantor. ", "Our refund policy: cooling off of 14 days. ", "Flats in Leeds West, LS1 4AB, 12 High Street. ", "Deposit: 100\nRent: 5\nDeposit: 200\nWhat deposit?: 100\n", "If the visa refused you, no questions asked. Terms apply. ", "")
    head = F.element_at(F.array(*map(F.lit, texts)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return t.read("documents").filter("text IS NOT NULL").select("doc_id", "source", F.concat(head, "text").alias("text"))


@query("h1_longest_name", "SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS p_name FROM part GROUP BY 1")
def h1(t: Tables) -> DataFrame:
    return H.longest(t.read("part"), "p_brand", "p_name", "p_partkey")


@query("h2_coordinates", """
, p AS (SELECT s_suppkey AS page_id, s_nationkey AS site, CASE WHEN s_suppkey % 4 = 0 THEN 'nan' WHEN s_suppkey % 4 = 1 THEN '91' ELSE s_suppkey::VARCHAR END AS lat, (s_suppkey / 2)::DOUBLE AS lng, s_suppkey % 3 AS source_rank FROM supplier)
SELECT site, arg_min(lat, (source_rank, page_id)) AS lat, arg_min(lng, (source_rank, page_id)) AS lng FROM p WHERE page_id % 4 > 1 AND page_id <= 90 GROUP BY 1""")
def h2(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    p = t.read("supplier").select(F.col("s_nationkey").alias("site"), k.alias("page_id"), F.lit(0).alias("seq"), (k % 3).alias("source_rank"), F.when(k % 4 == 0, "nan").when(k % 4 == 1, "91").otherwise(k.cast("string")).alias("lat"), (k / 2).cast("string").alias("lng"))
    return H.coordinates(p, "site").withColumn("lng", F.col("lng").cast("double"))


# pages with data by rule, as the given ones have none: JSON-LD on two of three, a map script on every other, a place in the text of all
SITE = f", h AS (SELECT page_id, {HOST} AS site FROM pages)"


def with_data(t: Tables) -> DataFrame:
    k = F.col("page_id").cast("string")
    linked = F.concat(F.lit('<script type="application/ld+json">{"name": "Hall '), k, F.lit('", "geo": {"latitude": 1.5, "longitude": '), k, F.lit('}, "amenityFeature": [{"name": "Wifi '), k, F.lit('"}, "Gym"]}</script>'))
    script = F.concat(F.lit("<script>m.setView([2.5, "), (F.col("page_id") % 180).cast("string"), F.lit("]);</script>"))
    more = F.concat(F.when(F.col("page_id") % 3 > 0, linked).otherwise(""), F.when(F.col("page_id") % 2 == 0, script).otherwise(""), F.lit("<p>Latitude: 3.5, longitude: 7</p>"))
    return t.read("pages").withColumn("html", F.concat("html", more)).withColumn("site", L.host(F.col("url")))


@query("h1_linked_names", SITE + " SELECT site, arg_max('Hall ' || page_id, (length('Hall ' || page_id), -page_id)) AS name FROM h WHERE page_id % 3 > 0 GROUP BY 1")
def h1_linked(t: Tables) -> DataFrame:
    d = with_data(t)
    return H.longest(H.linked_names(H.linked_data(X.extract(d))).join(d.select("page_id", "site"), "page_id"), "site", "name", "page_id")


@query("h2_places", SITE + """
, p AS (SELECT site, page_id, 0 AS r, '2.5' AS lat, (page_id % 180)::VARCHAR AS lng, 1 AS seq FROM h WHERE page_id % 2 = 0 UNION ALL SELECT site, page_id, 0, '1.5', page_id::VARCHAR, 0 FROM h WHERE page_id % 3 > 0 AND page_id <= 180
  UNION ALL SELECT site, page_id, 2, '3.5', '7', 0 FROM h)
SELECT site, arg_min(lat, (r, page_id, seq)) AS lat, arg_min(lng, (r, page_id, seq)) AS lng FROM p GROUP BY 1""")
def h2_places(t: Tables) -> DataFrame:
    """Scripts go first (JSON-LD that names degrees is one of them), then the texts."""
    d = with_data(t)
    f = X.extract(d)
    found = H.places(f, H.linked_data(f), d.select("page_id", X.visible_text(F.col("html")).alias("text")))
    return H.coordinates(found.join(d.select("page_id", "site"), "page_id"), "site")


@query("h9_linked_amenities", SITE + """
, a AS (SELECT site, 'Wifi ' || page_id AS name, page_id, 0 AS i FROM h WHERE page_id % 3 > 0 UNION ALL SELECT site, 'Gym', page_id, 1 FROM h WHERE page_id % 3 > 0),
o AS (SELECT site, name, min((page_id, i)) AS place FROM a GROUP BY ALL)
SELECT site, name, n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place)::INT AS n FROM o) WHERE n <= 50""")
def h9_linked(t: Tables) -> DataFrame:
    """The first fifty amenities of a site's pages, each once."""
    from pyspark.sql.window import Window

    d = with_data(t)
    once = H.amenities(H.linked_data(X.extract(d))).join(d.select("page_id", "site"), "page_id").groupBy("site", "name").agg(F.min(F.struct("page_id", "seq", "i")).alias("at"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("at"))).filter("n <= 50").select("site", "name", "n")


@query("h3_address", WORDED + f"""
SELECT source, arg_min(pc, doc_id) FILTER (pc <> '') AS postcode, arg_min(city, doc_id) FILTER (city <> '') AS city, arg_min(street, doc_id) FILTER (street <> '') AS street FROM
 (SELECT *, regexp_extract(text, '{H.POSTCODE}', 1) AS pc, regexp_extract(text, '{H.CITY}', 1) AS city, regexp_extract(text, '{H.STREET}', 1) AS street FROM w) GROUP BY 1""")
def h3(t: Tables) -> DataFrame:
    c = F.col("text")
    return H.first_by(worded(t), "source", "doc_id", {"postcode": H.found(c, H.POSTCODE), "city": H.found(c, H.CITY), "street": H.found(c, H.STREET)})


@query("h4_h7_contact", r"""
SELECT source, arg_min(m, doc_id) FILTER (m <> '') AS email, arg_min(p, doc_id) FILTER (p <> '') AS phone FROM
 (SELECT source, doc_id, regexp_extract(text, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', 1) AS m, regexp_extract(text, '0[0-9]{1,4}\s*[0-9]{1,4}\s*[0-9]{1,4}', 0) AS p FROM documents) GROUP BY 1""")
def h4(t: Tables) -> DataFrame:
    return H.first_by(t.read("documents"), "source", "doc_id", {"email": H.found(F.col("text"), H.EMAIL), "phone": X.first_phone(F.col("text"))})


@query("h5_lists_by_label", ANCHORS + FRAGMENTS + f"""
, h AS (SELECT page_id, {HOST} AS site FROM pages),
f AS (SELECT page_id, kind, label, body FROM fragments WHERE kind = 'list' UNION ALL SELECT page_id, 'table', CASE WHEN page_id % 2 = 0 THEN 'pricing' ELSE 'tenancy' END, CASE WHEN page_id % 2 = 0 THEN 'Price | ' ELSE 'Start | ' END || page_id FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY site, kind, label ORDER BY page_id) AS ordinal FROM f JOIN h USING (page_id))
SELECT site, kind, label, (ordinal - 1) // 20 + 1 AS page, count(*) AS n, string_agg(body, ' ~ ' ORDER BY ordinal) AS bodies FROM n GROUP BY ALL""")
def h5(t: Tables) -> DataFrame:
    """Lists and tables of a site by label, twenty a row; pages got a table by rule, as the given ones have none."""
    price = F.format_string("<table><tr><th>%s</th><td>%d</td></tr></table>", F.when(F.col("page_id") % 2 == 0, "Price").otherwise("Start"), "page_id")
    d = t.read("pages").withColumn("html", F.concat("html", price))
    f = X.extract(d, "list", "table").withColumn("body", F.regexp_replace("body", r"\s+", " ")).join(d.select("page_id", L.host(F.col("url")).alias("site")), "page_id")
    g = paged(f, ["site", "kind", "label"], "page_id", ["seq"], 20).groupBy("site", "kind", "label", "page")
    g = g.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", "body"))).alias("x"))  # 20 at most
    return g.select("site", "kind", "label", "page", "n", F.array_join(F.transform("x", lambda x: x["body"]), " ~ ").alias("bodies"))


DEFINITIONS = WORDED + r"""
, l AS (SELECT source, doc_id, unnest(string_split(text, E'\n')) AS l, unnest(range(len(string_split(text, E'\n')))) AS line FROM w),
p AS (SELECT source, doc_id, line, lower(regexp_replace(split_part(l, ':', 1), '^\s+|\s+$', '', 'g')) AS k, regexp_replace(l[strpos(l, ':') + 1:], '^\s+|\s+$', '', 'g') AS v FROM l WHERE contains(l, ':')),
g AS (SELECT source, k, doc_id, arg_max(v, line) AS v FROM p WHERE k <> '' AND v <> '' GROUP BY ALL),
definitions AS (SELECT source, k, arg_min(v, doc_id) AS v FROM g GROUP BY ALL)
"""


@query("h6_definitions", DEFINITIONS + "SELECT * FROM definitions")
def h6(t: Tables) -> DataFrame:
    return H.definitions(worded(t), "source", "doc_id", "text")


@query("h8_guarantor", WORDED + "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for p, k in H.GUARANTOR) + " WHEN contains(lower(text), 'guarantor') THEN 'guarantor_mentioned' END AS guarantor FROM w")
def h8(t: Tables) -> DataFrame:
    return worded(t).select("doc_id", H.guarantor_class(F.col("text")).alias("guarantor"))


@query("h9_amenities", "SELECT property_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY name)::INT AS n FROM (SELECT DISTINCT property_id, name || ' ' || type AS name FROM feature)) WHERE n <= 50")
def h9(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    f = t.feature.select("property_id", F.concat_ws(" ", "name", "type").alias("name")).distinct()
    return f.withColumn("n", F.row_number().over(Window.partitionBy("property_id").orderBy("name"))).filter("n <= 50")


@query("h10_source_link", f"SELECT {HOST} AS site, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def h10(t: Tables) -> DataFrame:
    return t.read("pages").groupBy(L.host(F.col("url")).alias("site")).agg(F.min_by("url", "page_id").alias("url"))


@query("x8_heading_sections", ANCHORS + FRAGMENTS + "SELECT page_id, label AS title, body FROM fragments WHERE kind = 'heading_section'")
def x8(t: Tables) -> DataFrame:
    return fragments(t, "heading_section").select("page_id", F.col("label").alias("title"), "body")


@query("x21_footers", ANCHORS + FRAGMENTS + "SELECT page_id, body FROM fragments WHERE kind = 'footer'")
def x21(t: Tables) -> DataFrame:
    return fragments(t, "footer").select("page_id", "body")


RANKS = ("title", "heading", "list", "heading_section", "footer", "section")


@query("x24_page_texts", ANCHORS + FRAGMENTS + f"SELECT page_id, left(string_agg(body, E'\\n' ORDER BY list_position({list(RANKS)}, kind)), 120000) AS text FROM fragments GROUP BY 1")
def x24(t: Tables) -> DataFrame:
    """Fragments of a page joined by the rank of their kind, cut to the budget of a page (a rule of the operator)."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("kind"))
    g = fragments(t, *RANKS).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "seq", "body"))).alias("x"))
    return g.select("page_id", F.substring(F.array_join(F.transform("x", lambda x: x["body"]), "\n"), 1, 120000).alias("text"))


@query("f2_turn_pairs", """
, w AS (SELECT *, lead(role) OVER o AS r, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, answer FROM w WHERE role = 'user' AND r = 'assistant'""")
def f2(t: Tables) -> DataFrame:
    return H.turn_pairs(t.read("conversations"), "conv_id", "turn", "role", "text")


@query("f2_question_lines", r"""
, l AS (SELECT conv_id, turn, unnest(string_split(text, E'\n')) AS l, unnest(range(len(string_split(text, E'\n')))) AS line FROM conversations),
m AS (SELECT conv_id, turn, line, CASE WHEN line > 0 THEN l WHEN turn % 2 = 0 THEN 'Q: ' || l ELSE 'A: ' || l END AS l FROM l),
s AS (SELECT *, regexp_replace(l, '^\s+|\s+$', '', 'g') AS b, regexp_replace(regexp_replace(l, '^\s*[QqAa]:', ''), '^\s+|\s+$', '', 'g') AS bare FROM m),
a AS (SELECT *, starts_with(lower(b), 'q:') OR (ends_with(b, '?') AND NOT starts_with(lower(b), 'a:')) AS asks FROM s),
w AS (SELECT *, sum(asks::INT) OVER (PARTITION BY conv_id ORDER BY turn, line) AS pair FROM a)
SELECT conv_id, pair::BIGINT AS pair, arg_min(bare, (turn, line)) FILTER (asks) AS question, arg_min(bare, (turn, line)) FILTER (NOT asks AND b <> '') AS answer FROM w WHERE pair > 0 GROUP BY ALL HAVING question <> '' AND answer <> ''""")
def f2_lines(t: Tables) -> DataFrame:
    """All lines of all turns; the first of a turn is marked as question or answer."""
    l = t.read("conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    mark = F.when(F.col("line") > 0, "").when(F.col("turn") % 2 == 0, "Q: ").otherwise("A: ")
    return H.question_pairs(l.select("conv_id", F.struct("turn", "line").alias("at"), F.concat(mark, "l").alias("l")), ["conv_id"], "at", "l")


@query("f3_definition_questions", DEFINITIONS + "SELECT source, k AS question, v AS answer FROM definitions WHERE ends_with(k, '?')")
def f3(t: Tables) -> DataFrame:
    """Terms that end in a question mark, with their definition."""
    return H.definitions(worded(t), "source", "doc_id", "text").filter(F.col("k").endswith("?")).select("source", F.col("k").alias("question"), F.col("v").alias("answer"))


@query("f4_distinct_pairs", """
, w AS (SELECT *, lead(role) OVER o AS r, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT lower(text) AS q, lower(answer) AS a FROM w WHERE role = 'user' AND r = 'assistant' GROUP BY ALL""")
def f4(t: Tables) -> DataFrame:
    return H.distinct_pairs(f2(t), [], ["conv_id", "turn"]).select(F.lower("question").alias("q"), F.lower("answer").alias("a"))


@query("f4_enriched", """
, w AS (SELECT *, lead(role) OVER o AS r, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, text AS q, answer AS a FROM w WHERE role = 'user' AND r = 'assistant'),
c AS (SELECT DISTINCT conv_id FROM conversations), h AS (SELECT conv_id, i AS turn, 'Q' || i AS q, 'A' || i AS a FROM c, range(0, 3) r(i) WHERE i < conv_id % 4),
u AS (SELECT *, 0 AS rank FROM h UNION ALL SELECT *, 1 FROM p WHERE conv_id % 4 < 2), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(q), lower(a) ORDER BY rank, turn) AS n FROM u)
SELECT conv_id, coalesce(count(q), 0) AS n, coalesce(string_agg(q || '=' || a, '|' ORDER BY rank, turn), '') AS faqs FROM c LEFT JOIN (SELECT * FROM o WHERE n = 1 OR conv_id % 4 > 1) USING (conv_id) GROUP BY 1""")
def f4_enriched(t: Tables) -> DataFrame:
    """Records with none to three questions by rule; those with fewer than two get the ones of their conversation."""
    had = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("conv_id") % 4), lambda i: F.struct(F.concat(F.lit("Q"), i.cast("string")).alias("question"), F.concat(F.lit("A"), i.cast("string")).alias("answer")))
    records = t.read("conversations").select("conv_id").distinct().withColumn("present", had)
    out = H.enriched(records, f2(t).withColumnRenamed("turn", "place"), "conv_id", "present")
    return out.select("conv_id", F.size("faqs").cast("long").alias("n"), F.array_join(F.transform("faqs", lambda x: F.concat_ws("=", x["question"], x["answer"])), "|").alias("faqs"))


@query("f1_blocks", ANCHORS + FRAGMENTS + "SELECT page_id, kind, string_agg(body, ' | ') AS blocks FROM fragments WHERE kind IN ('list', 'footer') GROUP BY ALL")
def f1(t: Tables) -> DataFrame:
    return H.blocks(fragments(t, "list", "footer"), ("list", "footer")).select("page_id", "kind", F.array_join("bodies", " | ").alias("blocks"))


@query("f5_policy_texts", WORDED + "SELECT doc_id FROM w WHERE regexp_matches(lower(text), 'policy|policies|term|rule|cancellation|refund')")
def f5(t: Tables) -> DataFrame:
    return worded(t).filter(H.is_policy(F.col("text"))).select("doc_id")


SNIPPETS = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS key, regexp_extract(lower(text), '{p}', 0) AS m FROM w" for p, k in H.POLICIES)


@query("f6_policy_snippets", WORDED + f"""
, m AS ({SNIPPETS}), a AS (SELECT *, strpos(lower(text), m) AS pos, length(m) AS n FROM m)
SELECT doc_id, key, CASE WHEN m <> '' THEN regexp_replace(substr(text, greatest(1, pos - 120), pos + n + 240 - greatest(1, pos - 120)), '^\\s+|\\s+$', '', 'g') ELSE '' END AS value FROM a
UNION ALL SELECT doc_id, 'other_policies', '' FROM w""")
def f6(t: Tables) -> DataFrame:
    return H.policies(worded(t), ["doc_id"], "text")


@query("f7_policy_keys", WORDED + "SELECT doc_id, 12 AS keys, 1" + "".join(f" + regexp_matches(lower(text), '{p}')::INT" for p, _ in H.POLICIES) + " AS filled FROM w")
def f7(t: Tables) -> DataFrame:
    """All twelve keys for each text; what the record has already stays."""
    d = worded(t).withColumn("old", F.create_map(F.lit("other_policies"), F.lit("as agreed")))
    p = H.policies(d, ["doc_id"], "text", "old")
    return p.groupBy("doc_id").agg(F.count_distinct("key").cast("int").alias("keys"), F.count_if(F.col("value") != "").cast("int").alias("filled"))


@query("f8_sparse", "SELECT doc_id, ((length(text) > 50)::INT + (lang = 'en')::INT + (n_chars > 1000)::INT) AS points, ((length(text) > 50)::INT + (lang = 'en')::INT + (n_chars > 1000)::INT) <= 2 AS sparse FROM documents")
def f8(t: Tables) -> DataFrame:
    p = H.sparseness(F.length("text") > 50, F.col("lang") == "en", F.col("n_chars") > 1000)
    return t.read("documents").select("doc_id", p.alias("points"), (p <= 2).alias("sparse"))
