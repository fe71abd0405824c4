"""Queries of pages, fragments, links and contexts (S1, X, L, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import context as C
from ..operators import fragments as X
from ..operators import links as L
from .registry import query
from .tables import Tables

NORM = "lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''))"
HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
PATTERN = L.ANCHOR.replace("'", "''")
UNESCAPED = "replace(replace(replace(replace(replace(@@, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
ANCHORS = f"""
, m0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{PATTERN}', 0)) AS m, unnest(range(len(regexp_extract_all(html, '{PATTERN}', 0)))) AS pos FROM pages),
a0 AS (SELECT page_id, url, pos, {UNESCAPED.replace('@@', f"regexp_extract(m, '{PATTERN}', 1) || regexp_extract(m, '{PATTERN}', 2) || regexp_extract(m, '{PATTERN}', 3)")} AS href,
  {UNESCAPED.replace('@@', f"trim(regexp_replace(regexp_replace(regexp_extract(m, '{PATTERN}', 4), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")} AS anchor FROM m0),
anchors AS (SELECT page_id, url, pos, href, anchor, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href ELSE href END AS target FROM a0)
"""


@query("s1_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def s1(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("l1_normalize_url", f"SELECT page_id, {NORM} AS norm_url FROM pages")
def l1(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", L.normalize_url(F.col("url")).alias("norm_url"))


@query("l2_same_domain", ANCHORS + f"SELECT page_id, pos, target, regexp_extract(target, '^[A-Za-z]+://([^/?#]*)', 1) = {HOST} AS same FROM anchors")
def l2(t: Tables) -> DataFrame:
    return L.anchors(t.read("pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "target", L.same_domain(F.col("url"), F.col("target")).alias("same"))


@query("l3_allowed_domain", f"SELECT page_id, {HOST} LIKE '%example.com' AS allowed FROM pages")
def l3(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", L.allowed_domain(F.lit("http://a.test/"), F.col("url"), ["example.com"]).alias("allowed"))


@query("l4_anchors", ANCHORS + "SELECT page_id, pos, href, anchor, target FROM anchors")
def l4(t: Tables) -> DataFrame:
    return L.anchors(t.read("pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "anchor", "target")


@query("l5_allowed_links", ANCHORS + " UNION ALL ".join(f"SELECT {n} AS node, page_id, pos FROM anchors WHERE regexp_matches(lower(target), '{'|'.join(p)}') OR regexp_matches(lower(anchor), '{'|'.join(p)}')" for n, p in L.ALLOWED.items()))
def l5(t: Tables) -> DataFrame:
    """Links that a node follows: its address or anchor matches one of the node's patterns."""
    fits = F.array(*(F.when(L.matches_any(F.col("target"), p) | L.matches_any(F.col("anchor"), p), n) for n, p in L.ALLOWED.items()))
    a = L.anchors(t.read("pages")).select("page_id", F.col("pos").cast("long").alias("pos"), F.explode(F.filter(fits, lambda x: x.isNotNull())).alias("node"))
    return a.select("node", "page_id", "pos")


def _sum(column: str, words: dict, halves: bool) -> str:
    return " + ".join(f"regexp_matches({column}, '\\b{w}\\b')::INT * {n // 2 if halves else n}" for w, n in words.items())


EVERY = {**L.CONFIGURATION_WORDS, **L.TENANCY_WORDS}
LIKE = lambda words: "(" + " OR ".join(f"contains(p, '{w}')" for w in words) + ")"
SCORED = ANCHORS + f"""
, p AS (SELECT *, lower(regexp_extract(target, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS p, lower(anchor) AS al FROM anchors),
q AS (SELECT *, len(list_filter(string_split(p, '/'), lambda s: s <> '')) AS depth FROM p),
scored AS (SELECT *, ({_sum('p', EVERY, False)} + {_sum('al', EVERY, True)} + {' + '.join(f"regexp_matches(lower(target), '{w}')::INT * 4 + regexp_matches(al, '{w}')::INT * 3" for w in L.ALLOWED[3])}
  + CASE WHEN depth BETWEEN 1 AND 3 THEN 4 WHEN depth > 3 THEN -least(depth - 3, 4) ELSE 0 END + {' + '.join(f'({LIKE(a)} AND {LIKE(b)})::INT * {n}' for a, b, n in L.PAIRED_WORDS)})::INT AS score FROM q)
"""


def scored(t: Tables) -> DataFrame:
    return L.anchors(t.read("pages")).withColumn("score", L.score(F.col("target"), F.col("anchor"), L.ALLOWED[3]))


@query("l6_link_score", SCORED + "SELECT page_id, pos, score FROM scored")
def l6(t: Tables) -> DataFrame:
    return scored(t).select("page_id", F.col("pos").cast("long").alias("pos"), "score")


@query("l7_best_links", SCORED + """
, o AS (SELECT page_id, target, min(pos) AS pos, arg_min(score, pos) AS score FROM scored GROUP BY ALL)
SELECT page_id, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::INT AS rank FROM o) WHERE rank <= 4""")
def l7(t: Tables) -> DataFrame:
    return L.best_links(scored(t), 4).select("page_id", "target", "rank")


SITES = f"""
, pg AS (SELECT page_id, {HOST} AS site, {NORM} AS u FROM pages),
o AS (SELECT page_id, {NORM} AS src, {NORM.replace('url', 'target')} AS dst, pos, score FROM scored WHERE regexp_extract(target, '^[A-Za-z]+://([^/?#]*)', 1) = {HOST}),
d AS (SELECT src, dst, min(pos) AS pos, arg_min(score, pos) AS score FROM o GROUP BY ALL), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, pos) <= 4)
"""


@query("l8_frontier", SCORED + SITES + """
, s0 AS (SELECT site, u FROM (SELECT DISTINCT site, u FROM pg WHERE page_id % 5 = 0) QUALIFY row_number() OVER (PARTITION BY site ORDER BY u) <= 12),
c1 AS (SELECT site, dst AS u, max(score) AS score FROM k JOIN s0 ON src = s0.u WHERE (site, dst) NOT IN (SELECT (site, u) FROM s0) GROUP BY ALL),
s1 AS (SELECT site, u FROM c1 QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, u) <= 12 - (SELECT count(*) FROM s0 WHERE s0.site = c1.site)),
c2 AS (SELECT site, dst AS u, max(score) AS score FROM k JOIN s1 ON src = s1.u WHERE (site, dst) NOT IN (SELECT (site, u) FROM s0 UNION ALL SELECT (site, u) FROM s1) GROUP BY ALL),
s2 AS (SELECT site, u FROM c2 QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, u) <= 12 - (SELECT count(*) FROM s0 WHERE s0.site = c2.site) - (SELECT count(*) FROM s1 WHERE s1.site = c2.site))
SELECT site, u AS url, 0 AS level FROM s0 UNION ALL SELECT site, u, 1 FROM s1 UNION ALL SELECT site, u, 2 FROM s2""")
def l8(t: Tables) -> DataFrame:
    """Two steps from every fifth page over the four best links of each page within its site, twelve pages a site."""
    own = scored(t).filter(L.same_domain(F.col("url"), F.col("target")))
    links = own.select(L.normalize_url(F.col("url")).alias("src"), L.normalize_url(F.col("target")).alias("dst"), "score", "pos")
    seeds = t.read("pages").filter("page_id % 5 = 0").select(L.host(F.col("url")).alias("site"), L.normalize_url(F.col("url")).alias("url"))
    return L.frontier(links, seeds, depth=2, pages=12, links_a_page=4)


REFERENCES = ("../x", "./y/", "?p=2", "#z", "//h.test/q", "/a/./b/../c", "g;x=1/../y", "", "../../../up", "mailto:a@b")


@query("l4_references", f"""
, b AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+):', 1) AS s, {HOST} AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '([?][^#]*)', 1) AS q FROM pages),
f AS (SELECT *, s || '://' || h AS root, regexp_replace(p, '[^/]*$', '') AS folder FROM b)
SELECT page_id, unnest({list(REFERENCES)}) AS href, unnest([root || regexp_replace(folder, '[^/]+/$', '') || 'x', root || folder || 'y/', root || p || '?p=2', root || p || q || '#z', s || '://h.test/q', root || '/a/c', root || folder || 'y', root || p || q, root || '/up', 'mailto:a@b']) AS target FROM f""")
def l4_references(t: Tables) -> DataFrame:
    """What references of all forms mean on each page."""
    d = t.read("pages").select("page_id", "url", F.explode(F.array(*map(F.lit, REFERENCES))).alias("href"))
    return d.select("page_id", "href", L.join_url(F.col("url"), F.col("href")).alias("target"))


@query("l9_first_pages", f"SELECT {NORM} AS norm_url, min(page_id) AS page_id FROM pages GROUP BY 1")
def l9(t: Tables) -> DataFrame:
    return L.first_pages(t.read("pages").select("page_id", "url")).select("norm_url", "page_id")


@query("l10_link_inventory", ANCHORS + """
, o AS (SELECT page_id, target, min(pos) AS pos FROM anchors GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM o)
SELECT page_id, count(*) AS links, string_agg(target, ' ' ORDER BY pos) AS inventory FROM r WHERE n <= 50 GROUP BY 1""")
def l10(t: Tables) -> DataFrame:
    a = L.anchors(t.read("pages")).filter(L.same_domain(F.col("url"), F.col("target"))).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    r = a.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter("n <= 50")
    return r.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]), " ").alias("inventory"))


@query("l11_budgets", ANCHORS + """
, b AS (SELECT page_id, pos % 4 + 1 AS node FROM anchors), n AS (SELECT page_id, node, count(*) AS n FROM b GROUP BY ALL)
SELECT node, sum(least(n, CASE WHEN node < 3 THEN 10 ELSE 15 END))::BIGINT AS followed FROM n GROUP BY 1""")
def l11(t: Tables) -> DataFrame:
    """Links followed under each node's budget, here with every fourth link of a page for a node."""
    b = t.spark.createDataFrame([(k, *v) for k, v in L.BUDGETS.items()], "node int, depth int, links int, pages int, signs int")
    n = L.anchors(t.read("pages")).groupBy("page_id", (F.col("pos") % 4 + 1).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(b), "node").groupBy("node").agg(F.sum(F.least(F.col("n"), F.col("links"))).alias("followed"))


@query("n12_display_names", f"""
, h AS (SELECT page_id, regexp_replace(lower({HOST}), '^www\\.', '') AS h FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(replace(replace(h, '.com', ''), '.co.uk', ''), '.'), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: upper(v[1]) || v[2:]), '-')), '.') AS name FROM h""")
def n12(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", L.display_name(F.col("url")).alias("name"))


TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>', ' ', 'gs'), '<style>.*?</style>', ' ', 'gs'), '<nav>.*?</nav>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("x23_visible_text", f"SELECT page_id, {TEXT} AS text FROM pages")
def x23(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", X.visible_text(F.col("html")).alias("text"))


# the text of a piece of a page: no tags, entities as signs, white space as one space
def plain(c: str) -> str:
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def inner(begin: str, end: str) -> str:
    return plain(f"regexp_replace(regexp_extract(html, '{begin}(.*?){end}', 1, 's'), '<[^>]*>', ' ', 'g')")


FRAGMENTS = f"""
, words AS (SELECT page_id, {plain("string_agg(anchor, ' ' ORDER BY pos)")} AS items FROM anchors GROUP BY 1),
pieces AS (SELECT page_id, {inner('<title>', '</title>')} AS title, {inner('<h1>', '</h1>')} AS h1, {inner('</h1>', '<footer>')} AS body, {inner('<article>', '</article>')} AS article, {inner('<footer>', '</footer>')} AS footer FROM pages),
fragments AS (SELECT page_id, 'title' AS kind, '' AS label, title AS body FROM pieces UNION ALL SELECT page_id, 'heading', 'h1', h1 FROM pieces
UNION ALL SELECT page_id, 'heading_section', h1, body FROM pieces WHERE length(body) > 80 UNION ALL SELECT page_id, 'section', 'article', article FROM pieces WHERE length(article) > 100
UNION ALL SELECT page_id, 'footer', '', footer FROM pieces WHERE length(footer) > 50
UNION ALL SELECT page_id, 'list', CASE WHEN regexp_matches(lower(items), 'feature|amenity|facility|included') THEN 'features' WHEN regexp_matches(lower(items), 'rule|policy|term|condition') THEN 'rules'
  WHEN regexp_matches(lower(items), 'contact|phone|email|address') THEN 'contact' ELSE 'general' END, items FROM words)
"""


def fragments(t: Tables, *kinds: str) -> DataFrame:
    """Fragments of the given kinds, their bodies on one line."""
    return X.extract(t.read("pages"), *kinds).withColumn("body", F.regexp_replace("body", r"\s+", " "))


@query("x26_api_urls", rf"""
, d AS (SELECT page_id, url, html || '<script>get("/api/rooms/' || page_id || '"); get(''/API/rooms/' || page_id || '?x=1''); get("/wp-json/a?b"); get("/plain"); get("https://' || {HOST} || '/data.json"); get("https://other.example/api/x")</script>' AS html FROM pages),
l AS (SELECT page_id, url, list_concat(regexp_extract_all(html, '(https?://[^\s"''<>]+)', 1), list_transform(regexp_extract_all(html, '["''](/[^"''\s<>]+)["'']', 1), lambda p: CASE WHEN p LIKE '//%' THEN 'https:' || p ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || p END)) AS l FROM d),
n AS (SELECT page_id, url, unnest(l) AS target, unnest(range(len(l))) AS pos FROM l),
o AS (SELECT page_id, arg_min(target, pos) AS target, min(pos) AS pos FROM n WHERE regexp_matches(lower(target), '{X.API_WORDS}') AND regexp_extract(target, '^[A-Za-z]+://([^/?#]*)', 1) = {HOST}
  GROUP BY page_id, {NORM.replace('url', 'target')})
SELECT page_id, target, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS n FROM o) WHERE n <= 5""")
def x26(t: Tables) -> DataFrame:
    """Endpoints in pages that got calls of some by rule, as the given ones have none."""
    calls = F.format_string("<script>get(\"/api/rooms/%d\"); get('/API/rooms/%d?x=1'); get(\"/wp-json/a?b\"); get(\"/plain\"); get(\"https://%s/data.json\"); get(\"https://other.example/api/x\")</script>", "page_id", "page_id", L.host(F.col("url")))
    return X.api_urls(t.read("pages").withColumn("html", F.concat("html", calls)))


@query("x_fragment_bodies", ANCHORS + FRAGMENTS + "SELECT * FROM fragments")
def x_bodies(t: Tables) -> DataFrame:
    return fragments(t, "title", "heading", "heading_section", "section", "footer", "list").select("page_id", "kind", "label", "body")


@query("x_fragment_kinds", ANCHORS + FRAGMENTS + "SELECT kind, count(*) AS n FROM fragments GROUP BY 1")
def x_kinds(t: Tables) -> DataFrame:
    return fragments(t, "title", "heading", "heading_section", "section", "footer", "list").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("x14_container_dedup", ANCHORS + "SELECT page_id, count(DISTINCT lower(anchor)) AS n FROM anchors GROUP BY 1")
def x14(t: Tables) -> DataFrame:
    """What has one key once, in order: here a page's anchors by their lower-case text; containers of widgets are in x9_x14_widgets."""
    a = L.anchors(t.read("pages")).withColumn("n", F.row_number().over(Window.partitionBy("page_id", F.lower("anchor")).orderBy("pos"))).filter("n = 1")
    return a.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("x_html_fragments", ANCHORS + FRAGMENTS + "SELECT * FROM fragments WHERE kind IN ('title', 'footer', 'list')")
def x_udtf(t: Tables) -> DataFrame:
    """The same by the table function, in SQL."""
    X.register(t.spark)
    return t.spark.sql("SELECT page_id, kind, label, regexp_replace(body, r'\\s+', ' ') AS body FROM {pages}, LATERAL html_fragments(html) WHERE kind IN ('title', 'footer', 'list')", pages=t.read("pages"))


@query("x_fragments")
def x_all(t: Tables) -> DataFrame:
    """All fragments of all pages; tested against literal pages."""
    return X.extract(t.read("pages")).select("page_id", "seq", "kind", "label", "body")


@query("x18_nav_lists", ANCHORS + FRAGMENTS + "SELECT page_id, label, body AS items FROM fragments WHERE kind = 'list'")
def x18(t: Tables) -> DataFrame:
    return fragments(t, "list").select("page_id", "label", F.col("body").alias("items"))


WIDGETS = (
    '<div class="accordion" id="faq"><h3>Deposit</h3><div class="content">Pay %d</div><h3>Pets</h3><div class="content">None</div></div><div class="accordion" id="faq"><h3>Again</h3><div class="content">Again</div></div>'
    '<div class="room-tabs"><a class="tab-title">Studio</a><div class="tab-body">From %d</div></div><div class="info-tabs"><a class="tab-name">Alone</a></div><div class="popup"><h2>Offer</h2>Only %d</div>'
    '<div class="expand-section"><button>More</button>Text %d</div><div class="gallery-carousel"><div class="slider-item">View %d</div><div class="slider-item">Roof</div><div class="slide-caption">Garden</div></div>'
)


@query("x9_x14_widgets", """
SELECT page_id, unnest(['accordion', 'accordion', 'tab', 'tab', 'modal', 'expandable', 'carousel', 'carousel']) AS kind, unnest(['Deposit', 'Pets', 'Studio', 'Alone', 'Offer', 'More', 'Garden', '']) AS label, unnest([1, 2, 1, 1, NULL, NULL, 1, 2]) AS item,
  unnest(['Pay ' || page_id, 'None', 'From ' || page_id, '', 'Offer Only ' || page_id, 'More Text ' || page_id, 'View ' || page_id, 'Roof']) AS body FROM pages""")
def x9(t: Tables) -> DataFrame:
    """Widgets of pages that got some by rule, as the given ones have none: containers of one id or class count once."""
    d = t.read("pages").withColumn("html", F.concat("html", F.format_string(WIDGETS, *["page_id"] * 5)))
    f = X.extract(d, *X.WIDGETS).filter(F.col("label") != "around")
    return f.select("page_id", "kind", "label", F.try_element_at("attrs", F.lit("item")).cast("int").alias("item"), "body")


@query("x6_x7_type_and_phone", r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'student\s+accommodation') THEN 'Student Accommodation' END AS property_type, nullif(regexp_extract(text, '0[0-9]{1,4}\s*[0-9]{1,4}\s*[0-9]{1,4}', 0), '') AS phone FROM documents""")
def x6(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", X.property_type(F.col("text")).alias("property_type"), X.first_phone(F.col("text")).alias("phone"))


MOST = 4000
MATCHES = lambda words: f"regexp_matches(p, '{'|'.join(words)}')"
CATEGORY = "CASE " + " ".join(f"WHEN {MATCHES(w)} THEN " + (f"CASE WHEN {MATCHES(f)} THEN '{s}' ELSE '{p}' END" if f else f"'{p}'") for w, f, s, p in C.RULES) + " ELSE 'general' END"
RANKS = "CASE category " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in C.CATEGORIES.items()) + " END"
SHARES = "CASE category " + " ".join(f"WHEN '{k}' THEN {MOST // v[1]}" for k, v in C.CATEGORIES.items()) + " END"
CATEGORIZED = f", g0 AS (SELECT page_id, url, html, {HOST} AS site, lower(url || CASE WHEN page_id % 3 = 0 THEN '/room-detail' WHEN page_id % 5 = 0 THEN '/price-weekly' WHEN page_id % 7 = 0 THEN '/faq' ELSE '' END) AS p FROM pages), g AS (SELECT *, {CATEGORY} AS category FROM g0)"
PACKED = CATEGORIZED + f"""
, r AS (SELECT *, {TEXT} AS text, page_id = min(page_id) OVER (PARTITION BY site) AS main FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY main DESC, {RANKS}, page_id) AS rank, E'\\n\\n=== ' || CASE WHEN main THEN 'MAIN PAGE' ELSE upper(category) END || ': ' || p || E' ===\\n' AS header, least(length(text), CASE WHEN main THEN {MOST // 4} ELSE {SHARES} END) AS want FROM r),
b AS (SELECT *, coalesce(sum(length(header) + want) OVER (PARTITION BY site ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
packed AS (SELECT *, CASE WHEN main THEN want ELSE greatest(0, least(want, {MOST} - before - length(header))) END::INT AS take FROM b WHERE before < {MOST})
"""


def marked(t: Tables) -> DataFrame:
    """Pages by site with an address that tells a category, made by rule."""
    k = F.col("page_id")
    ending = F.when(k % 3 == 0, "/room-detail").when(k % 5 == 0, "/price-weekly").when(k % 7 == 0, "/faq").otherwise("")
    return t.read("pages").select("page_id", L.host(F.col("url")).alias("site"), F.lower(F.concat("url", ending)).alias("url"), X.visible_text(F.col("html")).alias("text"))


@query("c1_c2_categories", CATEGORIZED + f" SELECT page_id, category, {RANKS} AS priority FROM g")
def c1(t: Tables) -> DataFrame:
    return marked(t).select("page_id", C.category(F.col("url")).alias("category")).withColumn("priority", C.priority(F.col("category")))


@query("c3_c4_packing", PACKED + "SELECT page_id, site, rank::INT AS rank, take FROM packed")
def c4(t: Tables) -> DataFrame:
    return C.budget(marked(t), "site", MOST).select("page_id", "site", "rank", "take")


@query("c5_contexts", PACKED + "SELECT site, string_agg(header || left(text, take), '' ORDER BY rank) AS context FROM packed GROUP BY 1")
def c5(t: Tables) -> DataFrame:
    return C.context(C.pack(marked(t), "site", MOST), "site")


@query("c6_highlight", r"""SELECT doc_id, regexp_replace(text, '((?:password|token|\+1|licen[cs]e)[^\n.!?]*)', '[IMPORTANT] \1 [/IMPORTANT]', 'g') AS text FROM documents""")
def c6(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", C.highlight(F.col("text"), ("password", "token", r"\+1", "licen[cs]e")).alias("text"))
