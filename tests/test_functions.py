"""Expressions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from hearthline.functions import normalize as N
from hearthline.functions import text as T
from hearthline.operators import compare as K
from hearthline.operators import context as C
from hearthline.operators import export as E
from hearthline.operators import hints as H
from hearthline.operators import jobs as J
from hearthline.operators import links as L
from hearthline.operators import merge as M
from hearthline.operators import score as S
from hearthline.operators import validate as V
from hearthline.sources import responses, snapshot


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_currency(spark):
    rows = [("£1,234.50", "per week"), ("$150", "pm"), ("N/A", "week"), ("€", None), (None, "week")]
    got = values(spark, N.currency_amount(F.col("x"), F.col("u")), rows, "x string, u string")
    assert [tuple(g) for g in got] == [(1234.5, "GBP", "PW"), (150.0, "USD", "PM"), (None, None, None), (None, "EUR", None), (None, None, None)]


def test_lengths(spark):
    rows = [(x,) for x in ("44 weeks", "12 months", "1 semester", "2 years", "", "51 w", "2.5 weeks")]
    assert values(spark, N.length_weeks(F.col("x")), rows) == [44, 52, 20, 104, None, 51, 2]
    assert values(spark, N.duration_months(F.col("x")), rows) == [10, 12, None, None, None, None, 1]


def test_prices(spark):
    rows = [("£1,234.50 pw",), ("AUD 900 per month",), ("on request",), ("1 500 total",)]
    assert [tuple(x) for x in values(spark, N.parsed_price(F.col("x")), rows)] == [("GBP", 1234.5), ("AUD", 900.0), ("", None), ("", 1500.0)]
    assert values(spark, N.price_type(F.lit("Per Week"), F.col("x")), rows) == ["per_week"] * 4
    assert values(spark, N.price_type(F.lit(None).cast("string"), F.col("x")), rows) == ["per_week", "per_month", "", "total"]
    weekly, total = N.weekly_and_total(F.col("a"), F.lit("per_week"), F.col("w"))
    assert [tuple(r) for r in spark.createDataFrame([(150.0, 44), (145.0, 51), (100.0, 0)], "a double, w int").select(weekly, total).collect()] == [(150.0, 6600.0), (145.0, 7395.0), (100.0, None)]


def test_text(spark):
    assert values(spark, T.slug(F.col("x")), [("  Unite / Two!",), (None,)]) == ["unite-two", ""]
    assert values(spark, T.sanitize(F.col("x"), 9), [(" a <b>\n 'c'  def ",), (None,)]) == ["a b c def", ""]
    assert values(spark, T.title_case(F.col("x")), [("unite-students",)]) == ["Unite-Students"]
    assert values(spark, T.features_of(F.col("x")), [("wifi, gym;\n pool,",)]) == [["wifi", "gym", "pool"]]


def test_configuration_id(spark):
    df = spark.createDataFrame([("Deluxe Studio / A", "Studio", "12.5 sqm", "20", "Yes"), (None, None, None, None, None)], "n string, u string, a string, z string, d string")
    got = [r[0] for r in df.select(N.configuration_id(*map(F.col, "nuazd"))).collect()]
    assert got == ["deluxe-studio-a-studio-12.5-20sqm-dual", "config"]


def test_validation(spark):
    rows = [("https://a.example/x",), ("ftp://a.example",), ("",), (None,), ("http://localhost",), ("http:///x",)]
    got = values(spark, V.url_error(F.col("x")), rows)
    assert got[0] is None and "protocol" in got[1] and "non-empty" in got[2] and "non-empty" in got[3] and "dot" in got[4] and "valid domain" in got[5]
    assert values(spark, V.is_date(F.col("x")), [(x,) for x in ("2024-01-02", "1/2/2024", "01/02/2024", "3 May 2024", None)]) == [True, False, True, True, False]
    df = spark.createDataFrame([(1, "91", "10"), (2, "nan", ""), (3, "", None), (4, "-90", "180.5")], "id int, lat string, lng string")
    got = {(r.id, r.error) for r in V.location(df, ["id"], "lat", "lng").collect()}
    assert got == {(1, "Latitude must be between -90 and 90"), (2, "Latitude must be a valid number"), (4, "Longitude must be between -180 and 180")}


def test_scores(spark):
    df = spark.createDataFrame([((("x", " "), [1, 0], False),), (((None, None), [], None),)], "d struct<a:struct<n:string,m:string>,l:array<int>,b:boolean>")
    kind = df.schema["d"].dataType
    total, filled = S.counts(F.col("d"), kind)
    # keys a, n, m, l, b and the items of l; 0 and false count as filled
    assert [tuple(r) for r in df.select(total, filled).collect()] == [(7, 6), (5, 2)]
    got = [r[0] for r in df.select(S.completeness(F.col("d"), kind)).collect()]
    assert all(0 <= x <= 1 for x in got)


def test_merge(spark):
    cfg = spark.createDataFrame([(1, "i1", "Studio A", "c1", 1), (1, "i2", "studio-a", "c2", 2), (1, None, "Loft", "c3", 3)], "p int, id string, name string, cfg string, pos int")
    opt = spark.createDataFrame([(1, "i1", "x"), (1, None, "STUDIO A"), (1, "zz", "loft "), (1, None, "none")], "p int, id string, name string")
    got = {(r.id, r.name): (r.cfg, r.matched_by) for r in M.attach(opt, cfg, "id", "name", ["p"]).collect()}
    assert got == {("i1", "x"): ("c1", "id"), (None, "STUDIO A"): ("c2", "name"), ("zz", "loft "): ("c3", "name"), (None, "none"): (None, None)}
    u = M.union_features([opt.select("p", "name"), opt.select("p", F.lower("name").alias("name"))], ["p"], "name")
    again = M.union_features([u.select("p", "name")], ["p"], "name")
    assert sorted(r.name for r in u.collect()) == sorted(r.name for r in again.collect()) == ["STUDIO A", "loft ", "none", "x"]


def test_compare(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    row = spark.range(1).select(K.jaccard(a, b), K.jaccard(b, a), K.jaccard(a, a), K.jaccard(a, F.array().cast("array<string>")), K.deviation(F.lit(3.0), F.lit(2.0)), K.deviation(F.lit(3.0), F.lit(0.0))).first()
    assert tuple(row) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 1.0, None, 50.0, None)
    c = spark.createDataFrame([(1, "a", 10.0, 1, 0.9), (1, "b", 10.0, 1, 0.4), (2, "b", 12.0, 2, 0.9), (2, "c", 5.0, 1, 0.9)], "property_id int, config_name string, price double, options int, quality double")
    t = K.configuration_table(c, spark.createDataFrame([(1, 2)], "ours int, theirs int")).collect()
    assert {(r.config_name, r.diff_pct, r.status) for r in t} == {("a", None, "only in ours"), ("b", 20, "limited data"), ("c", None, "only in theirs")}


def test_context_budget(spark):
    rows = [(i, "s", f"http://s.test/{'room' if i % 2 else 'x'}/{i}", "t" * (50 * i)) for i in range(30)]
    d = C.pack(spark.createDataFrame(rows, "page_id int, site string, url string, text string"), "site", 1000)
    got = {r.page_id: (r.rank, r.take, len(r.header)) for r in d.collect()}
    used, want, shares = 0, {}, {k: 1000 // v[1] for k, v in C.CATEGORIES.items()}
    order = [rows[0], *sorted(rows[1:], key=lambda r: (4 if r[0] % 2 else 99, r[0]))]
    for n, (i, _, url, text) in enumerate(order, 1):  # the same as a loop that stops when the budget is used
        if used >= 1000:
            break
        kind = "room_config" if i % 2 else "general"
        header = f"\n\n=== {'MAIN PAGE' if n == 1 else kind.upper()}: {url} ===\n"
        take = min(len(text), 250) if n == 1 else max(0, min(len(text), shares[kind], 1000 - used - len(header)))
        want[i] = (n, take, len(header))
        used += len(header) + take
    assert got == want
    text = C.context(d, "site").first().context
    assert len(text) == sum(t + h for _, t, h in want.values())


def test_links(spark):
    rows = [("HTTP://A.test/x/?q=1#f",), ("http://a.test/x",)]
    once = values(spark, L.normalize_url(F.col("x")), rows)
    assert once == ["http://a.test/x"] * 2 == values(spark, L.normalize_url(F.col("x")), [(x,) for x in once])
    html = '<a href="/r?x">Room</a><a class="k" href="b">B</a><a href="//c.test/z">C</a><a href="https://d.test">D</a><a href="#t">T</a>'
    got = [r.target for r in L.anchors(spark.createDataFrame([(1, "https://a.test/p/q?s", html)], "page_id int, url string, html string")).orderBy("pos").collect()]
    assert got == ["https://a.test/r?x", "https://a.test/p/b", "https://c.test/z", "https://d.test", "https://a.test/p/q?s#t"]
    s = values(spark, L.score(F.col("x"), F.lit("Room detail"), ()), [("https://a.test/room/detail",), ("https://a.test/a/b/c/d/e",)])
    # room 8 and detail 8 on the path and half on the anchor, depth 4, the pair 8; depth 5 costs 2
    assert s == [8 + 8 + 4 + 4 + 4 + 8, 4 + 4 - 2]
    edges = spark.createDataFrame([("a", "b", 1, 0), ("b", "c", 1, 0), ("c", "a", 1, 0), ("b", "a", 1, 1)], "src string, dst string, score int, pos int")
    assert {(r.url, r.level) for r in L.frontier(edges, spark.createDataFrame([("s", "a")], "site string, url string"), 3, 10, 10).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_hints(spark):
    d = spark.createDataFrame([(1, "s", "A: 1\nA: 2"), (2, "s", "A: 3\nB: x"), (3, "s", None)], "id int, site string, text string")
    assert {(r.k, r.v) for r in H.definitions(d, "site", "id", "text").collect()} == {("a", "2"), ("b", "x")}
    q = spark.createDataFrame([(1, i, x) for i, x in enumerate(("intro", "Q: when?", "A: now", "Where?", "", "here", "Q: none"))], "c int, n int, t string")
    assert [(r.question, r.answer) for r in H.question_pairs(q, ["c"], "n", "t").orderBy("pair").collect()] == [("when?", "now"), ("Where?", "here")]
    p = H.policies(spark.createDataFrame([(1, "No visa no pay. Cooling  off: 7 days")], "id int, t string"), ["id"], "t").collect()
    assert len(p) == 12 and {r.key for r in p if r.value} == {"no_visa_no_pay", "cooling_off_period"}


def test_responses(spark):
    rows = [('x ```json\n{"k": 1}\n``` y',), ('it is {"k": 2} so',), ("none",), (None,), ('{"k": 3',)]
    assert values(spark, responses.parsed(F.col("x"), "k int")["k"], rows) == [1, 2, None, None, None]
    assert values(spark, responses.structure_error(F.col("x")), [('{"a":1}',), ("[1]",), ("{",), (None,), ('{"a":1}}',)]) == [None, "must be a JSON object", "Invalid JSON format", "Invalid JSON format", "Invalid JSON format"]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, [])], "id int, o array<struct<n:string,m:int>>")
    assert sorted(map(tuple, E.flat(d, "o", "t.").collect()), key=str) == [(1, "a", 1), (1, "b", 2), (2, None, None)]
    flat = E.flat(d, "o", "t.").withColumnRenamed("t.n", "n").withColumnRenamed("t.m", "m").withColumn("note", F.lit('say "a, b"'))
    snapshot.write_csv(flat, str(tmp_path / "c"))
    back = snapshot.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["id", "m", "n", "note"] and back.count() == 3 and {r.note for r in back.collect()} == {'say "a, b"'}
    assert snapshot.snapshot(d, str(tmp_path / "j")).schema == d.schema


def test_jobs(spark):
    d = spark.createDataFrame([(i, p, f"2024-01-0{1 + i % 3} 00:00:00") for i, p in enumerate(("low", "urgent", "normal", "urgent", "high"))], "job_id int, priority string, t string").withColumn("created_at", F.to_timestamp("t"))
    assert [r.job_id for r in J.queue(d).orderBy("position").collect()] == [3, 1, 4, 2, 0]
    assert [r.delay_s for r in J.retry_delays(spark.range(1), 5, 30, 300).orderBy("attempt").collect()] == [30.0, 60.0, 120.0, 240.0, 300.0]
