"""Running values in blocks, the keyed table, references, the crawl frontier and dependency levels."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hearthline.operators import compare as K
from hearthline.operators import links as L
from hearthline.operators.scan import levels, running
from hearthline.sources.snapshot import written
from hearthline.streaming import keyed


def test_running_values_of_one_key_in_many_blocks(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, *range(50)]), i, r.choice([None, r.randrange(1000)])) for i, k in enumerate(["one"] * 1500 + ["two", None, ""] * 40)]
    d = spark.createDataFrame(rows, "k string, day int, id int, v int").withColumn("at", F.timestamp_seconds(F.col("day") * 86_400 + F.col("id") % 7))
    got = running(d, ["k"], "at", ["id"], {n: (n, F.col("v")) for n in ("sum", "count", "max", "min")})
    want, seen = {}, defaultdict(list)
    for k, day, i, v in sorted(rows, key=lambda x: (x[1] is not None, (x[1] or 0) * 86_400 + x[2] % 7 if x[1] is not None else 0, x[2])):
        if v is not None:
            seen[k].append(v)
        s = seen[k]
        want[i] = (sum(s) if s else None, len(s), max(s, default=None), min(s, default=None))
    assert {x.id: (x["sum"], x["count"], x["max"], x["min"]) for x in got.collect()} == want
    assert got.columns == [*d.columns, "sum", "count", "max", "min"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window " in x]
    assert len(windows) >= 4 and all("__upper" in x or "__block" in x for x in windows)
    assert running(d.filter("false"), ["k"], "at", ["id"], {"s": ("sum", F.col("v"))}).count() == 0


def test_running_values_before_1970_and_in_small_blocks(spark):
    d = spark.createDataFrame([(i, -(10**9) + 7 * i) for i in range(300)], "id int, s long").withColumn("at", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    got = running(d, ["k"], "at", [], {"n": ("count", F.col("id"))}, block=60)
    assert {r.id: r.n for r in got.collect()} == {i: i + 1 for i in range(300)}


def state(spark, path, schema):
    return {r.k: r.v for r in keyed.latest(spark, path, "k", ["at"], schema).collect()}


def files(path):
    return {os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet") and "versions" not in d}


def test_keyed_table(spark, tmp_path):
    schema, path = "k long, at long, v string", f"{tmp_path}/t"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    put = keyed.upsert(path, "k", ["at"], buckets=4, deltas=2)
    bucket = {r.k: r.b for r in spark.range(200).selectExpr("id AS k", "CAST(pmod(xxhash64(id), 4) AS INT) AS b").collect()}
    here, there = [k for k in bucket if bucket[k] == 0], [k for k in bucket if bucket[k] == 1]
    put(batch([(k, 1, "a") for k in here]), 0)
    before = files(path)
    put(batch([(k, 1, "b") for k in there]), 1)  # other keys: the files of the first stay
    assert before <= files(path) and state(spark, path, schema) == {**dict.fromkeys(here, "a"), **dict.fromkeys(there, "b")}
    put(batch([(k, 1, "b") for k in there]), 1)  # again
    assert state(spark, path, schema) == {**dict.fromkeys(here, "a"), **dict.fromkeys(there, "b")}
    put(batch([(here[0], 0, "old"), (here[1], 2, "new"), (here[1], 3, "newer")]), 2)
    put(batch([(here[2], 2, "c")]), 5)  # third delta of the bucket: merged
    assert set(keyed.folders(spark, path)) == {0, 1} and keyed.folders(spark, path)[0] == [f"{path}/base=5/bucket=0"] and len(keyed.folders(spark, path)[1]) == 1
    want = {**dict.fromkeys(here, "a"), **dict.fromkeys(there, "b"), here[1]: "newer", here[2]: "c"}
    assert state(spark, path, schema) == want
    put(batch([]), 6)
    put(batch([(here[2], 2, "c")]), 5)  # a late repeat gives what it gave
    assert state(spark, path, schema) == want
    keyed.vacuum(spark, path, keep=1)
    assert state(spark, path, schema) == want and not any("delta=0" in f for f in files(path)) and any("delta=1" in f for f in files(path))
    assert keyed.latest(spark, f"{tmp_path}/none", "k", ["at"], schema).count() == 0


# the examples of RFC 3986, 5.4.1 and 5.4.2 (strict)
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references(spark):
    d = spark.createDataFrame(list(RFC.items()), "href string, want string").withColumn("base", F.lit("http://a/b/c/d;p?q"))
    assert d.withColumn("got", L.join_url(F.col("base"), F.col("href"))).filter("NOT got <=> want").collect() == []
    more = [("http://a.com/x/y/z.html", "../q", "http://a.com/x/q"), ("http://a.com/x/y/z.html", "./q", "http://a.com/x/y/q"), ("http://a.com/x/y/z.html", "?p=2", "http://a.com/x/y/z.html?p=2"), ("http://a.com", "q", "http://a.com/q"), ("http://a.com", "?x", "http://a.com?x"), ("http://a.com#f", "", "http://a.com")]
    assert spark.createDataFrame(more, "base string, href string, want string").withColumn("got", L.join_url(F.col("base"), F.col("href"))).filter("NOT got <=> want").collect() == []


def test_base_tag(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/y", '<base target="t" href="/docs/v1/"><a href="p">P</a><a href="../q">Q</a><a href="//h/r">R</a>'), (2, "http://a.com/x/y", '<a href="p">P</a>')], "page_id long, url string, html string")
    assert [(r.page_id, r.target) for r in L.anchors(pages).orderBy("page_id", "pos").collect()] == [(1, "http://a.com/docs/v1/p"), (1, "http://a.com/docs/q"), (1, "http://h/r"), (2, "http://a.com/x/p")]


def crawl(links, seeds, depth, pages, per_page):
    best, out = defaultdict(dict), {}
    for src, dst, score, pos in sorted(links, key=lambda x: x[3]):
        best[src].setdefault(dst, (score, pos))
    follow = {s: sorted(d, key=lambda x: (-d[x][0], d[x][1]))[:per_page] for s, d in best.items()}
    for site in {s for s, _ in seeds}:
        seen = {u: 0 for u in sorted({u for s, u in seeds if s == site})[:pages]}
        new = list(seen)
        for level in range(1, depth + 1):
            found = defaultdict(int)
            for u in new:
                for v in follow.get(u, ()):
                    if v not in seen:
                        found[v] = max(found.get(v, -(10**9)), best[u][v][0])
            new = sorted(found, key=lambda v: (-found[v], v))[: pages - len(seen)]
            seen |= dict.fromkeys(new, level)
        out |= {(site, u): n for u, n in seen.items()}
    return out


@pytest.mark.parametrize("depth, pages, per_page", [(3, 12, 3), (1, 100, 2), (4, 100, 100), (2, 2, 1)])
def test_frontier(spark, depth, pages, per_page):
    r = random.Random(depth)
    links = [(f"s{s}/{r.randrange(40)}", f"s{s}/{r.randrange(40)}", r.randrange(6), i) for i in range(400) for s in range(3)]
    seeds = [(f"s{s}", f"s{s}/{i}") for s in range(3) for i in (0, 1, 0)]
    got = L.frontier(spark.createDataFrame(links, "src string, dst string, score int, pos int"), spark.createDataFrame(seeds, "site string, url string"), depth, pages, per_page).collect()
    assert {(x.site, x.url): x.level for x in got} == crawl(links, seeds, depth, pages, per_page) and len(got) == len({(x.site, x.url) for x in got})


def test_dependency_levels(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "a"), ("f", "e"), ("f", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("f", "gone"), ("d", "b")]
    nodes = [(n,) for n in "abcdefxyzwi"]
    got = levels(spark.createDataFrame(nodes, "node string"), spark.createDataFrame(edges, "node string, needs string"), lambda d: written(d, "levels")).collect()
    assert {r.node: r.level for r in got} == {"a": 0, "e": 0, "i": 0, "b": 1, "c": 1, "d": 2, "f": 3, "x": None, "y": None, "z": None, "w": None}


def test_sides_of_pairs_from_one_join_and_one_aggregation(spark):
    r = random.Random(9)
    have = {(p, n): (r.choice([None, 1.5, 2.0]), [n, p] if r.random() < 0.5 else None) for p in range(12) for n in "abcdefgh" if r.random() < 0.5}
    c = spark.createDataFrame([(p, n, *v) for (p, n), v in have.items()], "property_id int, name string, price double, keys array<string>")
    pairs = [(a, b) for a in range(14) for b in range(14) if a != b and r.random() < 0.3]
    got = K.side_by_side(c, spark.createDataFrame(pairs, "ours int, theirs int"), "name", ["price", "keys"])
    want = {(a, b, n): (have.get((a, n)), have.get((b, n))) for a, b in pairs for n in "abcdefgh" if (a, n) in have or (b, n) in have}
    plain = lambda v: (None, None) if v is None else (v[0], None if v[1] is None else [str(x) for x in v[1]])
    assert {(x.ours, x.theirs, x.name): ((x.our_price, x.our_keys), (x.their_price, x.their_keys), x.in_ours, x.in_theirs) for x in got.collect()} == {k: (plain(a), plain(b), a is not None, b is not None) for k, (a, b) in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "FullOuter" not in plan
    assert K.side_by_side(c.filter("false"), spark.createDataFrame(pairs, "ours int, theirs int"), "name", ["price"]).count() == 0


def test_sides_of_pairs_in_blocks_move_a_listing_once_a_block(spark):
    r = random.Random(10)
    have = {(p, n): (r.choice([None, 1.5, 2.0]), [n, str(p)] if r.random() < 0.5 else None) for p in range(200) for n in [*"abcdef", None] if r.random() < 0.5}
    c = spark.createDataFrame([(p, n, *v) for (p, n), v in have.items()], "property_id int, name string, price double, keys array<string>")
    near = K.neighbours(spark.createDataFrame([(p, "x" if p % 3 else "y") for p in range(201)], "property_id int, region string")).cache()
    plain = near.select("ours", "theirs")
    assert plain.count() == 1005 and near.select("block").distinct().count() == 8
    rows = lambda d: sorted(map(str, d.select("ours", "theirs", "name", "our_price", "our_keys", "their_price", "their_keys", "in_ours", "in_theirs").collect()))
    got = K.side_by_side(c, near, "name", ["price", "keys"], 3)
    assert rows(got) == rows(K.side_by_side(c, plain, "name", ["price", "keys"])) == rows(K.side_by_side(c, near, "name", ["price", "keys"]))
    of = near.select("block", F.explode(F.array("ours", "theirs")).alias("p")).distinct().count()
    assert of < 201 * 1.25  # rows of a listing travel this many times, not ten


def test_tasks_grow_with_the_table(spark, monkeypatch):
    from hearthline import catalog
    from hearthline.plans import tables

    run = lambda: catalog.QUERIES["q5_merge_quality"](spark, "/root/testdata/sf0.001")
    few = run()
    monkeypatch.setattr(tables, "PART_BYTES", 2000)
    many = run()
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString() and many._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    assert sorted(few.collect()) == sorted(many.collect())
