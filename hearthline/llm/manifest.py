"""Merkle manifest of a table: leaves by document, subroots by source, one root.

The place of a leaf among those of its source is a rank query. The doc_ids of a source are bits of 64-bit words, which
tasks merge with OR; 64 words make a container that keeps only its words with a bit and the rows before each of them. A
directory sums containers by 4096, and those by 4096, up to the whole range of ids. Rank is directory plus container plus
the bits below, so nothing is sorted. Nodes then meet in arrays of SPAN slots, keyed by source and place, each of which
is reduced over several levels at once; its top is a node of the next array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table, written

ARITY, LEVELS = 3, 6  # children of a node; levels that an array of slots is reduced by
SPAN = ARITY**LEVELS
FAN = 12  # bits of a place in each level of the directory
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<before:string,after:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def encoded(x: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes of the value, ``:`` and the value."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _leaf(**changed: Column) -> Column:
    return digest(F.concat(*(encoded(changed.get(c, F.col(c))) for c in FIELDS)))


def leaves(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """g (the source, such that null comes first in order), doc_id, leaf and tampered (the leaf with that text; null for none)."""
    group = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    tampered = F.lit(None).cast("string") if tampered_text is None else F.when(tampered_text.isNotNull(), _leaf(text=tampered_text))
    return docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), _leaf().alias("leaf"), tampered.alias("tampered"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _below(word: Column, i: Column) -> Column:
    """How many bits of ``word`` stand below place ``i``."""
    return F.bit_count(word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), i.cast("int")))))


def containers(rows: DataFrame) -> DataFrame:
    """One row for each source and 4096 neighbouring doc_ids of which one is there: g, chunk, before (rows of smaller chunks of the
    source), mask (of the words that have bits), words (w, word, n, more: repeated ids) and counts (rows before each word)."""
    words = rows.filter("doc_id IS NOT NULL").groupBy("g", F.shiftright("doc_id", 6).alias("hi")).agg(F.bit_or(_bit(F.col("doc_id").bitwiseAND(F.lit(63)))).alias("word"), F.count(F.lit(1)).alias("n"))
    words = written(words, "words")
    more = "array<struct<i:int,more:bigint>>"
    if words.filter(F.col("n") > F.bit_count("word")).isEmpty():
        words = words.withColumn("more", F.lit(None).cast(more))
    else:
        of_words = words.filter(F.col("n") > F.bit_count("word")).select("g", "hi")
        ids = rows.withColumn("hi", F.shiftright("doc_id", 6)).join(of_words, ["g", "hi"], "left_semi").groupBy("g", "hi", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        each = F.struct(F.col("doc_id").bitwiseAND(F.lit(63)).cast("int").alias("i"), (F.col("n") - 1).alias("more"))
        words = words.join(ids.groupBy("g", "hi").agg(F.collect_list(each).cast(more).alias("more")), ["g", "hi"], "left")  # 64 at most
    item = F.struct(F.col("hi").bitwiseAND(F.lit(63)).cast("int").alias("w"), "word", "n", "more")
    c = words.groupBy("g", F.shiftright("hi", 6).alias("chunk")).agg(F.bit_or(_bit(F.col("hi").bitwiseAND(F.lit(63)))).alias("mask"), F.sum("n").alias("n"), F.array_sort(F.collect_list(item)).alias("words"))
    c = c.withColumn("counts", F.expr("transform(words, (x, i) -> aggregate(slice(words, 1, i), 0L, (a, y) -> a + y.n))"))
    return _directory(written(c, "containers"))


def _directory(c: DataFrame) -> DataFrame:
    """``c`` with before: at each level, what stands before a place among its 4096 neighbours, so that no window is larger."""
    lift = 1 << 51  # brings chunks of negative ids to 0 and above
    ends = c.agg(F.min("chunk"), F.max("chunk")).first()
    if ends[0] is None:
        return c.withColumn("before", F.lit(0).cast("long"))
    low, high = ends[0] + lift, ends[1] + lift
    c = c.withColumn("chunk", F.col("chunk") + lift)
    shift, level, found = 0, c.select("g", "chunk", "n"), c.withColumn("before", F.lit(0).cast("long")).drop("n")
    while True:
        upper = (F.shiftright("chunk", FAN)).alias("upper")
        run = Window.partitionBy("g", "upper").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        own = level.select("g", "chunk", upper, "n").withColumn("own", F.coalesce(F.sum("n").over(run), F.lit(0))).select("g", F.col("chunk").alias("at"), "own")
        found = found.withColumn("at", F.shiftright("chunk", shift)).join(own, ["g", "at"]).withColumn("before", F.col("before") + F.col("own")).drop("at", "own")
        shift += FAN
        if low >> shift == high >> shift:
            return written(found.withColumn("chunk", F.col("chunk") - lift), "directory")
        level = written(level.groupBy("g", F.shiftright("chunk", FAN).alias("chunk")).agg(F.sum("n").alias("n")), "level")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (see ``leaves``) with place, from 0 within the source by doc_id; null ids first, equal ids by leaf."""
    nulls = rows.filter("doc_id IS NULL").groupBy("g").agg(F.count(F.lit(1)).alias("nulls"))
    c = containers(rows).join(nulls, "g", "left").withColumn("before", F.col("before") + F.coalesce("nulls", F.lit(0))).drop("nulls")
    low = F.col("doc_id").bitwiseAND(F.lit(63))
    d = rows.filter("doc_id IS NOT NULL").withColumn("chunk", F.shiftright("doc_id", 12)).join(c, ["g", "chunk"])
    w = F.shiftright("doc_id", 6).bitwiseAND(F.lit(63))
    d = d.withColumn("at", (_below(F.col("mask"), w) + 1).cast("int")).withColumn("x", F.element_at("words", F.col("at"))).withColumn("i", low.cast("int"))
    repeats = F.expr("coalesce(aggregate(filter(x.more, y -> y.i < i), 0L, (a, y) -> a + y.more), 0L)")
    d = d.withColumn("place", F.col("before") + F.element_at("counts", F.col("at")) + _below(F.col("x.word"), low) + repeats)
    d = d.withColumn("again", F.expr("coalesce(exists(x.more, y -> y.i = i), false)")).select("g", "doc_id", "leaf", "tampered", "place", "again")
    nulls_first = rows.filter("doc_id IS NULL").select("g", "doc_id", "leaf", "tampered", F.lit(0).cast("long").alias("place"), F.lit(True).alias("again"))
    placed = written(d.unionByName(nulls_first), "placed")
    once = placed.filter("NOT again").drop("again")
    if placed.filter("again").isEmpty():
        return once
    return once.unionByName(_among_equals(placed.filter("again").drop("again")))


def _among_equals(rows: DataFrame) -> DataFrame:
    """Rows that share source and doc_id get places one after another, by leaf. Equal rows are counted and dealt out again, and the
    others are ranked within the first 16 bits of their leaf, so that one doc_id of any share of the rows is many small groups."""
    key = ["g", "place"]
    one = rows.groupBy(*key, "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n")).withColumn("head", F.substring("leaf", 1, 4))
    one = written(one, "equals")
    heads = one.groupBy(*key, "head").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(*key, "head", before.alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = one.withColumn("inside", inside).join(heads, [*key, "head"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return dealt.select("g", "doc_id", "leaf", "tampered", (F.col("place") + F.col("before") + F.col("inside") + F.col("copy")).alias("place"))


def _depth(n: Column) -> Column:
    """Levels until one node is left of ``n``, LEVELS at most."""
    return sum(((n > ARITY**i).cast("int") for i in range(LEVELS)), F.lit(0))


def _levels(nodes: Column, depth: Column) -> Column:
    """All levels over the nodes of an array: itself first, up to ``depth`` levels higher."""
    up = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / ARITY).cast("int")), lambda i: digest(F.array_join(F.slice(x, i * ARITY + 1, ARITY), "")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.array(nodes), lambda acc, i: F.when(i < depth, F.concat(acc, F.array(up(F.element_at(acc, -1))))).otherwise(acc))


def _siblings(levels: Column, slot: Column) -> Column:
    """What a leaf needs at each level of ``levels`` but the last: the nodes of its run before and after it."""
    def at(level: Column, k: Column) -> Column:
        i = F.floor(slot / F.pow(F.lit(float(ARITY)), k)).cast("int")
        first = i - F.pmod(i, F.lit(ARITY))
        return F.struct(F.array_join(F.slice(level, first + 1, i - first), "").alias("before"), F.array_join(F.slice(level, i + 2, first + ARITY - i - 1), "").alias("after"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), lambda level, k: at(level, k))


def _arrays(nodes: DataFrame, entry: Column) -> DataFrame:
    """g, block and total of each array, and its slots in order: the ``entry`` of each node (which begins with its place)."""
    return nodes.groupBy("g", F.expr(f"place div {SPAN}").alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("slots"))


def _above(tops: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The root of each g, and for each of ``tops`` (g, place, total, node) its siblings up to there.

    Each step holds a SPAN-th of the nodes before; their number, from ``most`` down to one, says how many steps there are."""
    steps, level = [], tops
    while most > 1:
        entry = F.struct("place", "node", "total")
        a = _arrays(level, entry).withColumn("depth", _depth(F.element_at("slots", 1)["total"])).withColumn("levels", _levels(F.col("slots.node"), F.col("depth")))
        a = written(a.select("g", "block", F.size("slots").alias("n"), F.element_at("slots", 1)["total"].alias("total"), "levels"), "arrays")
        steps.append(a)
        level = a.select("g", F.col("block").alias("place"), F.expr(f"(total + {SPAN - 1}) div {SPAN}").alias("total"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        most = -(-most // SPAN)
    paths = level.select("g", "place", F.array().cast(SIBLINGS).alias("path"))
    for a in reversed(steps):
        up = a.join(paths.withColumnRenamed("place", "block"), ["g", "block"])
        own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda slot: F.struct((F.col("block") * SPAN + slot).alias("place"), _siblings(F.col("levels"), slot).cast(SIBLINGS).alias("own")))
        paths = up.select("g", "path", F.explode(own).alias("x")).select("g", "x.place", F.concat("x.own", "path").alias("path"))
        paths = written(paths, "paths")
    return level.select("g", F.col("node").alias("root")), paths


def _in_order(groups: DataFrame) -> DataFrame:
    """``groups`` (one row a g) with place, their number in order of g: counted in ranges, and ranked in each."""
    d = written(groups.repartitionByRange("g").withColumn("part", F.spark_partition_id()), "groups")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))  # one row a partition
    return d.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("g"))).join(parts, "part").withColumn("place", F.col("before") + F.col("own") - 1).drop("part", "before", "own")


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs``, and its source, place and path.

    ``tampered_text``: a text that replaces that of rows where it isn't null; folded_root then shows it, as all else is of the
    true rows. Any field may be null. A null source is one of its own; null doc_ids come first in a source, and rows of one
    doc_id are in order of their leaves, so equal rows stand side by side. A single row is leaf, subroot and root. Texts are
    hashed whole; other columns are not read. An empty table gives no rows.
    """
    placed = written(ranked(written(leaves(docs, tampered_text), "leaves")), "ranked")
    totals = written(placed.groupBy("g").agg(F.count(F.lit(1)).alias("total")), "totals")
    most = totals.agg(F.max("total")).first()[0] or 0
    a = _arrays(placed, F.struct("place", "doc_id", "leaf", "tampered")).join(totals, "g")
    a = written(a.withColumn("depth", _depth(F.col("total"))), "slots")
    levels = _levels(F.col("slots.leaf"), F.col("depth"))
    tops = written(a.select("g", F.col("block").alias("place"), F.expr(f"(total + {SPAN - 1}) div {SPAN}").alias("total"), F.element_at(F.element_at(levels, -1), 1).alias("node")), "tops")
    subroots, inner = _above(tops, -(-most // SPAN))
    sources = written(_in_order(subroots.withColumnRenamed("root", "node")), "subroots")
    n = sources.count()
    roots, outer = _above(sources.select(F.lit("").alias("g"), "place", F.lit(n).cast("long").alias("total"), "node"), n)
    outer = sources.select("g", "place", F.col("node").alias("subroot")).join(outer.select("place", F.col("path").alias("outer")), "place").drop("place")
    root = roots.first()
    up = inner.join(outer, "g").select("g", F.col("place").alias("block"), "subroot", F.concat("path", "outer").alias("path"))
    d = a.join(up, ["g", "block"]).withColumn("levels", levels)
    rows = F.transform("slots", lambda x, slot: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["tampered"].alias("tampered"), x["place"].alias("place"), _siblings(F.col("levels"), slot).cast(SIBLINGS).alias("own")))
    d = d.select("g", "subroot", "path", F.explode(rows).alias("x")).select("g", "subroot", "x.*", F.concat("x.own", "path").alias("path"))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))
    d = d.withColumn("root", F.lit(root["root"] if root else None)).withColumn("folded_root", folded)
    return d.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.expr("CASE WHEN g <> '' THEN substr(g, 2) END").alias("source"), "place", "path")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(2)) == 0
    return manifest(docs, F.when(even & F.col("text").isNotNull(), F.replace("text", F.lit("\n"), F.lit("")))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "place")


ORACLE = r"""
WITH RECURSIVE e AS (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
       row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, text) - 1 AS place FROM documents),
leafs AS (SELECT doc_id, source, place, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare,
       coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_transform(range(8), lambda k: ((ascii(x) >> k::INT) & 1)::BIGINT)))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 2 = 0, false) AS even FROM e),
tree(source, lvl, i, h) AS (SELECT source, 0, place, leaf FROM leafs UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM tree) WHERE c > 1 GROUP BY source, lvl, i // 3),
tops AS (SELECT source, max(lvl) AS height FROM tree GROUP BY source),
subs AS (SELECT t.source, t.h AS subroot, height, row_number() OVER (ORDER BY t.source NULLS FIRST) - 1 AS place FROM tree t JOIN tops ON t.source IS NOT DISTINCT FROM tops.source AND lvl = height),
crown(lvl, i, h) AS (SELECT 0, place, subroot FROM subs UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM crown) WHERE c > 1 GROUP BY lvl, i // 3),
top AS (SELECT h AS root, lvl AS height FROM crown ORDER BY lvl DESC LIMIT 1),
inner_steps AS (SELECT l.source, l.place, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.place // (3 ** t.lvl)::BIGINT), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.place // (3 ** t.lvl)::BIGINT), '') AS after
  FROM leafs l JOIN tree t ON l.source IS NOT DISTINCT FROM t.source AND t.i // 3 = (l.place // (3 ** t.lvl)::BIGINT) // 3 JOIN tops ON tops.source IS NOT DISTINCT FROM t.source AND t.lvl < height GROUP BY ALL),
outer_steps AS (SELECT s.source, t.lvl + s.height AS lvl, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < s.place // (3 ** t.lvl)::BIGINT), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > s.place // (3 ** t.lvl)::BIGINT), '') AS after
  FROM subs s JOIN crown t ON t.i // 3 = (s.place // (3 ** t.lvl)::BIGINT) // 3 JOIN top ON t.lvl < top.height GROUP BY ALL),
steps AS (SELECT source, place, lvl, before, after FROM inner_steps UNION ALL SELECT l.source, l.place, o.lvl, o.before, o.after FROM leafs l JOIN outer_steps o ON l.source IS NOT DISTINCT FROM o.source),
proofs AS (SELECT source, place, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY ALL),
fold(source, place, lvl, h) AS (SELECT source, place, 0, CASE WHEN even THEN bare ELSE leaf END FROM leafs UNION ALL
  SELECT f.source, f.place, f.lvl + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.place = f.place AND s.lvl = f.lvl),
folded AS (SELECT source, place, arg_max(h, lvl) AS folded_root FROM fold GROUP BY ALL)
SELECT l.doc_id, l.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified, l.place
FROM leafs l JOIN subs ON subs.source IS NOT DISTINCT FROM l.source JOIN folded ON folded.source IS NOT DISTINCT FROM l.source AND folded.place = l.place LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM l.source AND proofs.place = l.place, top
"""
