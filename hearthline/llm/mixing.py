"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is shared out by weight and stops at ``most`` times its words. A document is due target / words of
its source copies on average: the whole part is certain; of the rest each document has an inclusion probability of its
own, higher for what has more words (or a higher ``measure``). Every document draws a uniform number u, and documents
rank by odds(u) / odds(inclusion). The sample is the head of that ranking whose words come nearest the words still
wanted, so its size is fixed, and the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table, written

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096  # of the ranking; the bin where a sample ends is cut into as many again
HALF = 200  # words of a document of middle measure
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 4 << 20
SCALE = float(1 << 52)
KEPT = ("doc_id", "text", "source")
ADDED = ("size", "source_size", "target", "copies", "taken")


def _few_sources(docs: DataFrame) -> bool:
    """Whether a table of one row a source is small enough to go to every executor."""
    s = docs.select(F.col("source").cast("string").alias("source")).distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    return s["n"] <= BROADCAST_SOURCES and (s["bytes"] or 0) <= BROADCAST_BYTES


def _uniform(seed: int) -> Column:
    """From (0, 1), by doc_id, or by the text where that is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text")), F.lit("none")))
    return (F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(SCALE)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Words to take per source: one row a source in, one out.

    With sources in order of cap / weight, a source stops at its cap if that level for all later sources, and the caps
    of those before it, come to no more than the whole.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("level", "place")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(place)).withColumn("weight", weight)
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight")).withColumn("whole", F.lit(share) * F.sum("source_size").over(every))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)) + F.col("level") * F.sum("weight").over(rest) <= F.col("whole"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(every)
    left = F.col("whole") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * left / free)).alias("target"))


def by_size(size: Column) -> Column:
    """The measure of a document from 0 to 1000, so that sums are exact: size / (size + HALF)."""
    return F.floor(F.lit(1000) * size / (size + HALF)).cast("long")


def drawn(docs: DataFrame, seed: int, measure: Column | None = None) -> DataFrame:
    """``docs`` with size, __u (its draw), __m (its measure) and __tie."""
    d = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__u", _uniform(seed))
    d = d.withColumn("__m", by_size(F.col("size")) if measure is None else F.least(F.greatest(F.coalesce(measure.cast("long"), F.lit(0)), F.lit(0)), F.lit(1000)))
    return d.withColumn("__tie", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def ranked(d: DataFrame, goal: DataFrame) -> DataFrame:
    """``d`` with the columns of its source in ``goal``, __p (inclusion probability) and __q: odds(u) / odds(p) brought into (0, 1].

    p is the source's mean moved by the document's measure against the mean measure of a word there, at most by the
    distance to 0 or 1; so the words due to the source stay what they are."""
    d = d.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    odd = F.col("__odd")
    p = odd + F.least(odd, 1 - odd) * (F.col("__m") - F.col("__mean")) / F.lit(1000.0)
    d = d.withColumn("__p", F.when(odd > 0, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)))
    p, u = F.col("__p"), F.col("__u")
    return d.withColumn("__q", F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(F.lit(1.0)))


def _end(d: DataFrame, keys: list[str], bin_: Column) -> DataFrame:
    """Of each source, the bin in which the words wanted end and the words before it (no row where all bins are taken or none)."""
    bins = d.groupBy(*keys, bin_.alias("__bin")).agg(F.sum("size").alias("__w"), F.first("__left").alias("__left"))
    run = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to = F.sum("__w").over(run)
    return bins.withColumn("__to", to).withColumn("__from", F.col("__to") - F.col("__w")).filter("__from <= __left AND __left < __to").select(*keys, F.col("__bin").alias("__end"), F.col("__from"))


def cuts(slim: DataFrame, goal: DataFrame, small) -> DataFrame:
    """source and __cut, the place (__q, doc_id, __tie) of the last document that its sample takes, with __k of the __n rows there.

    The ranking is summed in bins, and the bin where the words wanted end in bins again; what is sorted is one in
    BINS * BINS of a source, and equal rows are one row of it. A source whose words all are wanted has no row."""
    d = ranked(slim, small(goal)).filter("__odd > 0").withColumn("__left", F.col("__want"))
    d = d.withColumn("__b1", F.least(F.floor(F.col("__q") * BINS), F.lit(BINS - 1))).withColumn("__b2", F.least(F.floor((F.col("__q") * BINS - F.col("__b1")) * BINS), F.lit(BINS - 1)))
    keep = ("source", "__q", "doc_id", "__tie", "size", "__left", "__b1", "__b2")
    for b in ("__b1", "__b2"):
        e = small(_end(d, ["source"], F.col(b)).withColumnRenamed("source", "__s"))
        d = d.join(e, F.col("source").eqNullSafe(F.col("__s"))).filter(F.col(b) == F.col("__end")).withColumn("__left", F.col("__left") - F.col("__from")).select(*keep)
    d = d.groupBy("source", "__q", "doc_id", "__tie", "size", "__left").agg(F.count(F.lit(1)).alias("__n"))
    place, size = F.struct("__q", "doc_id", "__tie"), F.col("size")
    upto = F.sum(size * F.col("__n")).over(Window.partitionBy("source").orderBy("__q", "doc_id", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.col("__left") - (upto - size * F.col("__n"))  # for this document and later ones
    fit = F.when(size > 0, F.floor((2 * room + size) / (2 * size))).otherwise(F.when(room >= 0, F.col("__n")).otherwise(0))
    d = d.withColumn("__k", F.greatest(F.least(fit, F.col("__n")), F.lit(0)).cast("long"))
    there = F.col("__k") > 0
    last = d.groupBy("source").agg(F.max(F.when(there, F.struct("__q", "doc_id", "__tie", "__k", "__n"))).alias("__in"), F.min(place).alias("__first"))
    return last.select("source", F.when(F.col("__in").isNotNull(), F.struct("__in.__q", "__in.doc_id", "__in.__tie")).alias("__cut"), "__first", "__in.__k", "__in.__n")


def first_copies(d: DataFrame) -> DataFrame:
    """``d``, equal rows of each source, with __in: true for __k rows of each. Written first, so that rows keep their numbers, which are
    counted in each part of the table and then over the parts."""
    d = written(d, "copies").withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    parts = parts.select(F.col("source").alias("__of"), F.col("__part").alias("__p0"), "__before")
    own = F.row_number().over(Window.partitionBy("source", "__part").orderBy("__row"))
    d = d.withColumn("__own", own).join(parts, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__p0")))
    return d.withColumn("__in", F.col("__own") + F.col("__before") <= F.col("__k")).drop("__row", "__part", "__own", "__of", "__p0", "__before")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 8, measure: Column | None = None) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken, beside their own columns.

    ``measure`` (0 to 1000, null as 0; by default the size's) says what is rather included. Null or empty texts have size 0
    and are taken 0 times 0 words; a null source is a source of its own, last in order. Equal rows (same doc_id and text)
    share one draw and one place; where the words wanted end among them, as many are taken as fit, whichever these are. Own columns of these names are replaced. No table gives no
    rows. A source of any share of the rows is ranked in bins of its ranking, and never sorted as a whole. The tables of
    one row a source are broadcast up to BROADCAST_SOURCES and BROADCAST_BYTES, so that texts stay in place; beyond, they
    are shuffled.
    """
    docs = docs.drop(*ADDED)
    # own columns have other names meanwhile, so that none can clash
    names = [c if c in KEPT else f"__own_{i}" for i, c in enumerate(docs.columns)]
    extra = [] if measure is None else [measure.cast("long").alias("__measure")]
    held = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)), *extra)
    d = drawn(held, seed, None if measure is None else F.col("__measure"))
    slim = written(d.select("doc_id", "source", "size", "__u", "__m", "__tie"), "drawn")
    done = mixed(d.drop("__measure"), slim, weights, share, most)
    return done.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)), *ADDED)


def mixed(d: DataFrame, slim: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``d`` (as ``drawn`` gives it) with what the mix of ``slim``, the same rows without texts, takes of each row."""
    small = F.broadcast if _few_sources(slim) else lambda x: x
    totals = written(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("__m")).alias("__weighed")), "totals")
    goal = targets(totals.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "__t")
    goal = totals.join(goal.drop("source_size"), F.col("source").eqNullSafe(F.col("__t"))).drop("__t")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("__sure", F.floor(due)).withColumn("__odd", due - F.floor(due)).withColumn("__want", F.col("target") - F.col("__sure") * F.col("source_size"))
    goal = goal.withColumn("__mean", F.when(F.col("source_size") > 0, F.col("__weighed") / F.col("source_size")).otherwise(0.0)).drop("__weighed")
    goal = written(goal, "goal")
    ends = written(cuts(slim, goal, small).withColumnRenamed("source", "__s").withColumn("__ends", F.lit(True)), "cuts")
    d = ranked(d, small(goal))
    d = d.join(small(ends), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    place = F.struct("__q", "doc_id", "__tie")
    # before the documents that were sorted, or among those of them that are taken; nothing is sorted where all is wanted
    inside = F.when(F.col("__ends").isNull(), F.lit(True)).otherwise((place < F.col("__first")) | F.coalesce(place <= F.col("__cut"), F.lit(False)))
    d = d.withColumn("__in", inside)
    if not ends.filter("__k < __n").isEmpty():
        some = F.coalesce((place == F.col("__cut")) & (F.col("__k") < F.col("__n")), F.lit(False))
        d = d.filter(~some).unionByName(first_copies(d.filter(some)).select(*d.columns))
    taken = F.col("__in") & (F.col("__odd") > 0)
    return d.withColumn("copies", (F.col("__sure") + taken.cast("int")).cast("int")).withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it, with its own columns as they are, whatever their names."""
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    extra = [options.pop("measure").alias("__measured")] if options.get("measure") is not None else []
    renamed = docs.select(*(docs[f"`{c}`"].alias(c if c in KEPT else o) for c, o in zip(docs.columns, own, strict=True)), *extra)
    taken = mix(renamed, **options, **({"measure": F.col("__measured")} if extra else {})).filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(c if c in KEPT else o).alias(c) for c, o in zip(docs.columns, own, strict=True)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drawn(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), seed=8)
    slim = written(docs.drop("text"), "drawn")
    return mixed(slim, slim, (5, 2, 1), 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  (('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 't' || text, 'none')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, ([5, 2, 1])[((place - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE AS whole FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + cap / weight * sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= whole AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, weight::DOUBLE * (whole - (SELECT coalesce(sum(cap), 0) FROM s3 WHERE capped)) / (SELECT sum(weight) FROM s3 WHERE NOT capped)::DOUBLE) END AS target FROM s3),
m AS (SELECT source, sum(size * (1000 * size // (size + 200))) / nullif(sum(size), 0)::DOUBLE AS mean FROM d GROUP BY 1),
g AS (SELECT s4.*, mean, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS sure, CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS odd FROM s4 JOIN m ON s4.source IS NOT DISTINCT FROM m.source),
p AS (SELECT d.doc_id, d.size, d.u, d.text, g.*, CASE WHEN odd > 0 THEN least(greatest(odd + least(odd, 1 - odd) * ((1000 * d.size // (d.size + 200)) - mean) / 1000.0::DOUBLE, 0), 1) ELSE 0 END AS p FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) ELSE 1 END AS q FROM p),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN odd > 0 AND 2 * upto - size <= 2 * (target - sure * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
