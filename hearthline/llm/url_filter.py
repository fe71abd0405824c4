"""URL filters: rules by host and path, and the reputation of hosts.

Labelled pages give each host bad and good outcomes. Beta-binomial priors shrink them: the corpus is the prior of a suffix, the
suffix of its registered domains, the domain of its hosts. How strong a prior is comes from the data: the more alike the members
of a level are, the more they lean on their parent. A host is blocked where even the lower posterior bound of its share of
bad pages is above a limit, so a host with few labels is judged by its domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LIMIT = 0.5  # a host is blocked if more of its pages than that are bad,
Z = 1.645  # as sure as so many deviations of the posterior are
WEAKEST, STRONGEST = 2.0, 1000.0  # of a prior, in pages
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")  # with a country behind it, these are part of the suffix
SUFFIX = rf"(?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]+"
NUMBERS = r"^(?:[0-9.]+|\[.*\])\z"
BROADCAST_HOSTS, BROADCAST_BYTES = 50_000, 8 << 20
SALTS = 32  # of the join of pages with a table of hosts too large to broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in small letters; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """A host without its port and a last point."""
    return F.regexp_replace(host, r"\.?(?::[0-9]*)?\z", "")


def suffix_of(name: Column) -> Column:
    """The last label, or the last two where the last is a country's and the one before it is in SECOND; empty for addresses of numbers."""
    return F.when(name.rlike(NUMBERS), F.lit("")).otherwise(F.regexp_extract(name, rf"(?:^|\.)({SUFFIX})\z", 1))


def domain_of(name: Column) -> Column:
    """The registered domain: the suffix and the label before it, if any; an address of numbers is its own."""
    return F.when(name.rlike(NUMBERS), name).otherwise(F.regexp_extract(name, rf"((?:[^.]+\.)?(?:{SUFFIX}))\z", 1))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; both null where none does."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(says)
    return rule, says


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id and bad (0 or 1) of the labelled pages: bad is what is toxic or of no quality; repeated labels count once, at their worst."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def hosts(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """host, domain, suffix, n and bad (labelled pages and bad ones among them) of every host, one row each."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"))
    each = slim.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("rows"))  # repeated rows are one before the join
    labelled = each.join(judged, "page_id").select("host", F.col("rows").alias("n"), (F.col("rows") * F.col("bad")).alias("bad"))
    every = slim.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    counts = every.unionByName(labelled).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    name = name_of(F.col("host"))
    return counts.select("host", domain_of(name).alias("domain"), suffix_of(name).alias("suffix"), "n", "bad")


def _strength(level: DataFrame) -> float:
    """Pages that a prior counts for: the moment estimate of how much the members (n, bad) of a level differ from their parents' ``mean``.

    One row comes to the driver."""
    n, m = F.col("n"), F.col("mean")
    apart = n * (F.col("bad") / n - m) * (F.col("bad") / n - m)
    row = level.filter("n > 0").agg(F.sum(apart - m * (1 - m)).alias("more"), F.sum(m * (1 - m) * (n - 1)).alias("most")).first()
    alike = (row["more"] or 0.0) / row["most"] if row["most"] else 0.0
    return min(max(1 / alike - 1, WEAKEST), STRONGEST) if alike > 0 else STRONGEST


def reputations(found: DataFrame, z: float = Z) -> DataFrame:
    """``found`` (see ``hosts``) with alpha and beta of each host's posterior share of bad pages, its bad_mean and bad_bound.

    A host without labels gets the posterior of its parents. Without any label the corpus counts as half of a bad page in one."""
    one = found.agg(F.sum("n"), F.sum("bad")).first()
    parents = found.withColumn("mean", F.lit(((one[1] or 0) + 0.5) / ((one[0] or 0) + 1.0)))
    for keys in (["suffix"], ["suffix", "domain"]):
        level = parents.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("mean").alias("mean"))
        s = _strength(level)
        own = level.select(*keys, ((F.col("bad") + s * F.col("mean")) / (F.col("n") + s)).alias("own"))
        parents = parents.join(own, keys).withColumn("mean", F.col("own")).drop("own")
    s = _strength(parents)
    out = parents.withColumn("alpha", F.col("bad") + s * F.col("mean")).withColumn("beta", F.col("n") - F.col("bad") + s * (1 - F.col("mean")))
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    return out.drop("mean").withColumn("bad_mean", mean).withColumn("bad_bound", F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))))


def _judged(pages: DataFrame, judged: DataFrame, rules: tuple[tuple[str, str], ...], limit: float, z: float) -> DataFrame:
    known = written(reputations(written(hosts(pages, judged), "hosts"), z), "reputations").select("host", "bad_mean", "bad_bound")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("host")).alias("bytes")).first()
    p = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if size["n"] <= BROADCAST_HOSTS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        p = p.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return p.withColumns({"rule": rule, "verdict": F.coalesce(says, own), "bad_mean": F.round("bad_mean", 6), "bad_bound": F.round("bad_bound", 6)})


def judge(pages: DataFrame, judged: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean and bad_bound of each row of ``pages`` (page_id, url).

    ``judged``: page_id and bad of labelled pages (see ``outcomes``). Where a rule fits, the longest decides; else the host's
    posterior bound does. A null url, or one without ``://``, has an empty host, which is judged like any other. Repeated rows
    and null page_ids stay; no other columns are read; an empty table gives no rows. A table of hosts that is
    measured to be small is broadcast; a larger one is joined by host and salt, so that a host of any share of the pages is
    spread.
    """
    return _judged(pages.select("page_id", "url"), judged, rules, limit, z).select("page_id", "host", "path", "rule", "verdict", "bad_mean", "bad_bound")


def keep_allowed(pages: DataFrame, judged: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their own columns as they are, whatever their names."""
    own = [c if c in ("page_id", "url") else f"__own_{i}" for i, c in enumerate(pages.columns)]
    left = _judged(pages.toDF(*own), judged, rules, limit, z).filter("verdict = 'allow'")
    return left.select(*(F.col(o).alias(c) for c, o in zip(pages.columns, own, strict=True)))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), outcomes(table(spark, sf_dir, "labels")))


ORACLE = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, regexp_replace(host, '\.?(:[0-9]*)?$', '') AS name FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT *, CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*\])$') THEN '' ELSE regexp_extract(name, '(?:^|\.)({SUFFIX})$', 1) END AS suffix, CASE WHEN regexp_matches(name, '^([0-9.]+|\[.*\])$') THEN name ELSE regexp_extract(name, '((?:[^.]+\.)?(?:{SUFFIX}))$', 1) END AS domain FROM h0),
g AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS mean FROM h),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT mean FROM g) AS mean FROM h GROUP BY suffix),
k1 AS (SELECT coalesce(CASE WHEN a > 0 THEN least(greatest(1 / a - 1, {WEAKEST}::DOUBLE), {STRONGEST}::DOUBLE) END, {STRONGEST}::DOUBLE) AS s FROM (SELECT sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0) AS a FROM s1 WHERE n > 0)),
s2 AS (SELECT suffix, domain, sum(h.n) AS n, sum(h.bad) AS bad, min((s1.bad + s * mean) / (s1.n + s)) AS mean FROM h JOIN s1 USING (suffix), k1 GROUP BY suffix, domain),
k2 AS (SELECT coalesce(CASE WHEN a > 0 THEN least(greatest(1 / a - 1, {WEAKEST}::DOUBLE), {STRONGEST}::DOUBLE) END, {STRONGEST}::DOUBLE) AS s FROM (SELECT sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0) AS a FROM s2 WHERE n > 0)),
s3 AS (SELECT host, h.n, h.bad, (s2.bad + s * mean) / (s2.n + s) AS mean FROM h JOIN s2 USING (suffix, domain), k2),
k3 AS (SELECT coalesce(CASE WHEN a > 0 THEN least(greatest(1 / a - 1, {WEAKEST}::DOUBLE), {STRONGEST}::DOUBLE) END, {STRONGEST}::DOUBLE) AS s FROM (SELECT sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0) AS a FROM s3 WHERE n > 0)),
r AS (SELECT host, (bad + s * mean) / (n + s) AS m, n + s AS ab FROM s3, k3),
b AS (SELECT host, m, greatest(0, m - {Z}::DOUBLE * sqrt(m * (1 - m) / (ab + 1))) AS bound FROM r),
rules(rule, name, start, says) AS (VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)}),
j AS (SELECT p.*, m, bound, (SELECT arg_max({{'rule': rule, 'says': says}}, len(rule)) FROM rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS hit FROM p JOIN b USING (host))
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.says, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(m, 6) AS bad_mean, round(bound, 6) AS bad_bound FROM j
"""
