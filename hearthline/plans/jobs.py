"""Queries of jobs and events in batch (J), and the batch twins of the stream (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import jobs as J
from ..operators.scan import levels, running
from ..sources.snapshot import shared_folder, written
from ..streaming import keyed
from .registry import query
from .tables import Tables

RANK = "CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END"


@query("j1_filter_jobs", "SELECT job_id, created_at, cost FROM job WHERE status = 'running' AND priority IN ('urgent', 'high')")
def j1(t: Tables) -> DataFrame:
    return t.job.filter("status = 'running' AND priority IN ('urgent', 'high')").orderBy(F.desc("created_at")).select("job_id", "created_at", "cost")


@query("j2_page", "SELECT job_id, created_at, (SELECT count(*) FROM job) AS total FROM job ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40")
def j2(t: Tables) -> DataFrame:
    total = t.job.agg(F.count(F.lit(1)).alias("total"))
    return t.job.orderBy(F.desc("created_at"), "job_id").offset(40).limit(20).select("job_id", "created_at").join(F.broadcast(total), how="cross")


@query("j3_queue_order", f"""
, w AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN created_at + INTERVAL 40 DAYS END AS scheduled_at FROM job WHERE status = 'pending')
SELECT job_id, row_number() OVER (ORDER BY {RANK}, coalesce(scheduled_at, created_at), job_id) AS position FROM w""")
def j3(t: Tables) -> DataFrame:
    """Every third job is scheduled for a later day."""
    waiting = t.job.filter("status = 'pending'").withColumn("scheduled_at", F.when(F.col("job_id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 40 DAYS")))
    return J.queue(waiting).select("job_id", "position")


@query("j4_queue_stats", """
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS queued, count(*) FILTER (status = 'running') AS running, least(3, count(*) FILTER (status = 'running'))::BIGINT AS active_workers FROM job""")
def j4(t: Tables) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return t.job.agg(F.count(F.lit(1)).alias("total"), of("completed").alias("completed"), of("pending").alias("queued"), of("running").alias("running"), F.least(F.lit(3).cast("long"), of("running")).alias("active_workers"))


@query("j4_stats_rollup", "SELECT status, priority, count(*) AS n FROM job GROUP BY ROLLUP (status, priority)")
def j4_rollup(t: Tables) -> DataFrame:
    return t.job.rollup("status", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("j5_execution_time", "SELECT job_id, max(epoch_us(end_time) - epoch_us(start_time)) / 1000000.0::DOUBLE AS seconds FROM node GROUP BY 1")
def j5(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.node.groupBy("job_id").agg((F.max(us("end_time") - us("start_time")) / 1000000.0).alias("seconds"))


@query("j6_running_average", """
SELECT l_suppkey, job_id, l_linenumber, l_partkey, l_extendedprice, avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY end_time, job_id, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS mean FROM node""")
def j6(t: Tables) -> DataFrame:
    rows = t.node.select("l_suppkey", "end_time", "job_id", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    d = running(rows, ["l_suppkey"], "end_time", ["job_id", "l_linenumber", "l_partkey", "l_extendedprice"], {"s": ("sum", F.col("l_quantity")), "n": ("count", F.col("l_quantity"))}, block=90 * 86_400)
    return d.select("l_suppkey", "job_id", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("s") / F.col("n")).alias("mean"))


@query("j7_eligible", """
, r AS (SELECT job_id, count(*) FILTER (status = 'failed') AS failed FROM node GROUP BY 1)
SELECT job_id, failed BETWEEN 1 AND 2 AS may_retry, status IN ('pending', 'running') AS may_cancel FROM job JOIN r USING (job_id)""")
def j7(t: Tables) -> DataFrame:
    failed = t.node.groupBy("job_id").agg(F.count_if(F.col("status") == "failed").alias("failed"))
    return t.job.join(failed, "job_id").select("job_id", F.col("failed").between(1, 2).alias("may_retry"), F.col("status").isin("pending", "running").alias("may_cancel"))


@query("j8_retry_schedule", """
, f AS (SELECT job_id, count(*) FILTER (status = 'failed') AS failed FROM node GROUP BY 1)
SELECT job_id, a AS attempt, least(300.0, 30.0 * 2 ** (a - 1))::DOUBLE AS delay_s FROM job JOIN f USING (job_id), range(1, 6) r(a) WHERE failed BETWEEN 1 AND 2""")
def j8(t: Tables) -> DataFrame:
    failed = t.node.groupBy("job_id").agg(F.count_if(F.col("status") == "failed").alias("failed")).filter(F.col("failed").between(1, 2))
    return J.retry_delays(t.job.join(failed, "job_id", "left_semi").select("job_id"), 5, 30, 300).select("job_id", F.col("attempt").cast("long").alias("attempt"), "delay_s")


@query("j8_node_backoff", """
, n AS (SELECT job_id, node, l_linenumber, ['timeout', 'network', 'rate_limit', 'validation'][(l_partkey % 4 + 1)::INT] AS category FROM node WHERE status = 'failed')
SELECT job_id, node, l_linenumber, category, a AS attempt, least(30, 5 * 2 ** a)::INT AS delay_s FROM n, range(0, 4) r(a) WHERE category <> 'validation'""")
def j8_nodes(t: Tables) -> DataFrame:
    """Waits before the retries of failed nodes, with a category of their error by rule."""
    n = t.node.filter("status = 'failed'").select("job_id", "node", "l_linenumber", F.element_at(F.array(*map(F.lit, ("timeout", "network", "rate_limit", "validation"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("category"))
    return J.node_delays(n, F.col("category"), 4).select("job_id", "node", "l_linenumber", "category", F.col("attempt").cast("long").alias("attempt"), "delay_s")


@query("j10_newest_kept", """
, s AS (SELECT job_id, created_at, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM job),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, job_id DESC) AS n FROM s)
SELECT job_id, status FROM r WHERE status NOT IN ('completed', 'failed') OR n <= CASE status WHEN 'completed' THEN 100 ELSE 50 END""")
def j10_kept(t: Tables) -> DataFrame:
    """The newest 100 completed and 50 failed jobs, and all others."""
    d = t.job.select("job_id", "created_at", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")).alias("status"))
    return J.newest_kept(d, {"completed": 100, "failed": 50}).select("job_id", "status")


@query("j9_last_events", "SELECT job_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM progress) WHERE n <= 50")
def j9(t: Tables) -> DataFrame:
    return J.last_events(t.progress, "job_id", "ts", "event_id", 50).select("job_id", "event_id", "ts")


@query("j10_retention", "SELECT job_id, status FROM job WHERE NOT (status = 'completed' AND created_at < (SELECT max(created_at) FROM job) - INTERVAL 8760 HOURS)")
def j10(t: Tables) -> DataFrame:
    return J.retained(t.job, t.job.agg(F.max("created_at").alias("now")), 8760).select("job_id", "status")


@query("j11_active_urls", """
, p AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')) AS u FROM pages)
SELECT min(page_id) AS page_id, u FROM p WHERE u NOT IN (SELECT u FROM p WHERE page_id % 10 = 0) GROUP BY u""")
def j11(t: Tables) -> DataFrame:
    """The first submission of each address that no active job has."""
    from ..operators.links import normalize_url

    p = t.read("pages").select("page_id", normalize_url(F.col("url")).alias("u"))
    active = p.filter("page_id % 10 = 0").select("u").distinct()
    return p.join(active, "u", "left_anti").groupBy("u").agg(F.min("page_id").alias("page_id"))


@query("j11_suppressed", """
, j AS (SELECT customer, created_at::TIMESTAMP AS started, CASE WHEN job.status <> 'running' THEN ended END AS ended FROM job JOIN (SELECT job_id, max(end_time) AS ended FROM node GROUP BY 1) USING (job_id)),
r AS (SELECT job_id, customer, created_at + INTERVAL 15 MINUTES AS ts FROM job)
SELECT job_id, NOT EXISTS (SELECT 1 FROM j WHERE j.customer = r.customer AND ts >= started AND (ended IS NULL OR ts < ended)) AS free FROM r""")
def j11_suppressed(t: Tables) -> DataFrame:
    """Requests a quarter of an hour after each order, held up by what runs for that customer; running jobs have no end yet."""
    from ..streaming.progress import suppressed

    ended = t.node.groupBy("job_id").agg(F.max("end_time").alias("ended"))
    jobs = t.job.join(ended, "job_id").select(F.col("customer").alias("url"), F.col("created_at").cast("timestamp").alias("started"), F.when(F.col("status") != "running", F.col("ended")).alias("ended"))
    requests = t.job.select("job_id", F.col("customer").alias("url"), (F.col("created_at").cast("timestamp") + F.expr("INTERVAL 15 MINUTES")).alias("ts"))
    return suppressed(requests, jobs).select("job_id", "free")


@query("j12_cascade", "SELECT count(*) AS nodes, count(DISTINCT job_id) AS jobs FROM node WHERE job_id NOT IN (SELECT job_id FROM job WHERE priority = 'low')")
def j12(t: Tables) -> DataFrame:
    gone = t.job.filter("priority = 'low'").select("job_id")
    return t.node.join(gone, "job_id", "left_anti").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("job_id").alias("jobs"))


@query("j13_active", "SELECT job_id, status FROM job WHERE status IN ('pending', 'running')")
def j13(t: Tables) -> DataFrame:
    return t.job.filter(F.col("status").isin("pending", "running")).select("job_id", "status")


NODES = ", g AS (SELECT job_id, count(*) AS n, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'running') AS running FROM node GROUP BY 1)"


def by_job(t: Tables) -> DataFrame:
    return t.node.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "running").alias("running"))


@query("j14_simple_progress", NODES + " SELECT job_id, least(floor((done + .5::DOUBLE * running) / n * 100), 99)::INT AS progress FROM g")
def j14(t: Tables) -> DataFrame:
    return by_job(t).select("job_id", J.simple_progress(F.col("done"), F.col("running"), F.col("n")).alias("progress"))


@query("j15_overall_progress", NODES + """
 SELECT job_id, floor(greatest(least(100.0::DOUBLE, 10.0::DOUBLE + 80.0::DOUBLE * done / n + 20.0::DOUBLE * running / n), CASE WHEN n = 1 THEN 80 WHEN n = 2 THEN 90 WHEN n = 3 THEN 95 ELSE 0 END) * 10 + .5) / 10 AS progress FROM g""")
def j15(t: Tables) -> DataFrame:
    phase = F.when(F.col("n") == 1, "merging").when(F.col("n") == 2, "comparison").when(F.col("n") == 3, "finalizing")
    return by_job(t).select("job_id", J.overall_progress(F.col("done"), F.col("running"), F.col("n"), phase).alias("progress"))


@query("j16_api_progress", NODES + " SELECT job_id, greatest(50.0, done * 100.0 / n * .6 + 10)::DOUBLE AS progress FROM g")
def j16(t: Tables) -> DataFrame:
    return by_job(t).select("job_id", F.greatest(F.lit(50.0), F.col("done") * 100.0 / F.col("n") * 0.6 + 10).alias("progress"))


@query("j17_tracker_progress", """
, n AS (SELECT job_id, node, max(CASE event_type WHEN 'node_completed' THEN 1.0 WHEN 'node_started' THEN .1 ELSE 0 END) AS share FROM progress GROUP BY ALL),
p AS (SELECT job_id, count(DISTINCT event_type) FILTER (event_type LIKE 'job%') AS phases FROM progress GROUP BY 1)
SELECT job_id, least(100.0, sum(share * CASE node WHEN 1 THEN .3 WHEN 2 THEN .2 ELSE .25 END) * 100 + 2 * any_value(phases))::DOUBLE AS progress FROM n JOIN p USING (job_id) GROUP BY 1""")
def j17(t: Tables) -> DataFrame:
    share = F.when(F.col("event_type") == "node_completed", 1.0).when(F.col("event_type") == "node_started", 0.1).otherwise(0.0)
    n = t.progress.groupBy("job_id", "node").agg(F.max(share).alias("share"))
    p = t.progress.filter(F.col("event_type").startswith("job")).groupBy("job_id").agg(F.count_distinct("event_type").alias("phases"))
    weight = J.lookup(F.col("node"), J.NODE_WEIGHTS)
    return n.groupBy("job_id").agg(F.sum(F.col("share") * weight).alias("sum")).join(p, "job_id").select("job_id", F.least(F.lit(100.0), F.col("sum") * 100 + 2 * F.col("phases")).alias("progress"))


@query("j18_eta", """
, e AS (SELECT job_id, min(ts) AS started, max(ts) AS now, count(*) % 100 AS p FROM progress GROUP BY 1)
SELECT job_id, p, CASE WHEN p > 10 THEN floor((epoch_us(now) + (epoch_us(now) - epoch_us(started)) / (p / 100.0::DOUBLE) - (epoch_us(now) - epoch_us(started))) / 1000000)::BIGINT END AS eta_s FROM e""")
def j18(t: Tables) -> DataFrame:
    e = t.progress.groupBy("job_id").agg(F.min("ts").alias("started"), F.max("ts").alias("now"), (F.count(F.lit(1)) % 100).alias("p"))
    at = J.eta(F.col("now").cast("timestamp"), F.col("started").cast("timestamp"), F.col("p"))
    return e.select("job_id", "p", F.floor(F.unix_micros(at) / 1000000).alias("eta_s"))


@query("j19_node_detail", """
, n AS (SELECT job_id, node, count(*) FILTER (event_type = 'node_completed') AS done, count(*) FILTER (event_type = 'node_failed') AS failed FROM progress GROUP BY ALL)
SELECT job_id, sum(done)::BIGINT AS done, sum(failed)::BIGINT AS failed, max(done) FILTER (node = 2) AS done_2 FROM n GROUP BY 1""")
def j19(t: Tables) -> DataFrame:
    of = lambda k: F.count_if(F.col("event_type") == k)
    n = t.progress.groupBy("job_id", "node").agg(of("node_completed").alias("done"), of("node_failed").alias("failed"))
    m = n.groupBy("job_id").agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.map_from_entries(F.collect_list(F.struct("node", "done"))).alias("m"))
    return m.select("job_id", "done", "failed", F.try_element_at("m", F.lit(2).cast("long")).alias("done_2"))


@query("j20_lift_metadata", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def j20(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("j21_dependency_levels", """
, RECURSIVE_ AS (SELECT 1)
SELECT n_nationkey AS node, level FROM nation JOIN LATERAL (
  SELECT max(n)::INT AS level FROM (WITH RECURSIVE r(k, n) AS (SELECT n_nationkey, 0 UNION SELECT unnest([k // 2, k // 3]), n + 1 FROM r WHERE k > 0) SELECT n FROM r)) ON true""".replace(", RECURSIVE_ AS (SELECT 1)", ""))
def j21(t: Tables) -> DataFrame:
    """Levels in a graph where each node needs the half and the third of its number."""
    n = t.read("nation").select(F.col("n_nationkey").alias("node"))
    e = n.select("node", F.explode(F.array(F.expr("node div 2"), F.expr("node div 3"))).alias("needs")).filter("node > 0")
    return levels(n, e, lambda d: written(d, "levels"))


@query("j22_progress_delta", "SELECT node, status, count(*) AS n, CASE status WHEN 'completed' THEN 20.0 WHEN 'running' THEN 60.0 WHEN 'failed' THEN 10.0 ELSE 0 END * CASE node WHEN 1 THEN .3 WHEN 2 THEN .2 ELSE .25 END + 10.0::DOUBLE AS delta FROM node GROUP BY ALL")
def j22(t: Tables) -> DataFrame:
    delta = F.coalesce(J.lookup(F.col("status"), J.DELTA), F.lit(0.0)) * J.lookup(F.col("node"), J.NODE_WEIGHTS) + 10.0
    return t.node.groupBy("node", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("delta", delta)


@query("j23_labels", "SELECT node, CASE node WHEN 1 THEN 'Basic Information' WHEN 2 THEN 'Description' WHEN 3 THEN 'Configuration' ELSE 'Tenancy' END AS label, CASE status WHEN 'running' THEN 'in_progress' ELSE status END AS shown, count(*) AS n FROM node GROUP BY ALL")
def j23(t: Tables) -> DataFrame:
    shown = F.coalesce(J.lookup(F.col("status"), {v: k for k, v in J.STATUS_LABELS.items() if k == "in_progress"}), F.col("status"))
    return t.node.select("node", J.lookup(F.col("node"), J.NODE_LABELS).alias("label"), shown.alias("shown")).groupBy("node", "label", "shown").agg(F.count(F.lit(1)).alias("n"))


@query("s3_json_structure", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Invalid JSON format' WHEN 1 THEN 'must be a JSON object' END AS error FROM events")
def s3(t: Tables) -> DataFrame:
    from ..sources.responses import structure_error

    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return t.read("events").select("event_id", structure_error(text).alias("error"))


@query("s2_response_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def s2(t: Tables) -> DataFrame:
    from ..sources.responses import parsed

    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("The answer is "), "props", F.lit(" as asked."))).when(k == 2, F.col("props")).otherwise("no object at all")
    return t.read("events").select("event_id", parsed(text, "k BIGINT")["k"].alias("k"))


@query("s4_table_scans", "SELECT (SELECT count(*) FROM job) AS jobs, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM progress) AS events")
def s4(t: Tables) -> DataFrame:
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(t.job, "jobs").join(n(t.node, "nodes"), how="cross").join(n(t.progress, "events"), how="cross")


@query("r3_monotonic_progress", "SELECT job_id, event_id, max(value) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM progress")
def r3(t: Tables) -> DataFrame:
    return running(t.progress.select("job_id", "event_id", "ts", "value"), ["job_id"], "ts", ["event_id"], {"progress": ("max", F.col("value"))}).select("job_id", "event_id", "progress")


@query("r5_unexpired", "SELECT job_id, max(ts) AS last_ts FROM progress GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOURS > (SELECT max(ts) - INTERVAL 1 HOUR FROM progress)")
def r5(t: Tables) -> DataFrame:
    """Jobs whose state a stream still holds when it has seen all events, an hour late at most."""
    from ..streaming.progress import unexpired

    now = t.progress.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("now"))
    d = t.progress.groupBy("job_id").agg(F.max("ts").alias("last_ts")).join(F.broadcast(now), how="cross")  # one row
    return unexpired(d, F.col("now")).select("job_id", "last_ts")


@query("r6_phases", """
, f AS (SELECT job_id, event_type, min(ts) AS first FROM progress GROUP BY ALL)
SELECT job_id, string_agg(event_type, ',' ORDER BY first, event_type) AS phases FROM f GROUP BY 1""")
def r6(t: Tables) -> DataFrame:
    f = t.progress.groupBy("job_id", "event_type").agg(F.min("ts").alias("first"))
    return f.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("phases"))


@query("r9_counts_by_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM progress GROUP BY ALL")
def r9(t: Tables) -> DataFrame:
    from ..streaming.progress import counts_by_window

    return counts_by_window(t.progress, "1 hour").select(F.col("start").alias("hour"), "event_type", "n")


@query("r9_sliding", "SELECT date_trunc('hour', ts) - o * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM progress, range(0, 2) r(o) GROUP BY ALL")
def r9_sliding(t: Tables) -> DataFrame:
    from ..streaming.progress import counts_by_window

    return counts_by_window(t.progress, "2 hours", "1 hour").select("start", "event_type", "n")


@query("r9_sessions", """
, g AS (SELECT job_id, ts, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOURS)::INT AS new FROM progress WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts) AS s FROM g)
SELECT job_id, min(ts) AS start, count(*) AS n FROM s GROUP BY job_id, s""")
def r9_sessions(t: Tables) -> DataFrame:
    g = t.progress.groupBy("job_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("job_id", F.col("w.start").alias("start"), "n")


@query("r10_latest", "SELECT job_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM progress GROUP BY 1")
def r10(t: Tables) -> DataFrame:
    return t.progress.groupBy("job_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("r10_upserted", "SELECT job_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM progress GROUP BY 1")
def r10_upserted(t: Tables) -> DataFrame:
    """The same through the keyed table of the stream, in four batches: the first with the events of every fourth day, and so on."""
    rows = t.progress.select("job_id", "event_id", "event_type", "ts")
    path, order = shared_folder(t.spark, "latest"), ["ts", "event_id"]
    put, quarter = keyed.upsert(path, "job_id", order, buckets=8, deltas=2), F.pmod(F.dayofyear("ts"), F.lit(4))
    for number in range(4):
        put(rows.filter(quarter == number), number)
    return keyed.latest(t.spark, path, "job_id", order, rows.schema).select("job_id", "event_type", "ts")


@query("r2_job_states", """
, f AS (SELECT job_id, event_type, count(*) AS n, min((ts, event_id)) AS first FROM progress GROUP BY ALL), p AS (SELECT job_id, string_agg(event_type, ',' ORDER BY first) AS phases FROM f GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM progress), l AS (SELECT job_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS last_events FROM r WHERE n <= 100 GROUP BY 1),
j AS (SELECT job_id, count(*) AS events, count(*) FILTER (event_type = 'node_completed') AS completed, count(*) FILTER (event_type = 'node_failed') AS failed, greatest(0, max(value))::DOUBLE AS progress, max(ts) AS last_ts FROM progress GROUP BY 1)
SELECT job_id, events, completed, failed, progress, phases, last_ts, last_events FROM j JOIN p USING (job_id) JOIN l USING (job_id)""")
def r2(t: Tables) -> DataFrame:
    """The state machine of the stream over stored events."""
    from ..streaming.progress import batch_states

    return batch_states(t.progress)
