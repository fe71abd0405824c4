"""Queue, progress and retention of jobs, as batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rank of priorities, weights of nodes, labels, kinds of errors that pass, and what a status adds to the progress.
PRIORITY = {"urgent": 0, "high": 1, "normal": 2, "low": 3}
NODE_WEIGHTS = {1: 0.3, 2: 0.2, 3: 0.25, 4: 0.25}
NODE_LABELS = {1: "Basic Information", 2: "Description", 3: "Configuration", 4: "Tenancy"}
STATUS_LABELS = {"in_progress": "running", "done": "completed", "error": "failed"}
TRANSIENT = ("json_parse", "timeout", "network", "rate_limit", "connection")
DELTA = {"completed": 20.0, "running": 60.0, "failed": 10.0}


def lookup(c: Column, values: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))[c]


def queue(jobs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """With the position in the queue: by priority, then the time it is scheduled for (column scheduled_at, if there is one) or else
    was created, then id. ``scope`` gives each of many queues its own.

    Without a scope all waiting jobs are ranked together; positions come from a sorted exchange by priority and time
    first, so that no task sorts the whole queue: rows of one priority and day are ranked, then shifted."""
    rank = lookup(F.col("priority"), PRIORITY)
    due = F.coalesce("scheduled_at", "created_at") if "scheduled_at" in jobs.columns else F.col("created_at")
    if scope:
        return jobs.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy(rank, due, "job_id")))
    d = jobs.withColumn("__rank", rank).withColumn("__due", due).withColumn("__day", F.to_date("__due"))
    size = d.groupBy("__rank", "__day").agg(F.count(F.lit(1)).alias("__n"))  # one row a priority and day
    before = size.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__rank", "__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__rank", "__day").orderBy("__due", "job_id"))
    return d.withColumn("__own", own).join(before, ["__rank", "__day"]).withColumn("position", F.col("__before") + F.col("__own")).drop("__rank", "__due", "__day", "__own", "__before")


def last_events(events: DataFrame, job: str, ts: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` events of each job."""
    w = Window.partitionBy(job).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def retained(jobs: DataFrame, newest: DataFrame, hours: int = 24) -> DataFrame:
    """Without jobs that are over and older than ``hours`` before ``newest`` (one row, column now)."""
    over = F.col("status").isin("completed", "failed", "cancelled")
    return jobs.join(F.broadcast(newest), how="cross").filter(~(over & (F.col("created_at") < F.col("now") - F.expr(f"INTERVAL {hours} HOURS")))).drop("now")


def newest_kept(jobs: DataFrame, keep: dict[str, int], scope: list[str] | None = None) -> DataFrame:
    """Without the jobs of a status beyond its newest ``keep`` (of each ``scope``); other statuses stay.

    The oldest time kept is found from counts by status and day first, so that only the jobs of one day are ranked."""
    scope = scope or []
    by = [*scope, "status"]
    over = jobs.filter(F.col("status").isin(*keep)).withColumn("__day", F.to_date("created_at"))
    size = over.groupBy(*by, "__day").agg(F.count(F.lit(1)).alias("__n"))
    newer = size.withColumn("__newer", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    near = over.join(newer, [*by, "__day"]).filter(F.col("__newer") < lookup(F.col("status"), keep))
    place = F.col("__newer") + F.row_number().over(Window.partitionBy(*by, "__day").orderBy(F.desc("created_at"), F.desc("job_id")))
    kept = near.withColumn("__place", place).filter(F.col("__place") <= lookup(F.col("status"), keep)).select(*jobs.columns)
    return jobs.filter(~F.coalesce(F.col("status").isin(*keep), F.lit(False))).unionByName(kept)


def simple_progress(done: Column, running: Column, n: Column) -> Column:
    """Whole percent, 99 at most while jobs run."""
    return F.least(F.floor((done + running * 0.5) / n * 100), F.lit(99)).cast("int")


def overall_progress(done: Column, running: Column, n: Column, phase: Column) -> Column:
    """10 + 80 done / n + 20 running / n, at least the floor of the phase, one decimal."""
    floor = F.when(phase == "merging", 80.0).when(phase == "comparison", 90.0).when(phase == "finalizing", 95.0).otherwise(0.0)
    raw = F.least(F.lit(100.0), F.lit(10.0) + 80.0 * done / n + 20.0 * running / n)
    return F.floor(F.greatest(raw, floor) * 10 + 0.5) / 10


def retry_delays(jobs: DataFrame, most: int, base: float, cap: float) -> DataFrame:
    """One row for each retry a job may still have: attempt and delay_s = min(cap, base * 2^(attempt - 1))."""
    n = F.explode(F.sequence(F.lit(1), F.lit(most)))
    return jobs.withColumn("attempt", n).withColumn("delay_s", F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.col("attempt") - 1)))


def node_delays(nodes: DataFrame, category: Column, most: int) -> DataFrame:
    """One row for each retry of a node whose error is of a passing kind: attempt (from 0) and delay_s = min(30, 5 * 2^attempt)."""
    n = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    return nodes.filter(category.isin(*TRANSIENT)).withColumn("attempt", n).withColumn("delay_s", F.least(F.lit(30), F.lit(5) * F.expr("shiftleft(1, attempt)")))


def eta(now: Column, started: Column, progress: Column) -> Column:
    """When the job ends at its pace so far; known above 10 percent."""
    elapsed = F.unix_micros(now) - F.unix_micros(started)
    return F.when(progress > 10, F.timestamp_micros((F.unix_micros(now) + elapsed / (progress / 100.0) - elapsed).cast("long")))
