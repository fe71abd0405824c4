"""Progress events as a stream: windows, de-duplication, and the state of each job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id long, ts timestamp, job_id long, event_type string, node long, value double"
STATE = "job_id long, events long, completed long, failed long, progress double, phases string, last_ts timestamp, last_events string"
RING = 100  # last events kept for each job


def read(spark: SparkSession, folder: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """The parquet files of a folder as a stream, as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def counts_by_window(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by type in tumbling or sliding windows; ``late``: how far behind an event may come, for streams."""
    d = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return d.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def first_submissions(submissions: DataFrame, url: str, ts: str, late: str) -> DataFrame:
    """Each address once within the watermark."""
    return submissions.withWatermark(ts, late).dropDuplicatesWithinWatermark([url])


class JobState(StatefulProcessor):
    """Counts, never falling progress, phases in order and the last events of each job. A job expires ``hours`` after its last event, by
    event time: a timer goes off when the watermark is past that, so a replay of old events expires what the first run did.

    Frames are taken one by one, so that a job of any size needs RING rows of memory."""

    def __init__(self, hours: float = 24) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "events long, completed long, failed long, progress double, last_ts timestamp, last_ms long")
        self.phases = handle.getListState("phases", "phase string, ts timestamp, event_id long")
        self.ring = handle.getListState("ring", "ts timestamp, event_id long")

    def _wait(self, last_ms: int) -> None:
        due = last_ms + int(self.hours * 3_600_000)
        for t in list(self.handle.listTimers()):
            if t != due:
                self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, completed, failed, progress, last, last_ms = self.job.get() if self.job.exists() else (0, 0, 0, 0.0, None, 0)
        first = {p: (ts, e) for p, ts, e in self.phases.get()} if self.phases.exists() else {}
        ring = [tuple(e) for e in self.ring.get()] if self.ring.exists() else []
        for batch in rows:
            events += len(batch)
            completed += int((batch["event_type"] == "node_completed").sum())
            failed += int((batch["event_type"] == "node_failed").sum())
            progress = max(progress, float(batch["value"].fillna(0.0).max()))
            pairs = sorted((ts, int(e), p) for ts, e, p in zip(batch["ts"], batch["event_id"], batch["event_type"], strict=True))
            for ts, e, p in pairs:
                first[p] = min(first.get(p, (ts, e)), (ts, e))
            ring = sorted(ring + [(ts, e) for ts, e, _ in pairs])[-RING:]
            last = max(x for x in (last, pairs[-1][0]) if x is not None)
            last_ms = max(last_ms, int(batch["ms"].max()))
        self.job.update((events, completed, failed, progress, last, last_ms))
        self.phases.put([(p, *at) for p, at in first.items()])
        self.ring.put(ring)
        self._wait(last_ms)
        phases = ",".join(sorted(first, key=first.get))
        yield pd.DataFrame({"job_id": [key[0]], "events": [events], "completed": [completed], "failed": [failed], "progress": [progress], "phases": [phases], "last_ts": [last], "last_events": [",".join(str(e) for _, e in ring)]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.job.update((int(r.events), int(r.completed), int(r.failed), float(r.progress), r.last_ts, int(r.last_ms)))
            at = lambda us: pd.Timestamp(us, unit="us")
            self.phases.put([(p["event_type"], at(p["us"]), p["event_id"]) for p in json.loads(r.first)])
            self.ring.put([(at(e["us"]), e["event_id"]) for e in json.loads(r.ring)])
            self._wait(int(r.last_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.job, self.phases, self.ring):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def snapshot(events: DataFrame) -> DataFrame:
    """The state of each job from stored events, as a stream can go on from it: the columns of its state, first and ring as JSON."""
    from ..operators.jobs import last_events

    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("n")).otherwise(0))
    kinds = events.groupBy("job_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"), F.max("ts").alias("ts"), F.min(F.struct(us, "event_id")).alias("first"))
    jobs = kinds.groupBy("job_id").agg(
        F.sum("n").alias("events"), of("node_completed").alias("completed"), of("node_failed").alias("failed"), F.greatest(F.lit(0.0), F.max("value")).alias("progress"),
        F.max("ts").alias("last_ts"), F.unix_millis(F.max("ts").cast("timestamp")).alias("last_ms"), F.to_json(F.array_sort(F.collect_list(F.struct("first.us", "first.event_id", "event_type")))).alias("first"),
    )
    ring = last_events(events, "job_id", "ts", "event_id", RING).groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(us, "event_id")))).alias("ring"))
    return jobs.join(ring, "job_id")


def batch_states(events: DataFrame) -> DataFrame:
    """The states of all jobs from stored events: the batch twin of ``job_states``."""
    told = lambda c, field, kind: F.array_join(F.transform(F.from_json(c, kind), lambda x: x[field].cast("string")), ",")
    phases = told("first", "event_type", "array<struct<event_type:string>>").alias("phases")
    return snapshot(events).select("job_id", "events", "completed", "failed", "progress", phases, "last_ts", told("ring", "event_id", "array<struct<event_id:bigint>>").alias("last_events"))


def unexpired(states: DataFrame, now, hours: float = 24) -> DataFrame:
    """The states whose last event is not ``hours`` before ``now`` (a column: for a stream, its watermark): the batch rule of expiry."""
    return states.filter(F.unix_millis(F.col("last_ts").cast("timestamp")) + int(hours * 3_600_000) > F.unix_millis(now))


def job_states(events: DataFrame, hours: float = 24, late: str = "1 hour", start: DataFrame | None = None) -> DataFrame:
    """The state of every job that a batch touches, in update mode; needs the RocksDB state store.

    ``late``: how far behind an event may come. ``start``: a ``snapshot`` that a new stream goes on from."""
    d = events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    first = None if start is None else start.groupBy("job_id")
    return d.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobState(hours), outputStructType=STATE, outputMode="Update", timeMode="EventTime", initialState=first)


ENDS = ("job_completed", "job_failed", "job_cancelled")
ACCEPTED = "url string, job_id long, ts timestamp, accepted boolean"


class ActiveAddress(StatefulProcessor):
    """Accepts a submission of an address unless a job for it is active; the end of that job releases it.

    Rows of a batch are taken in order of time, ends before submissions. An end that comes before its submission is remembered, so
    that the late submission holds nothing. What never ends is released after ``hours``, by event time."""

    def __init__(self, hours: float = 24) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "job_id long, ms long")
        self.ended = handle.getListState("ended", "job_id long, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lasts = int(self.hours * 3_600_000)
        every = sorted((int(m), k == "submit", int(j), t) for b in rows for m, k, j, t in zip(b["ms"], b["kind"], b["job_id"], b["ts"], strict=True))
        active = tuple(self.active.get()) if self.active.exists() else None
        ended = dict(tuple(x) for x in self.ended.get()) if self.ended.exists() else {}
        out = []
        for ms, submits, job, ts in every:
            if active is not None and active[1] + lasts <= ms:
                active = None
            if not submits:
                if active is not None and active[0] == job:
                    active = None
                else:
                    ended[job] = ms
                continue
            free = active is None
            if free and ended.pop(job, None) is None:
                active = (job, ms)
            out.append((key[0], job, ts, free))
        if active is None:
            self.active.clear()
        else:
            self.active.update(active)
        self.ended.clear()
        if ended:
            self.ended.put(list(ended.items()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [m + lasts for m in (*ended.values(), *([active[1]] if active else []))]
        if due:
            self.handle.registerTimer(max(due))
        if out:
            yield pd.DataFrame(out, columns=["url", "job_id", "ts", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.active.clear()
        self.ended.clear()
        return iter([])

    def close(self) -> None:
        pass


def active_submissions(rows: DataFrame, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """url, job_id, ts and accepted of each submission in a stream of submissions and ends of jobs: rows of url, job_id, ts and kind
    (``submit``, or one of ENDS; others are left out)."""
    d = rows.filter(F.col("kind").isin("submit", *ENDS)).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    return d.groupBy("url").transformWithStateInPandas(statefulProcessor=ActiveAddress(hours), outputStructType=ACCEPTED, outputMode="Append", timeMode="EventTime")


def suppressed(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``requests`` (url, ts) with free: whether no job of ``jobs`` (url, started, ended; ended null while it is active) holds the address
    then. The batch twin of the check: an interval join, here an as-of lookup by address and day, as one job at a time is active.

    Each job is put on the days that it touches; a job beyond 31 days is looked up by address alone."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    end = F.coalesce("ended", F.lit("9999-12-31").cast("timestamp"))
    j = jobs.withColumn("ended", end).withColumn("__days", day(F.col("ended")) - day(F.col("started")))
    brief = j.filter("__days <= 31").withColumn("__day", F.explode(F.sequence(day(F.col("started")), day(F.col("ended")))))
    r = requests.withColumn("__id", F.monotonically_increasing_id()).withColumn("__day", day(F.col("ts")))
    inside = (F.col("ts") >= F.col("started")) & (F.col("ts") < F.col("ended"))
    held = r.join(brief.select("url", "__day", "started", "ended"), ["url", "__day"]).filter(inside).select("__id")
    held = held.unionByName(r.join(j.filter("__days > 31").select("url", "started", "ended"), "url").filter(inside).select("__id")).distinct()
    return r.join(held.withColumn("__held", F.lit(True)), "__id", "left").withColumn("free", F.col("__held").isNull()).drop("__id", "__day", "__held")


def fan_out(sinks: list[Callable[[DataFrame, int], None]], failures: list | None = None, keep: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands each batch to every sink; one that fails does not stop the others.

    ``keep``: a folder for the batches that a sink failed on, by sink and number, so that they can be given to it again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for i, sink in enumerate(sinks):
            try:
                sink(batch, number)
            except Exception as e:  # a subscriber's fault stays with the subscriber
                if failures is not None:
                    failures.append((number, repr(e)))
                if keep is not None:
                    batch.write.mode("overwrite").parquet(f"{keep}/sink={i}/batch={number}")
        batch.unpersist()

    return each


def upsert_latest(path: str, key: str, ts: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the latest row of each key in versions below ``path``; a repeated batch gives the same.

    Each version goes on from the newest one before it, so that numbers may be missing or begin anew."""

    def each(batch: DataFrame, number: int) -> None:
        every = batch
        try:
            stored = batch.sparkSession.read.parquet(path).filter(F.col("version") < number)
            before = stored.agg(F.max("version")).first()[0]
            if before is not None:
                every = stored.filter(F.col("version") == before).select(*batch.columns).unionByName(batch)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        latest = every.groupBy(key).agg(F.max_by(F.struct(*(c for c in batch.columns if c != key)), ts).alias("x")).select(key, "x.*")
        latest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={number}")

    return each
