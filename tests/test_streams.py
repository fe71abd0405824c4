"""Streams end to end: availableNow over files, compared with the batch result."""

import os

import pytest
from pyspark.sql import functions as F

from hearthline.streaming import progress as P

ROWS = [(i, 1000 + 60 * i, i % 4, ("job_started", "node_started", "node_completed", "node_failed")[i % 4 if i > 4 else 0], i % 5, float(i % 7)) for i in range(200)]


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def files(spark, folder, parts=2):
    d = spark.createDataFrame(ROWS, "event_id long, s long, job_id long, event_type string, node long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s").select("event_id", "ts", "job_id", "event_type", "node", "value")
    for k in range(parts):
        d.filter(F.floor(F.col("event_id") / (len(ROWS) // parts)) == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def run(df, sink, mode, checkpoint):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_windows_and_late_rows(spark, tmp_path):
    batch = files(spark, str(tmp_path / "in"))
    out = {}

    def sink(d, _):
        out.update({(r.start, r.event_type): r.n for r in d.collect()})

    run(P.counts_by_window(P.read(spark, str(tmp_path / "in"), batch.schema, maxFilesPerTrigger="1"), "10 minutes", late="10 minutes"), sink, "update", str(tmp_path / "c"))
    assert out == {(r.start, r.event_type): r.n for r in P.counts_by_window(batch, "10 minutes").collect()}
    # a row far behind the watermark is dropped when the query goes on from its checkpoint
    batch.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(0))).withColumn("event_type", F.lit("late")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(P.counts_by_window(P.read(spark, str(tmp_path / "in"), batch.schema), "10 minutes", late="10 minutes"), sink, "update", str(tmp_path / "c"))
    assert not any(k == "late" for _, k in out)


def test_job_states(spark, tmp_path):
    batch = files(spark, str(tmp_path / "in"))
    out = {}

    def sink(d, _):
        out.update({r.job_id: r for r in d.collect()})

    run(P.job_states(P.read(spark, str(tmp_path / "in"), batch.schema, maxFilesPerTrigger="1")), sink, "update", str(tmp_path / "c"))
    want = {r.job_id: r.asDict() for r in P.batch_states(batch).collect()}
    assert len(want) == 4 and {k: r.asDict() for k, r in out.items()} == want
    assert out[0].phases.startswith("job_started")


def test_job_states_expire_by_event_time(spark, tmp_path, monkeypatch):
    """Jobs expire when the watermark is past their last event by the hours; the batch rule says the same, however late all is run."""
    monkeypatch.setattr(P, "RING", 5)
    day = 86_400
    rows = [(i, 1000 + 60 * i, 0, "node_started", 1, 1.0) for i in range(50)] + [(100, 3 * day, 1, "node_started", 1, 1.0), (101, 3 * day + 60, 2, "node_started", 1, 1.0), (102, 3 * day + 120, 0, "node_completed", 1, 2.0), (103, 3 * day + 180, 1, "node_failed", 1, 0.5)]
    d = spark.createDataFrame(rows, "event_id long, s long, job_id long, event_type string, node long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s").select("event_id", "ts", "job_id", "event_type", "node", "value")
    out = {}

    def sink(x, _):
        out.update({r.job_id: r for r in x.collect()})

    states = lambda: P.job_states(P.read(spark, str(tmp_path / "in"), d.schema), hours=24, late="1 hour")
    for part, _ in (("event_id < 100", 0), ("event_id IN (100, 101)", 1), ("event_id > 101", 2)):
        d.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(states(), sink, "update", str(tmp_path / "c"))
        if part == "event_id < 100":
            assert out[0].events == 50 and out[0].last_events.split(",")[-5:] == ["45", "46", "47", "48", "49"]
    left = {r.job_id for r in P.unexpired(P.batch_states(d.filter("event_id < 102")), F.timestamp_seconds(F.lit(3 * day + 60 - 3600))).collect()}
    assert left == {1, 2}
    assert (out[0].events, out[0].completed, out[0].last_events) == (1, 1, "102") and (out[1].events, out[1].failed) == (2, 1)


def test_job_states_go_on_from_a_snapshot(spark, tmp_path):
    batch = files(spark, str(tmp_path / "all"))
    batch.filter("event_id >= 120").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = {}

    def sink(d, _):
        out.update({r.job_id: r for r in d.collect()})

    start = P.snapshot(batch.filter("event_id < 120"))
    run(P.job_states(P.read(spark, str(tmp_path / "in"), batch.schema), start=start), sink, "update", str(tmp_path / "c"))
    assert {k: r.asDict() for k, r in out.items()} == {r.job_id: r.asDict() for r in P.batch_states(batch).collect()}


def test_active_addresses(spark, tmp_path):
    """A second submission is dropped while the job runs, accepted after its end; ends may come late or early; what never ends expires."""
    day = 86_400
    batches = [
        [("u", 1, 10, "submit"), ("u", 2, 20, "submit"), ("v", 3, 20, "submit"), ("u", 1, 30, "node_started")],
        [("u", 1, 40, "job_completed"), ("u", 4, 50, "submit"), ("u", 5, 60, "submit"), ("v", 9, 45, "job_failed"), ("v", 6, 70, "submit"), ("w", 7, 80, "job_cancelled")],
        [("w", 7, 75, "submit"), ("w", 8, 90, "submit"), ("u", 10, 2 * day, "submit")],
        [("v", 11, 2 * day + 5, "submit"), ("v", 12, 2 * day + 6, "submit")],
    ]
    out = {}

    def sink(d, _):
        out.update({r.job_id: r.accepted for r in d.collect()})

    schema = "url string, job_id long, s long, kind string"
    for rows in batches:
        d = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(P.active_submissions(P.read(spark, str(tmp_path / "in"), d.schema)), sink, "append", str(tmp_path / "c"))
    assert out == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True, 8: True, 10: True, 11: True, 12: False}


def test_suppressed_requests(spark):
    s = lambda c: F.timestamp_seconds(c)
    jobs = spark.createDataFrame([("u", 10, 40), ("u", 50, None), ("v", 0, 90 * 86_400), ("w", 86_000, 87_000)], "url string, a long, z long").select("url", s("a").alias("started"), s("z").alias("ended"))
    want = [("u", 9, True), ("u", 10, False), ("u", 39, False), ("u", 40, True), ("u", 10**9, False), ("v", 86_400, False), ("v", 90 * 86_400, True), ("w", 86_500, False), ("w", 87_000, True), ("x", 1, True), (None, 1, True), ("u", 9, True)]
    got = P.suppressed(spark.createDataFrame([x[:2] for x in want], "url string, t long").withColumn("ts", s("t")), jobs).collect()
    assert sorted((str(r.url), r.t, r.free) for r in got) == sorted((str(u), t, f) for u, t, f in want)


def test_fan_out_and_upsert(spark, tmp_path):
    batch = files(spark, str(tmp_path / "in"))
    seen, failures = [], []

    def broken(d, n):
        raise RuntimeError("no")

    target = str(tmp_path / "latest")
    sinks = P.fan_out([broken, lambda d, n: seen.append(d.count()), P.upsert_latest(target, "job_id", "ts")], failures, str(tmp_path / "kept"))
    run(P.read(spark, str(tmp_path / "in"), batch.schema, maxFilesPerTrigger="1"), sinks, "append", str(tmp_path / "c"))
    assert sum(seen) == len(ROWS) and len(failures) == len(seen)
    assert spark.read.parquet(str(tmp_path / "kept")).filter("sink = 0").count() == len(ROWS)
    P.upsert_latest(target, "job_id", "ts")(batch.filter("event_id < 9"), 7)  # numbers may be missing, old rows change nothing
    last = sorted(os.listdir(target))[-1]
    got = {r.job_id: r.event_id for r in spark.read.parquet(f"{target}/{last}").collect()}
    assert got == {r.job_id: r.e for r in batch.groupBy("job_id").agg(F.max("event_id").alias("e")).collect()}


def test_first_submissions(spark, tmp_path):
    d = spark.createDataFrame([(f"u{i % 3}", 1000 + i) for i in range(30)], "url string, s long").withColumn("ts", F.timestamp_seconds("s"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    run(P.first_submissions(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "url", "ts", "1 hour"), lambda b, _: out.extend(r.url for r in b.collect()), "append", str(tmp_path / "c"))
    assert sorted(out) == ["u0", "u1", "u2"]
