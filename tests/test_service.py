"""Streams with state, the job table's manifest, statistics from stored parts, tiles that outlive a run."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.operators import bands, geometry, jobs as job_ops, metrics, pixels, store
from platen.plans.fixtures import fixture
from platen.sources import readers
from platen.streaming import manifest, service
from tests.test_print import JOB, job

UPDATES = "event_id long, job_id string, status string, ts timestamp"
START = dt.datetime(2026, 1, 1)


def events(rows):
    return [(k, j, s, START + dt.timedelta(seconds=t)) for k, j, s, t in rows]


def dropped(spark, path, batches, schema=UPDATES):
    """A stream of files, one for each batch that has been dropped so far."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def test_retries_by_timers(spark, tmp_path):
    first = events([(1, "a", "retrying", 0), (2, "b", "retrying", 1), (3, "a", "retrying", 20), (4, "c", "queued", 21)])
    second = events([(5, "a", "retrying", 900), (6, "a", "retrying", 1000), (7, "b", "completed", 1001), (8, "b", "retrying", 1002), (9, "b", "completed", 1004)])
    last = events([(10, "z", "queued", 9000)])
    for batch in (first, second, last):
        service.start_retries(dropped(spark, tmp_path / "in", [batch]), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    planned = found.where("kind = 'planned'").select("event_id", "job_id", "attempt", "final", F.timestamp_millis("due_ms").alias("due"))
    wanted = metrics.retry_policy(spark.createDataFrame(first + second + last, UPDATES))
    assert sorted(map(str, planned.collect())) == sorted(map(str, wanted.collect()))
    # What was planned comes when it is due, but for the last retry of b, which has ended before.
    assert sorted((r.job_id, r.event_id, r.attempt) for r in found.where("kind = 'due'").collect()) == [("a", 1, 1), ("a", 3, 2), ("a", 5, 3), ("b", 2, 1)]


def test_retries_are_forgotten(spark, tmp_path):
    for batch in (events([(1, "a", "retrying", 0), (2, "b", "queued", 5000)]), events([(3, "b", "queued", 9000)]), events([(4, "a", "retrying", 9001)])):
        service.start_retries(dropped(spark, tmp_path / "in", [batch]), str(tmp_path / "out"), str(tmp_path / "c"), once=True, ttl_s=60).awaitTermination()
    assert {r.event_id: r.attempt for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'planned'").collect()} == {1: 1, 4: 1}


def test_intake_remembers_ids_by_state(spark, tmp_path):
    drop = tmp_path / "requests"
    drop.mkdir()
    for k, ids in enumerate((["x", "x"], ["x", "y"], ["y", "z", None])):
        (drop / f"{k}.json").write_text("".join(json.dumps({"job_id": i, "input_path": "p", "output_path": "o", "params": {"cols": 2}}) + "\n" for i in ids))
        service.start_intake(readers.job_stream(spark, str(drop)), str(tmp_path / "jobs"), str(tmp_path / "messages"), str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "jobs")).collect()) == ["x", "y", "z"]
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "messages")).collect()) == ["x", "y", "z"]


def update(spark, tmp_path, k, rows):
    states = tmp_path / "states"
    states.mkdir(exist_ok=True)
    (states / f"{k}.json").write_text("".join(json.dumps({"event_id": 100 * k + n, "job_id": j, "status": s, "ts": f"2026-01-01T00:{k:02d}:00Z"}) + "\n" for n, (j, s) in enumerate(rows)))
    service.start_status(readers.status_stream(spark, str(states)), str(tmp_path / "table"), str(tmp_path / "c"), once=True, buckets=4).awaitTermination()


def test_job_table_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "KEPT", 2)
    jobs = [f"job{k}" for k in range(12)]
    update(spark, tmp_path, 0, [(j, "queued") for j in jobs])
    for k in range(1, 7):
        update(spark, tmp_path, k, [("job1", f"step{k}")])
    found = {r.job_id: r.status for r in service.read_status(spark, str(tmp_path / "table")).collect()}
    assert found == {j: "queued" for j in jobs} | {"job1": "step6"}
    assert {r.job_id: r.status for r in service.read_status(spark, str(tmp_path / "table"), 6).collect()}["job1"] == "step5"
    kept = manifest.Buckets(spark, str(tmp_path / "table"))
    assert kept.epochs() == [5, 6]
    assert sorted(p.name for p in (tmp_path / "table").glob("version=*")) == ["version=0", "version=5", "version=6"]
    assert len(list((tmp_path / "table" / "version=0").glob("bucket=*"))) == 3  # of four; job1's own is newer


def test_job_table_after_a_crash_between_data_and_manifest(spark, tmp_path):
    update(spark, tmp_path, 0, [("a", "queued"), ("b", "queued")])
    table = str(tmp_path / "table")
    kept = manifest.Buckets(spark, table)
    live = kept.live()
    # A batch that wrote its data, and perhaps half a manifest, and broke down.
    spark.createDataFrame([("a", "lost", None, None, k) for k in live], service.STATUS + ", bucket int").write.partitionBy("bucket").parquet(f"{table}/version=1")
    (tmp_path / "table.manifest" / "000000000001.json.tmp").write_text("{")
    assert {r.job_id: r.status for r in service.read_status(spark, table).collect()} == {"a": "queued", "b": "queued"}
    update(spark, tmp_path, 1, [("a", "completed")])  # it runs again
    assert {r.job_id: r.status for r in service.read_status(spark, table).collect()} == {"a": "completed", "b": "queued"}
    assert manifest.Buckets(spark, table).live(1) == live
    nothing = manifest.Buckets(spark, str(tmp_path / "none"))
    assert nothing.live() == {} and nothing.read(service.STATUS, {}).isEmpty()


def test_statistics_from_stored_parts(spark, sf_dir, tmp_path):
    samples = fixture(spark, sf_dir, "latency_samples")
    for part in range(10):
        metrics.store_part(samples.where(F.col("sample_id") % 10 == part), ["stage"], str(tmp_path), f"day{part}")
    metrics.store_part(samples.where("sample_id % 10 = 3"), ["stage"], str(tmp_path), "day3")  # again: it replaces itself
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(metrics.stored_latency_stats(spark, str(tmp_path), ["stage"])) == rows(metrics.latency_stats(samples, ["stage"]))
    some = metrics.stored_latency_stats(spark, str(tmp_path), ["stage"], ["day1", "day4"])
    assert rows(some) == rows(metrics.latency_stats(samples.where("sample_id % 10 in (1, 4)"), ["stage"]))
    low = spark.createDataFrame([("s", n) for n in (-5, -5, 0, 0, 1, 2**40)], "stage string, ns long")
    metrics.store_part(low, ["stage"], str(tmp_path / "low"), "x")
    assert rows(metrics.stored_latency_stats(spark, str(tmp_path / "low"), ["stage"])) == rows(metrics.latency_stats(low, ["stage"]))


def test_tiles_outlive_a_run(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, 6, 5, 3, 18, bytearray(r.integers(0, 256, 90, dtype=np.uint8).tobytes())) for k in range(3)]
    frames = spark.createDataFrame([*rows, (7, *rows[0][1:])], pixels.FRAMES)  # frame 7 is frame 0 again
    made = spark.createDataFrame([job(k, 2.1, 2.9, 2, 2, 1, 1, 8, frame=f) for k, f in ((1, 0), (2, 1), (3, 7), (4, 55))], JOB)
    path = str(tmp_path / "tiles")
    key = lambda df: sorted((x.job_id, x.band, bytes(x.data)) for x in df.collect())
    want = key(bands.render_jobs(frames, made))
    assert key(store.render_jobs(frames, made, path)) == want
    assert store.read_store(spark, path).count() == 2  # two contents, for three frames
    rendered = []
    whole = bands.make_tiles
    monkeypatch.setattr(bands, "make_tiles", lambda f, t: rendered.append(t.count()) or whole(f, t))
    assert key(store.render_jobs(frames, made, path)) == want and rendered == [0]
    more = made.unionByName(spark.createDataFrame([job(9, 2.1, 2.9, 2, 2, 1, 1, 8, frame=2)], JOB))
    assert len(key(store.render_jobs(frames, more, path))) == len(want) + len(want) // 4 and rendered == [0, 1]
    store.read_store(spark, path).write.mode("append").partitionBy("shard").parquet(str(tmp_path / "twice"))
    store.read_store(spark, path).write.mode("append").partitionBy("shard").parquet(str(tmp_path / "twice"))
    sheets = geometry.sane_sheets(made)
    twice = store.stored_tiles(frames, job_ops.dedupe_tiles(sheets), str(tmp_path / "twice"))
    assert twice.count() == 3


def test_scrape_stream(spark, tmp_path):
    schema = "request_id long, ts timestamp, latency_s double"
    one = [(k, START + dt.timedelta(seconds=k), k / 10) for k in range(12)]
    late = [(20, START + dt.timedelta(seconds=2), 9.0), (21, START + dt.timedelta(hours=1), 0.5)]
    for batch in (one, late, [(30, START + dt.timedelta(hours=2), 0.1)]):
        service.start_scrape(dropped(spark, tmp_path / "in", [batch], schema), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    found = {(r.scraped_at, r.requests, r.max_latency_s) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted = {tuple(r) for r in metrics.scrape_windows(spark.createDataFrame(one + late, schema)).collect()}
    assert found == wanted  # ten minutes late is in time; the last window is still open


@pytest.mark.parametrize("gap_s", [30, 3600])
def test_trace_stream(spark, tmp_path, gap_s):
    asked = [(f"t{k}", START + dt.timedelta(seconds=k)) for k in range(4)]
    work = [("t1", START + dt.timedelta(seconds=1 + gap_s)), ("t1", START + dt.timedelta(seconds=5)), ("t9", START), ("t3", START)]  # t3's began before it was asked
    a = dropped(spark, tmp_path / "a", [asked], "trace_id string, ts timestamp")
    b = dropped(spark, tmp_path / "b", [work], "trace_id string, started_at timestamp")
    service.join_traces(a, b).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r.trace_id, r.started_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted((t, s) for t, s in work if t == "t1" and s <= START + dt.timedelta(seconds=601))


def test_options_and_samples(spark, tmp_path):
    (tmp_path / "o.csv").write_text("job_id,preset,opt_cols,opt_gap,opt_width,opt_mode,input_format,input_width,input_stride,output_path\n1,passport-45x35,3,,4.5,fill,encoded,,,out.pdf\n2,,x,-1,,,raw-rgb24,8,24,o.jpg\n")
    rows = readers.read_job_options(spark, str(tmp_path / "o.csv")).orderBy("job_id").collect()
    assert (rows[0].preset, rows[0].opt_cols, rows[0].opt_gap, rows[1].preset, rows[1].input_stride) == ("passport-45x35", "3", None, None, "24")
    spark.range(5).write.parquet(str(tmp_path / "s"))
    assert readers.read_samples(spark, str(tmp_path / "s")).count() == 5
