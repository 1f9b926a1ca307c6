"""The service's streams over file drops; each uses the functions of the batch operators.

Every query takes a checkpoint folder; ``once=True`` works off what is there
(availableNow). Late rows: later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from platen.functions import gates
from platen.operators import bands, geometry, jobs as job_ops, metrics
from platen.sources import readers, sinks
from platen.streaming.manifest import Buckets

WATERMARK = "10 minutes"
#: How long the ids of accepted jobs are remembered.
REMEMBERED = "7 days"
STATUS = "job_id string, status string, logs string, error string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def start_intake(requests: DataFrame, jobs_path: str, messages_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Requests -> queued job records and queue messages with all that a worker needs.

    A job id is accepted once within REMEMBERED: the ids of that time are the query's
    state, so what a batch costs doesn't grow with all that came before. A batch that
    is run again overwrites its own folder. A message's frame goes by its input path,
    as in ``readers.read_photos``.
    """
    arrived = requests.where("job_id is not null").withColumn("_arrived", F.current_timestamp())
    fresh = arrived.withWatermark("_arrived", REMEMBERED).dropDuplicatesWithinWatermark(["job_id"]).drop("_arrived")

    def accept(batch: DataFrame, epoch: int) -> None:
        planned = job_ops.service_payload(batch).withColumns({"frame_id": F.xxhash64("input"), "abi_version": F.lit(gates.JOB_ABI)})
        planned = job_ops.with_defaults(planned)
        records = planned.select("job_id", "input", "output", F.lit("queued").alias("status"))
        records.write.mode("overwrite").parquet(f"{jobs_path}/epoch={epoch}")
        planned.write.mode("overwrite").parquet(f"{messages_path}/epoch={epoch}")

    return _start(fresh.writeStream.foreachBatch(accept), checkpoint, once)


def start_worker(messages: DataFrame, frames: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Jobs -> rendered bands and their states; the output of a batch is one folder, so a rerun doesn't repeat it."""

    def work(batch: DataFrame, epoch: int) -> None:
        rendered = bands.render_jobs(frames, batch)
        rendered.write.mode("overwrite").parquet(f"{out}/bands/epoch={epoch}")
        done = batch.sparkSession.read.parquet(f"{out}/bands/epoch={epoch}").select("job_id").distinct().withColumn("_done", F.lit(True))
        states = batch.select("job_id").join(done, "job_id", "left").select("job_id", F.explode(F.array(F.lit("processing"), F.when(F.col("_done"), "completed").otherwise("failed"))).alias("status"))
        states.write.mode("overwrite").parquet(f"{out}/states/epoch={epoch}")

    return _start(messages.writeStream.foreachBatch(work), checkpoint, once)


def read_status(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The job table that ``start_status`` keeps (as it was before a batch, of the last few): the folders that its manifest names."""
    buckets = Buckets(spark, table)
    return buckets.read(STATUS, buckets.live(before))


def start_status(updates: DataFrame, table: str, checkpoint: str, once: bool = False, buckets: int = 64) -> StreamingQuery:
    """Status updates -> the job table, by buckets of job ids; a batch writes a version of the buckets that it touches and leaves the others.

    The manifest is written last (see ``manifest``), so a batch that broke down has
    changed nothing. ``buckets`` stays what it was when the table began.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        kept = Buckets(batch.sparkSession, table)
        of = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
        touched = [r.bucket for r in batch.select(of.alias("bucket")).distinct().collect()]  # at most ``buckets``
        current = kept.read(STATUS, {k: v for k, v in kept.live(epoch).items() if k in touched}).select("job_id", "status", "logs", "error")
        sinks.upsert_jobs(current, batch).withColumn("bucket", of).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={epoch}")
        kept.commit(epoch, touched)

    return _start(updates.writeStream.foreachBatch(merge), checkpoint, once)


def start_scrape(requests: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Windows of request metrics, each written once it can't change any more."""
    windows = metrics.scrape_windows(requests.withWatermark("ts", WATERMARK), every)
    return _start(windows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, once)


def start_log_index(lines: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Text lines of JSON -> the log index, by day and level."""
    logs = metrics.log_gate(readers.parse_app_logs(lines, "value")).withColumn("day", F.to_date("time"))
    return _start(logs.writeStream.outputMode("append").format("parquet").option("path", path).partitionBy("day", "level"), checkpoint, once)


def join_traces(requests: DataFrame, work: DataFrame, within: str = "10 minutes") -> DataFrame:
    """A stream-stream join of requests (trace_id, ts) and the work they started (trace_id, started_at)."""
    a = requests.withWatermark("ts", WATERMARK).alias("a")
    b = work.withColumnRenamed("trace_id", "_trace").withWatermark("started_at", WATERMARK).alias("b")
    near = F.expr(f"started_at >= ts and started_at <= ts + interval {within}")
    return a.join(b, (F.col("trace_id") == F.col("_trace")) & near).drop("_trace")


class Retries(StatefulProcessor):
    """Of each job: its number of retries, those that wait for their time, and when all of that is forgotten."""

    def __init__(self, max_retries: int, backoff_ms: int, ttl_ms: int):
        self.max_retries, self.backoff_ms, self.ttl_ms = max_retries, backoff_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n long, last_ms long")
        self.waiting = handle.getMapState("waiting", "event_id long", "attempt long, due_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        updates = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # of one job in one batch
        n, last = self.attempts.get() if self.attempts.exists() else (0, 0)
        out = []
        for u in updates.itertuples():
            ms = int(u.ts.timestamp() * 1000)
            last = max(last, ms)
            if u.status == "retrying":
                n += 1
                due = None if n > self.max_retries else ms + self.backoff_ms
                out.append((key[0], int(u.event_id), n, due is None, due, "planned"))
                if due is not None:
                    self.waiting.updateValue((int(u.event_id),), (n, due))
                    self.handle.registerTimer(due)
            elif u.status in ENDED and self.waiting.exists():
                for event in [e for e, v in self.waiting.iterator() if v[1] > ms]:
                    self.waiting.removeKey(event)
        self.attempts.update((n, last))
        self.handle.registerTimer(last + self.ttl_ms)
        yield _retries(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = [(e[0], *v) for e, v in self.waiting.iterator() if v[1] <= at] if self.waiting.exists() else []
        for event, _, _ in due:
            self.waiting.removeKey((event,))
        if self.attempts.exists() and at >= self.attempts.get()[1] + self.ttl_ms:
            self.attempts.clear()
            self.waiting.clear()
        yield _retries([(key[0], event, n, False, when, "due") for event, n, when in sorted(due, key=lambda d: (d[2], d[0]))])


ENDED = ("completed", "failed")
RETRIES = "job_id string, event_id long, attempt long, final boolean, due_ms long, kind string"


def _retries(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RETRIES.split(", ")])
    return frame.astype({"event_id": "int64", "attempt": "int64", "final": "bool", "due_ms": "Int64"})


def retry_states(updates: DataFrame, max_retries: int = 3, backoff_s: int = 5, ttl_s: int = 3600) -> DataFrame:
    """A stream of status updates -> RETRIES: a row of kind ``planned`` for each retry, as ``metrics.retry_policy`` has it, and one of kind ``due`` when its time has come.

    Time is the updates' own: timers fire once the watermark has passed them. A job
    that ends takes the retries with it that are due later; the state of a job without updates for
    ``ttl_s`` is forgotten. The query needs the state store that ``start_retries`` sets.
    """
    timed = updates.select("job_id", "event_id", "status", "ts").withWatermark("ts", WATERMARK)
    return timed.groupBy("job_id").transformWithStateInPandas(Retries(max_retries, backoff_s * 1000, ttl_s * 1000), RETRIES, "Append", "EventTime")


def start_retries(updates: DataFrame, path: str, checkpoint: str, once: bool = False, **limits: int) -> StreamingQuery:
    """``retry_states`` to Parquet."""
    spark = updates.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return _start(retry_states(updates, **limits).writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, once)
    finally:
        spark.conf.set(STATE_STORE, before)


def rate_limited(requests: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """Streams (client, request_id, accepted): the first ``limit`` requests of a client in each tumbling window, as they come.

    The state is a count for each client and window, forgotten once the watermark has
    passed the window; requests of one micro-batch go by their times.
    """

    def each(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        state.update((seen + len(rows),))
        state.setTimeoutTimestamp(max(int(key[1]) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"].to_numpy(), "accepted": [p < limit for p in range(seen, seen + len(rows))]})

    dealt = requests.withWatermark("ts", WATERMARK).withColumn("_end", F.window("ts", window)["end"].cast("long")).groupBy("client", "_end")
    kind = dict(requests.dtypes)
    schema = f"client {kind['client']}, request_id {kind['request_id']}, accepted boolean"
    return dealt.applyInPandasWithState(each, schema, "seen long", "append", "EventTimeTimeout")


def plan_stream(jobs: DataFrame) -> DataFrame:
    """Sheet plans of a stream of jobs, by the same columns as in batch."""
    return geometry.grid_geometry(jobs)
