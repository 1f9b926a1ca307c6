"""Telemetry: core metrics, latency statistics by nearest rank, reports, histograms, logs, spans and job states."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.functions.numbers import idiv

LATENCY, ERROR = 1, 2
TARGET_MS, TARGET_OPS = 2.0, 100_000.0
#: Upper bounds of a histogram of seconds, the default of the common client library.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def core_metrics(samples: DataFrame) -> DataFrame:
    return samples.groupBy("core_id").agg(F.count("*").alias("requests"), F.sum("ns").alias("cycles"), F.max("ns").alias("max_ns"), F.min("ns").alias("min_ns"))


def metrics_rollup(cores: DataFrame) -> DataFrame:
    """Totals over all cores; the average is a whole number, 0 without requests."""
    total = cores.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("total"), F.coalesce(F.sum("cycles"), F.lit(0)).alias("cycles"), F.coalesce(F.max("max_ns"), F.lit(0)).alias("max_ns"))
    return total.select("total", F.when(F.col("total") > 0, idiv(F.col("cycles"), F.col("total"))).otherwise(F.lit(0).cast("long")).alias("avg_ns"), "max_ns")


def prometheus_text(rollup: DataFrame) -> DataFrame:
    """(line_no, line) of the text exposition."""
    lines = F.array(*(F.format_string(f"img_{n} %d", F.col(c)) for n, c in (("requests_total", "total"), ("latency_avg", "avg_ns"), ("latency_max", "max_ns"))))
    return rollup.select(F.posexplode(lines).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")


def _bucket(ns: Column) -> Column:
    """A value's leading bits, so that buckets are in the order of their values; there are at most 64 * 1024 of them."""
    bits = F.length(F.bin(ns)).cast("int")
    return F.when(ns < 0, F.lit(-1).cast("long")).otherwise(bits * F.lit(2048).cast("long") + F.call_function("shiftright", ns, F.greatest(bits - 11, F.lit(0))))


def counted_values(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, ns, c, _bucket): how often each value occurs. Tables of this form merge by adding c."""
    return samples.groupBy(*by, "ns").agg(F.count("*").alias("c")).withColumn("_bucket", _bucket(F.col("ns")))


def bucket_histogram(values: DataFrame, by: list[str]) -> DataFrame:
    """``counted_values`` -> (by, _bucket, n, total, min_ns, max_ns). Tables of this form merge exactly: sums are added, bounds are taken."""
    return values.groupBy(*by, "_bucket").agg(F.sum("c").alias("n"), F.sum(F.col("ns") * F.col("c")).alias("total"), F.min("ns").alias("min_ns"), F.max("ns").alias("max_ns"))


def _ranked(values: DataFrame, buckets: DataFrame, by: list[str], places: dict[str, Column], avg: Column) -> DataFrame:
    """Totals of each group and its values at the places (from 0).

    Only the buckets that hold a wanted place are ranked value by value; so no task
    sorts a group, and of stored values only those buckets are read.
    """
    group = Window.partitionBy(*by)
    whole = {"_n": F.sum("n"), "_total": F.sum("total"), "_min": F.min("min_ns"), "_max": F.max("max_ns")}
    upto = F.sum("n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    buckets = buckets.select(*by, "_bucket", (upto - F.col("n")).alias("_low"), upto.alias("_high"), *(x.over(group).alias(k) for k, x in whole.items()))
    buckets = buckets.select(*by, "_bucket", "_low", "_high", F.col("_n").alias("n"), F.col("_total").alias("total"), F.col("_min").alias("min_ns"), F.col("_max").alias("max_ns"))
    held = {k: (F.col("_low") <= p) & (p < F.col("_high")) for k, p in places.items()}
    wanted = buckets.where(reduce(or_, held.values()))
    within = Window.partitionBy(*by, "_bucket").orderBy("ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(wanted, [*by, "_bucket"]).withColumn("_upto", F.col("_low") + F.sum("c").over(within))
    picks = ranked.groupBy(*by, "n", "total", "min_ns", "max_ns").agg(*(F.min(F.when(held[k] & (F.col("_upto") > p), F.col("ns"))).alias(k) for k, p in places.items()))
    return picks.withColumn("avg_ns", avg)


def _stats(samples: DataFrame, by: list[str], places: dict[str, Column], avg: Column) -> DataFrame:
    values = counted_values(samples, by)
    return _ranked(values, bucket_histogram(values, by), by, places, avg)


def store_part(samples: DataFrame, by: list[str], path: str, part: str) -> None:
    """A part (say, a day) of the samples as counted values, sorted by bucket, and their histogram; a part that is stored again replaces itself."""
    target = f"{path}/values/part={part}"
    counted_values(samples, by).repartitionByRange("_bucket").sortWithinPartitions("_bucket", *by, "ns").write.mode("overwrite").parquet(target)
    bucket_histogram(samples.sparkSession.read.parquet(target), by).write.mode("overwrite").parquet(f"{path}/histogram/part={part}")


def stored_latency_stats(spark: SparkSession, path: str, by: list[str], parts: list[str] | None = None) -> DataFrame:
    """``latency_stats`` of all stored parts (or of some): histograms are merged, and values are read and merged only in the buckets that hold a wanted rank."""

    def chosen(kind: str) -> DataFrame:
        table = spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
        return table if parts is None else table.where(F.col("part").cast("string").isin(parts))

    merged = chosen("histogram").groupBy(*by, "_bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min_ns").alias("min_ns"), F.max("max_ns").alias("max_ns"))
    values = chosen("values").groupBy(*by, "_bucket", "ns").agg(F.sum("c").alias("c"))
    return _latency(_ranked(values, merged, by, _nearest_ranks(), _average()), by)


def _nearest_ranks() -> dict[str, Column]:
    return {f"p{p}_ns": F.floor(F.lit(p / 100) * (F.col("n") - 1) + 0.5) for p in (50, 95, 99)}


def _average() -> Column:
    return (F.col("total").cast("double") / F.col("n").cast("double")).cast("long")


def _latency(ranked: DataFrame, by: list[str]) -> DataFrame:
    rate = F.when(F.col("avg_ns") > 0, F.lit(1e9) / F.col("avg_ns")).otherwise(0.0)
    return ranked.select(*by, "n", "avg_ns", "p50_ns", "p95_ns", "p99_ns", "min_ns", "max_ns", rate.alias("throughput"))


def latency_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, avg_ns, p50_ns, p95_ns, p99_ns, min_ns, max_ns, throughput): place floor(p * (n - 1) + 0.5)."""
    return _latency(_stats(samples, by, _nearest_ranks(), _average()), by)


def decoder_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """As latency_stats, by the decoder's rule: place n * p / 100 cut off, whole average."""
    places = {f"p{p}_ns": idiv(F.col("n") * p, 100) for p in (50, 99)}
    return _stats(samples, by, places, idiv(F.col("total"), F.col("n"))).select(*by, "n", "avg_ns", "p50_ns", "p99_ns", "min_ns", "max_ns")


def run_report(samples: DataFrame, total_s: float | Column) -> DataFrame:
    ok = F.col("success")
    out = samples.agg(F.count("*").alias("runs"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg(F.when(ok, F.col("ns"))), F.lit(0.0)).alias("avg_ns"))
    total = total_s if isinstance(total_s, Column) else F.lit(total_s)
    return out.withColumn("throughput", F.when(total > 0, F.col("succeeded") / total).otherwise(0.0))


def scorecard(stats: DataFrame) -> DataFrame:
    """(stage, check, measured, passed) against the latency and throughput targets."""
    each = F.array(
        F.struct(F.lit("avg_ms").alias("check"), (F.col("avg_ns") / 1e6).alias("measured"), (F.col("avg_ns") / 1e6 <= TARGET_MS).alias("passed")),
        F.struct(F.lit("p99_ms").alias("check"), (F.col("p99_ns") / 1e6).alias("measured"), (F.col("p99_ns") / 1e6 <= TARGET_MS).alias("passed")),
        F.struct(F.lit("throughput").alias("check"), F.col("throughput").alias("measured"), (F.col("throughput") >= TARGET_OPS).alias("passed")),
    )
    return stats.select("stage", F.explode(each).alias("s")).select("stage", "s.check", "s.measured", F.when(F.col("s.passed"), "PASS").otherwise("FAIL").alias("verdict"))


def time_share(stats: DataFrame) -> DataFrame:
    """Decode, render and other time as parts of the cold path (1.0 ms if that is 0); one row."""
    ms = lambda stage: F.coalesce(F.max(F.when(F.col("stage") == stage, F.col("avg_ns"))), F.lit(0)) / 1e6
    one = stats.agg(ms("decode").alias("decode_ms"), ms("render").alias("render_ms"), ms("cold").alias("cold_ms"))
    one = one.withColumn("other_ms", F.greatest(F.col("cold_ms") - F.col("decode_ms") - F.col("render_ms"), F.lit(0.0)))
    whole = F.when(F.col("cold_ms") > 0, F.col("cold_ms")).otherwise(1.0)
    return one.select("decode_ms", "render_ms", "other_ms", *((F.col(f"{k}_ms") / whole * 100).alias(f"{k}_pct") for k in ("decode", "render", "other")))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint").agg(F.count("*").alias("requests"))


def latency_histogram(requests: DataFrame, by: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by, le, observations): cumulative counts; one pass, then one row for each bound."""
    sums = requests.groupBy(*by).agg(*(F.count_if(F.col("latency_s") <= b).alias(f"b{k}") for k, b in enumerate(buckets)), F.count("latency_s").alias("all"))
    bounds = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("observations")) for k, b in enumerate(buckets)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("observations")))
    return sums.select(*by, F.explode(bounds).alias("x")).select(*by, "x.*")


def attempts_vs_success(lifecycle: DataFrame) -> DataFrame:
    """Attempts are entries into processing; enqueued jobs are counted as such, not as processed."""
    s = F.col("status")
    return lifecycle.agg(F.count_if(s == "processing").alias("attempts"), F.count_if(s == "completed").alias("successes"), F.count_if(s == "queued").alias("enqueued"), F.count_if(s == "failed").alias("failures"))


def span_durations(spans: DataFrame) -> DataFrame:
    return spans.withColumn("ns", F.col("end_ns") - F.col("start_ns"))


def binlog_text(binlog: DataFrame) -> DataFrame:
    """Adds ``line``, the entry as text by its event."""
    event = F.col("event_id")
    line = F.when(event == LATENCY, F.format_string("[LAT] %d cycles count=%d extra=%d", "arg0", "arg1", "arg2")).when(event == ERROR, F.format_string("[ERR] code=%d", "arg0")).otherwise(F.format_string("[UNK] event=%d", "event_id"))
    return binlog.withColumn("line", line)


def binlog_summary(binlog: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_id") == LATENCY, "LATENCY").when(F.col("event_id") == ERROR, "ERROR").otherwise("UNKNOWN")
    return binlog.groupBy(kind.alias("event")).agg(F.count("*").alias("entries"), F.sum("arg0").alias("arg0_sum"), F.max("arg0").alias("arg0_max"), F.countDistinct("cpu").alias("cpus"))


def status_latest(lifecycle: DataFrame) -> DataFrame:
    """The latest status of each job; ties on the time go to the later event."""
    at = F.struct("ts", "event_id")
    return lifecycle.groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.max("ts").alias("updated_at"), F.count("*").alias("updates"))


def retry_policy(lifecycle: DataFrame, max_retries: int = 3, backoff_s: int = 5) -> DataFrame:
    """(event_id, job_id, attempt, final, due): the n-th retry of a job; retries beyond the limit are final failures without a due time."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    tries = lifecycle.where("status = 'retrying'").withColumn("attempt", F.row_number().over(order).cast("long"))
    final = F.col("attempt") > max_retries
    return tries.select("event_id", "job_id", "attempt", final.alias("final"), F.when(~final, F.col("ts") + F.make_dt_interval(secs=F.lit(backoff_s))).alias("due"))


def rate_limit(requests: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """Adds ``accepted``: the first ``limit`` requests of a client in each tumbling window."""
    order = Window.partitionBy("client", F.window("ts", window)).orderBy("ts", "request_id")
    return requests.withColumn("accepted", F.row_number().over(order) <= limit)


def scrape_windows(requests: DataFrame, every: str = "5 seconds") -> DataFrame:
    out = requests.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("requests"), F.max("latency_s").alias("max_latency_s"))
    return out.select(F.col("w.start").alias("scraped_at"), "requests", "max_latency_s")


def trace_join(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """Requests with the spans of their trace; an equi-join, so a busy trace may be split by Spark."""
    return requests.join(spans, "trace_id")


def trace_totals(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace_id, pairs, ns): of each trace, the pairs that ``trace_join`` would make and their spans' time; both sides are counted first, no pair is made."""
    asked = requests.groupBy("trace_id").agg(F.count("*").alias("requests"))
    spent = spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.sum("ns").alias("spent"))
    return asked.join(spent, "trace_id").select("trace_id", (F.col("requests") * F.col("spans")).alias("pairs"), (F.col("requests") * F.col("spent")).alias("ns"))


def log_gate(logs: DataFrame, length: int = 255) -> DataFrame:
    """Lines of level INFO and above, messages cut to the log's length."""
    level = {"DEBUG": 0, "INFO": 1, "WARN": 2, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}
    order = F.create_map(*(F.lit(x) for kv in level.items() for x in kv))
    return logs.where(F.coalesce(order[F.col("level")], F.lit(-1)) >= level["INFO"]).withColumn("message", F.substring("message", 1, length))
