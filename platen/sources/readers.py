"""Sources: photos, raw frames, files, job options and requests, logs, binary logs, samples, and their streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.functions import gates
from platen.functions.numbers import little_endian
from platen.operators.pixels import FRAMES

REQUEST = "job_id string, input string, output string, cols long, rows long, gap long, dpi long, border_px long, padding long, crop_mark_px long, crop_thickness long, bleed_px long, crop_offset_px long, photo_w_cm float, photo_h_cm float"
#: A request's JSON, whose parameters go by the service's names.
REQUEST_JSON = "job_id string, input_path string, output_path string, params struct<cols: long, rows: long, gap: long, dpi: long, border: long, padding: long, crop_mark: long, crop_thickness: long, bleed: long, crop_offset: long, width: float, height: float>"
LOG = "time string, level string, message string, trace_id string"
OPTIONS = "job_id long, preset string, opt_cols string, opt_gap string, opt_width string, opt_mode string, input_format string, input_width string, input_stride string, output_path string"
LIFECYCLE = "event_id long, job_id string, status string, logs string, error string, ts timestamp"
ENTRY = 40


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files that aren't empty."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length", "content")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """Photos as RGB frames (frame_id from the path), by the executors; Spark's image source hands over blue first.

    Gray images are repeated over three channels, a fourth channel is left out; the
    header gate and the file gate of ``gates`` apply to the columns that this keeps.
    """
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("width > 0 and height > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame_id, height, width, n, data in zip(*(batch.column(c).to_pylist() for c in ("frame_id", "height", "width", "nChannels")), batch.column("data"), strict=True):
                own = np.frombuffer(data.as_buffer(), np.uint8, count=height * width * n).reshape(height, width, n)
                rgb = own[:, :, 2::-1] if n >= 3 else np.repeat(own[:, :, :1], 3, axis=2)
                row = {"frame_id": frame_id, "width": width, "height": height, "channels": 3, "stride": width * 3, "data": rgb.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("frame_id", pa.int64()), *((c, pa.int32()) for c in ("width", "height", "channels", "stride")), ("data", pa.binary())]))

    return image.select(F.xxhash64("origin").alias("frame_id"), "height", "width", "nChannels", "data").mapInArrow(run, FRAMES)


def read_rgb24(data: DataFrame, dims: DataFrame) -> DataFrame:
    """(frame_id, content) and (frame_id, width, height, stride) -> frames that keep the raw contract."""
    joined = data.join(dims, "frame_id").withColumn("size", F.octet_length("content"))
    ok = joined.where(gates.rgb24_contract(F.col("width"), F.col("height"), F.col("stride"), F.col("size")) == gates.SUCCESS)
    return ok.select("frame_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(3).alias("channels"), gates.rgb24_stride(F.col("width"), F.col("stride")).cast("int").alias("stride"), F.col("content").alias("data"))


def bytes_slice(data: Column, pos: Column | int, n: Column | int) -> Column:
    """n bytes from position pos (from 0) on; fewer where the data end."""
    at = pos if isinstance(pos, Column) else F.lit(pos)
    return F.substring(data, at.cast("int") + 1, n if isinstance(n, Column) else F.lit(n))


def read_job_options(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPTIONS).option("header", True).csv(path)


def parse_job_requests(df: DataFrame, column: str) -> DataFrame:
    """JSON requests; a request that can't be read has null columns."""
    r = df.select(F.from_json(column, REQUEST_JSON).alias("r")).select("r.*")
    own = {"border": "border_px", "crop_mark": "crop_mark_px", "bleed": "bleed_px", "crop_offset": "crop_offset_px", "width": "photo_w_cm", "height": "photo_h_cm"}
    names = ("cols", "rows", "gap", "dpi", "border", "padding", "crop_mark", "crop_thickness", "bleed", "crop_offset", "width", "height")
    return r.select("job_id", F.col("input_path").alias("input"), F.col("output_path").alias("output"), *(F.col(f"params.{n}").alias(own.get(n, n)) for n in names))


def parse_app_logs(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, LOG).alias("r")).select("r.*").where("message is not null")


def parse_binlog(df: DataFrame, column: str = "content") -> DataFrame:
    """Files of 40-byte entries -> (ts, event_id, cpu, arg0, arg1, arg2); an incomplete last entry is left out."""
    n = F.octet_length(column)
    at = df.where(n >= ENTRY).select(column, F.explode(F.sequence(F.lit(0), F.expr(f"octet_length({column}) div {ENTRY} - 1"))).alias("k"))
    entry = at.select(bytes_slice(F.col(column), F.col("k") * ENTRY, ENTRY).alias("e"))
    e = F.col("e")
    places = (("ts", 0, 8, "long"), ("event_id", 8, 4, "int"), ("cpu", 12, 4, "int"), ("arg0", 16, 8, "long"), ("arg1", 24, 8, "long"), ("arg2", 32, 8, "long"))
    return entry.select(*(little_endian(e, p, size).cast(kind).alias(name) for name, p, size, kind in places))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def job_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests dropped as JSON lines, as they come."""
    return parse_job_requests(spark.readStream.format("text").load(path), "value")


def status_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LIFECYCLE).json(path)
