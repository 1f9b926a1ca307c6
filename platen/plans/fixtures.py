"""Tables of the print domain derived from the given tables: SQL that Spark and DuckDB both read.

Where the engines differ, ``DIALECT`` has the DuckDB form. All rows and whole
texts are used; a document's frame is all its bytes, eight pixels wide, the last
line filled up with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.operators.pixels import frames_to_pixels

SQL = {
    "jobs": """SELECT o_orderkey AS job_id, o_custkey AS frame_id, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 2 END AS abi_version,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS template_id,
  CAST(CAST(20 + o_orderkey % 41 AS DOUBLE) / 10 AS FLOAT) AS photo_w_cm, CAST(CAST(20 + o_custkey % 41 AS DOUBLE) / 10 AS FLOAT) AS photo_h_cm,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 72 WHEN 2 THEN 150 ELSE 300 END AS BIGINT) AS dpi,
  1 + o_orderkey % 6 AS cols, 1 + o_custkey % 9 AS rows, o_orderkey % 21 AS gap, o_custkey % 31 AS padding, o_orderkey % 4 AS border_px, o_custkey % 8 AS bleed_px,
  o_orderkey % 16 AS crop_mark_px, o_custkey % 3 AS crop_thickness, 2 + o_orderkey % 7 AS crop_offset_px, CAST(o_orderkey % 2 AS INT) AS mode,
  CAST(o_custkey % 256 AS INT) AS bg_r, CAST(o_orderkey % 256 AS INT) AS bg_g, CAST(255 AS INT) AS bg_b FROM orders""",
    "job_options": """SELECT o_orderkey AS job_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'passport-45x35' WHEN 1 THEN 'passport-38x35-printready' WHEN 2 THEN 'printready-6x6' WHEN 3 THEN 'no-such-preset' ELSE NULL END AS preset,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '-3' WHEN 2 THEN '' WHEN 3 THEN '12x' WHEN 4 THEN '4294967296' ELSE CAST(1 + o_orderkey % 6 AS STRING) END AS opt_cols,
  CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS STRING) END AS opt_gap,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '3.5' WHEN 2 THEN '-1.0' ELSE 'abc' END AS opt_width,
  CASE o_orderkey % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'fill' ELSE 'stretch' END AS opt_mode,
  CASE o_custkey % 3 WHEN 0 THEN 'raw-rgb24' ELSE 'encoded' END AS input_format,
  CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(8 + o_orderkey % 8 AS STRING) END AS input_width,
  CASE o_custkey % 5 WHEN 0 THEN CAST(o_custkey % 50 AS STRING) ELSE NULL END AS input_stride,
  CASE o_orderkey % 4 WHEN 0 THEN 'out/sheet.PDF' WHEN 1 THEN 'out.pdf/sheet' WHEN 2 THEN 'sheet.jpg' ELSE 'sheet.pdfx' END AS output_path FROM orders""",
    "image_requests": """SELECT l_orderkey * 10 + l_linenumber AS req_id, (l_partkey * 37) % 18000 AS width, (l_orderkey * 11) % 18000 AS height,
  CAST(l_linenumber % 6 AS BIGINT) AS channels, CAST(floor(l_extendedprice) AS BIGINT) * 10 AS file_size FROM lineitem""",
    "pipeline_ops": """SELECT l_orderkey AS pipeline_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS op_index,
  CAST(CASE l_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 16 WHEN 5 THEN 17 ELSE 4096 END AS BIGINT) AS op_code,
  l_suppkey % 300 AS brightness, 1 + l_partkey % 64 AS new_w, 1 + l_suppkey % 64 AS new_h FROM lineitem""",
    "latency_samples": """SELECT event_id AS sample_id,
  CASE event_type WHEN 'view' THEN 'render' WHEN 'signup' THEN 'decode' WHEN 'error' THEN 'encode' WHEN 'click' THEN 'cold' ELSE 'render_raw' END AS stage,
  CAST(round(value * 1000000) AS BIGINT) AS ns, user_id % 64 AS core_id, CAST(CASE user_id % 4 WHEN 0 THEN 85 WHEN 1 THEN 85 WHEN 2 THEN 75 ELSE 92 END AS BIGINT) AS quality,
  CASE user_id % 4 WHEN 0 THEN '4:4:4' WHEN 1 THEN '4:2:0' WHEN 2 THEN '4:2:0' ELSE '4:4:4' END AS subsamp, event_type <> 'error' AS success FROM events""",
    "lifecycle": """SELECT event_id, user_id AS job_id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'retrying' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, ts FROM events""",
    "http_requests": """SELECT event_id AS request_id, user_id AS client, CAST(user_id AS STRING) AS trace_id, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN event_type = 'view' THEN '/status' ELSE '/generate' END AS endpoint, CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE 'test-key-123' END AS api_key, ts, value / 1000 AS latency_s FROM events""",
    "logs": """SELECT conv_id * 1000 + turn AS line_id, CASE role WHEN 'user' THEN 'INFO' WHEN 'assistant' THEN 'DEBUG' ELSE 'ERROR' END AS level,
  text AS message, CAST(conv_id AS STRING) AS trace_id FROM conversations""",
    "binlog": """SELECT event_id * 1000 AS ts, CAST(1 + event_id % 4 AS INT) AS event_id, CAST(user_id % 128 AS INT) AS cpu,
  CAST(round(value * 1000) AS BIGINT) AS arg0, user_id AS arg1, CAST(0 AS BIGINT) AS arg2 FROM events""",
    "spans": """SELECT CAST(user_id AS STRING) AS trace_id, event_type AS name, event_id * 1000000 AS start_ns, event_id * 1000000 + CAST(round(value * 1000000) AS BIGINT) AS end_ns FROM events""",
    "raw_frames": """SELECT frame_id, width, CASE WHEN frame_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE st END AS stride, (octet_length(raw) + st - 1) div st AS height,
  CASE WHEN frame_id % 6 = 5 THEN raw ELSE rpad(raw, CAST((octet_length(raw) + st - 1) div st * st AS INT), X'00') END AS content
  FROM (SELECT doc_id AS frame_id, CAST(4 + doc_id % 5 AS BIGINT) AS width, CAST(CASE WHEN doc_id % 3 = 0 THEN (4 + doc_id % 5) * 3 ELSE 12 + doc_id % 7 * 2 END AS BIGINT) AS st, encode(text, 'utf-8') AS raw FROM documents WHERE text IS NOT NULL)""",
    "frames": """SELECT doc_id AS frame_id, 8 AS width, CAST((octet_length(encode(text, 'utf-8')) + 23) div 24 AS INT) AS height, 3 AS channels, 24 AS stride,
  rpad(encode(text, 'utf-8'), CAST((octet_length(encode(text, 'utf-8')) + 23) div 24 * 24 AS INT), X'00') AS data FROM documents WHERE octet_length(encode(text, 'utf-8')) > 0""",
}
DIALECT = {
    "frames": """SELECT doc_id AS frame_id, 8 AS width, CAST((octet_length(encode(text)) + 23) // 24 AS INT) AS height, 3 AS channels, 24 AS stride,
  encode(text) || unhex(repeat('00', CAST((24 - octet_length(encode(text)) % 24) % 24 AS INT))) AS data FROM documents WHERE octet_length(encode(text)) > 0""",
    "pixels": """SELECT frame_id, CAST(i // 24 AS INT) AS y, CAST((i % 24) // 3 AS INT) AS x, CAST(i % 3 AS INT) AS c, CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS v
  FROM (SELECT doc_id AS frame_id, hex(encode(text)) || repeat('0', 46) AS h, unnest(range(0, ((octet_length(encode(text)) + 23) // 24) * 24)) AS i FROM documents)""",
    "framed_jobs": f"""SELECT j.* REPLACE (f.frame_id AS frame_id) FROM ({SQL["jobs"]}) j
  JOIN (SELECT doc_id AS frame_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents WHERE octet_length(encode(text)) > 0 AND doc_id IS NOT NULL) f ON f.idx = j.frame_id % f.n""",
}
#: Frames that are numbered within one bucket of ids.
BUCKET = 4096
_TABLES = ("orders", "lineitem", "events", "documents", "conversations")


def framed_jobs(jobs: DataFrame, frames: DataFrame) -> DataFrame:
    """Jobs on frames that are there: a job's frame number, modulo how many frames there are, among the frames in the order of their ids.

    Frames are counted by buckets of ids and numbered within them, so no task sorts them all.
    The ids are dealt out once for all of that, so the frames are read once for them.
    """
    ids = frames.where("frame_id is not null").select("frame_id", F.floor(F.col("frame_id") / BUCKET).alias("_bucket")).where("_bucket is not null").repartition("_bucket")
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    counted = ids.groupBy("_bucket").agg(F.count("frame_id").alias("_n"))
    below = counted.select("_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_below"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("frame_id"))
    numbered = ids.join(below, "_bucket").select("frame_id", (F.col("_below") + within - 1).alias("_idx"))
    n = F.nullif(counted.agg(F.sum("_n")).scalar(), F.lit(0))
    return jobs.withColumn("_idx", F.col("frame_id") % n).drop("frame_id").join(numbered, "_idx").select(jobs.columns)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; only the columns that a query asks for are read."""
    if name == "pixels":
        return frames_to_pixels(fixture(spark, sf_dir, "frames"))
    if name == "framed_jobs":
        return framed_jobs(fixture(spark, sf_dir, "jobs"), fixture(spark, sf_dir, "frames"))
    sql = SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def oracle(name: str) -> str:
    """The derived table as a DuckDB subquery."""
    return f"({DIALECT.get(name) or SQL[name]})"
