"""Pipelines as rows: safety, signatures, fused parameters, resolution against a registry, named pipelines.

Operations of a pipeline are aggregated (map-side first), never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.functions import gates

# Operation codes.
RESIZE, CROP, GRAYSCALE, BRIGHTNESS, RESIZE_H, RESIZE_V = 1, 2, 3, 4, 16, 17
BUILT_IN = {RESIZE: "resize", GRAYSCALE: "grayscale", RESIZE_H: "resize_h", RESIZE_V: "resize_v"}
MAX_OPS, MAX_CODE, SLOTS = 32, 0xFFF, 256
# Named pipelines by their first code, each a list of operations.
NAMED_BASE = 4096
NAMED = {
    "photo_6x6": "resize(4096,4096) crop(6,6) border(2) padding(20)",
    "photo_6x3": "resize(4096,4096) crop(6,3) border(2) padding(20)",
    "photo_6x1": "resize(4096,4096) crop(6,1) border(2) padding(20)",
    "passport_45x35": "resize(4096,4096) crop(6,6) border(2) padding(20)",
    "printready_6x6": "resize(4096,4096) crop(6,6) border(2) padding(20)",
}


@dataclass(frozen=True)
class Operation:
    """A registered frame -> frame function; (height, width, 3) bytes in and out, parameters as a dict."""

    name: str
    code: int
    single: Callable[[np.ndarray, dict], np.ndarray] | None
    batch: Callable[[list[np.ndarray], dict], list[np.ndarray]] | None = None


REGISTRY: dict[int, Operation] = {}


def register_op(name: str, code: int, single: Callable | None = None, batch: Callable | None = None) -> None:
    """The later registration of a code wins; codes from 256 on are ignored; an operation needs one function at least."""
    if code >= SLOTS or (single is None and batch is None):
        return
    REGISTRY[code] = Operation(name, code, single, batch)


def registry_table(spark: SparkSession) -> DataFrame:
    """(op_code, op_name, can_single, can_batch): the built-in kernels and what was registered; at most 256 rows."""
    rows = {code: (code, name, True, True) for code, name in BUILT_IN.items()}
    rows |= {op.code: (op.code, op.name, op.single is not None, op.batch is not None) for op in REGISTRY.values()}
    return spark.createDataFrame([rows[c] for c in sorted(rows)], "op_code long, op_name string, can_single boolean, can_batch boolean")


def pipeline_safety(ops: DataFrame) -> DataFrame:
    """(pipeline_id, ok): 1 to 32 operations, all codes in 1..0xFFF."""
    return ops.groupBy("pipeline_id").agg((F.count("*").between(1, MAX_OPS) & F.bool_and(F.col("op_code").between(1, MAX_CODE))).alias("ok"))


def pipeline_signature(ops: DataFrame) -> DataFrame:
    """(pipeline_id, signature): bits of grayscale 1, brightness 2, resize 4, in whatever order they come."""
    bit = F.when(F.col("op_code") == GRAYSCALE, 1).when(F.col("op_code") == BRIGHTNESS, 2).when(F.col("op_code") == RESIZE, 4).otherwise(0)
    return ops.groupBy("pipeline_id").agg(F.bit_or(bit).alias("signature"))


def fuse_params(ops: DataFrame) -> DataFrame:
    """One row of parameters for each pipeline; the last brightness and the last resize win."""
    code = F.col("op_code")

    def last(value: str, of: int):
        return F.max_by(F.when(code == of, F.col(value)), F.when(code == of, F.col("op_index"))).alias(value)

    return ops.groupBy("pipeline_id").agg(
        F.bool_or(code == GRAYSCALE).alias("has_gray"), F.bool_or(code == BRIGHTNESS).alias("has_bright"), F.bool_or(code == RESIZE).alias("has_resize"),
        last("brightness", BRIGHTNESS), last("new_w", RESIZE), last("new_h", RESIZE),
    )


def resolve_strict(ops: DataFrame, registry: DataFrame) -> DataFrame:
    """(pipeline_id, ops, resolved, result): unsafe pipelines first, then any unknown operation fails the whole."""
    known = F.broadcast(registry.select(F.col("op_code").alias("_code")))
    found = ops.join(known, ops["op_code"] == known["_code"], "left")
    safe = F.count("*").between(1, MAX_OPS) & F.bool_and(F.col("op_code").between(1, MAX_CODE))
    out = found.groupBy("pipeline_id").agg(F.count("*").alias("ops"), F.count("_code").alias("resolved"), safe.alias("safe"))
    result = F.when(~F.col("safe"), gates.SECURITY).when(F.col("ops") != F.col("resolved"), gates.FORMAT).otherwise(gates.SUCCESS)
    return out.select("pipeline_id", "ops", "resolved", result.alias("result"))


def resolve_lenient(ops: DataFrame, registry: DataFrame) -> DataFrame:
    """The operations that resolve; others are skipped."""
    known = F.broadcast(registry.select(F.col("op_code").alias("_code"), "op_name"))
    return ops.join(known, ops["op_code"] == known["_code"]).select("pipeline_id", "op_index", "op_code", "op_name")


def named_pipelines(spark: SparkSession) -> DataFrame:
    """(pipeline, code, op_index, op, a, b) parsed from the catalog's text."""
    rows = spark.createDataFrame([(n, NAMED_BASE + k, t) for k, (n, t) in enumerate(NAMED.items())], "pipeline string, code long, body string")
    each = rows.select("pipeline", "code", F.posexplode(F.split("body", " ")).alias("i", "t"))
    args = F.split(F.regexp_extract("t", r"\((.*)\)", 1), ",")
    return each.select("pipeline", "code", (F.col("i") + 1).cast("long").alias("op_index"), F.regexp_extract("t", r"^(\w+)\(", 1).alias("op"), F.get(args, F.lit(0)).cast("long").alias("a"), F.get(args, F.lit(1)).cast("long").alias("b"))
