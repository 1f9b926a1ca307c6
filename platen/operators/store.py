"""Rendered tiles that outlive a run: a store by content, to which only what it lacks is rendered and added."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.operators import bands, geometry, jobs as job_ops

KEYS = ("frame_id", "cell_w", "cell_h", "mode", "bg")
STORED = "tile_id string, tile binary, shard string"


def addressed(frames: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile keys with ``tile_id``: a digest of the frame's pixels and of all that shapes the tile, so equal photos under different ids share it."""
    content = frames.where("width > 0 and height > 0 and data is not null").select("frame_id", F.sha2(F.concat(F.concat_ws("x", "width", "height", "stride").cast("binary"), F.lit(b"|"), F.col("data")), 256).alias("_content"))
    return tiles.select(*KEYS).join(content, "frame_id").select(*KEYS, F.sha2(F.concat_ws("|", "_content", "cell_w", "cell_h", "mode", "bg"), 256).alias("tile_id"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, tile, shard), by the first two digits of the id; empty where there is none yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def stored_tiles(frames: DataFrame, tiles: DataFrame, path: str) -> DataFrame:
    """As ``bands.make_tiles``, by the store: wanted tiles that it lacks are rendered once for each content and added, the others are read.

    A tile that two runs add at the same time is there twice, with the same bytes; a read takes one.
    """
    spark = frames.sparkSession
    wanted = addressed(frames, tiles)
    lacking = wanted.join(read_store(spark, path).select("tile_id"), "tile_id", "left_anti")
    once = lacking.groupBy("tile_id").agg(F.min(F.struct(*KEYS)).alias("k")).select("tile_id", "k.*")
    made = bands.make_tiles(frames, once.select(*KEYS)).join(once, list(KEYS)).select("tile_id", "tile", F.substring("tile_id", 1, 2).alias("shard"))
    made.write.mode("append").partitionBy("shard").parquet(path)
    # Tiles go where they are wanted by their ids; of a tile that is there twice one is taken.
    held = read_store(spark, path).join(wanted.select("tile_id").distinct(), "tile_id", "left_semi").groupBy("tile_id").agg(F.min("tile").alias("tile"))
    return wanted.join(held, "tile_id").select(*KEYS, "tile")


def render_jobs(frames: DataFrame, jobs: DataFrame, path: str, lines: int = bands.LINES) -> DataFrame:
    """As ``bands.render_jobs``, with tiles by the store."""
    sheets = geometry.sane_sheets(jobs)
    return bands.compose_bands(sheets, stored_tiles(frames, job_ops.dedupe_tiles(sheets), path), lines)
