"""Connected components of a link table, by alternating stars.

Each round is two shuffles of the current links (never of groups: a vertex with
many links is aggregated before the shuffle and joined by an equi-join that Spark
may split). The table shrinks to one link from each vertex to its smallest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.shared import forget, stored


def _to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """Hangs the neighbours of each vertex on the smallest of them (or on itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if larger_only else links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if larger_only else joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (vertex, component): for each vertex with a link, the smallest vertex it reaches.

    Links to itself and nulls are passed over; repeated links do no harm.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = stored(links, "links")
    while True:
        # Large star: larger neighbours hang on the smallest neighbour. Small star: the smaller ones do.
        large = _to_smallest(links, larger_only=True)
        now = stored(_to_smallest(large, larger_only=False), "links")
        # Stars are reached when no vertex is both a leaf and a centre and every leaf has one centre.
        deep = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        twice = 0 if deep else now.groupBy("a").count().where("count > 1").limit(1).count()
        forget(links)
        links = now
        if not deep and not twice:
            break
    leaves = links.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return leaves.unionByName(links.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
