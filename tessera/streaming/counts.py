"""Streams of items and events: running counts of tree prefixes, and windows.

Beyond what batch scenes need; both keep bounded state per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import octree


def prefix_counts(items: DataFrame, root: Column, depth: int, loose: float = 1.8) -> DataFrame:
    """Items and triangles of every prefix so far (update mode): root is fixed,
    since a stream's box is not known beforehand."""
    center = {a: g.center(F.col("box"), a) for a in g.AXES}
    p = items.select(octree.path(center, root, depth, loose).alias("p"), "triangles")
    each = p.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "p", "triangles")
    return each.groupBy(F.substring("p", 1, F.col("depth")).alias("path"), "depth").agg(F.count("*").alias("n_items"), F.sum("triangles").alias("tri_sum"))


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; later ones than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
