"""Loose octrees without recursion.

An item's way down the tree depends on its own centre alone, so its path (a
digit 0-7 per level) is a row-local expression.  Items of one whole path share all
their nodes, so they are counted together once, and all else is made of these counts.
Counts of prefixes come from aggregates over prefixes, ``LEVELS`` levels at a time:
the longest prefix of these levels is counted, and only that is expanded; the next
levels are counted for the paths of nodes that go on.  The stop rule holds for all
descendants once it holds, so a prefix is a node iff its parent does not stop: one
join on the parent's path.  In the order of paths a leaf is followed by the whole paths
in it, so one sort by range finds the leaf of each, and a join that of each item.
Ids follow from sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.ids import dense_ids
from tessera.storage import written

#: Levels that are counted in one step.
LEVELS = 7


@dataclass(frozen=True)
class Rules:
    """When a node is divided no further."""

    max_depth: int = 20
    max_items: int = 96
    max_triangles: int = 30_000
    min_side: float = 1e-6
    loose: float = 1.8


def root_box(items: DataFrame) -> DataFrame:
    """One row: the box around all items."""
    if "root" in items.columns:
        return items.agg(F.first("root").alias("root"))
    return items.agg(F.struct(*g.union_of(F.col("box"))).alias("root"))


def steps(depth: int, loose: float) -> list[float]:
    """By level, how far a child's centre lies from its parent's, in root sides."""
    return [0.25 * (loose / 2) ** k for k in range(depth)]


def path(center: dict[str, Column], root: Column, depth: int, loose: float) -> Column:
    """The digits of an item's way down ``depth`` levels, as a string.

    Each axis goes its own way: the distance from the node's centre gives one bit
    and loses the step to the child's centre.  The levels are made batch by batch in
    numpy, as a fold of structs costs some 70 microseconds a row in Spark.
    """
    steps_ = steps(depth, loose)

    @F.arrow_udf("string")
    def digits(dx: pa.Array, dy: pa.Array, dz: pa.Array, sx: pa.Array, sy: pa.Array, sz: pa.Array) -> pa.Array:
        n = len(dx)
        out = np.full((n, depth), ord("0"), np.uint8)
        with np.errstate(invalid="ignore"):
            for i, (d, s) in enumerate(((dx, sx), (dy, sy), (dz, sz))):
                rest = pc.fill_null(d, float("-inf")).to_numpy(zero_copy_only=False)
                side = pc.fill_null(s, 0.0).to_numpy(zero_copy_only=False)
                for k, step in enumerate(steps_):
                    high = ~(rest < 0)  # NaN is high, as Spark orders it
                    out[:, k] += high.astype(np.uint8) << i
                    rest = np.where(high, rest - side * step, rest + side * step)
        ends = np.arange(0, n * depth + 1, depth, dtype=np.int32) if depth else np.zeros(n + 1, np.int32)
        return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(out))

    return digits(*[center[a] - g.center(root, a) for a in g.AXES], *[g.extent(root, a) for a in g.AXES])


def with_paths(items: DataFrame, rules: Rules) -> DataFrame:
    """items (id, box, triangles, ...), the root's box and the path of each; void boxes go to octant 0."""
    if "path" in items.columns:
        return items
    rooted = items if "root" in items.columns else items.crossJoin(F.broadcast(root_box(items)))
    center = {a: F.coalesce(g.center(F.col("box"), a), F.lit(float("-inf"))) for a in g.AXES}
    return rooted.withColumn("path", path(center, F.col("root"), rules.max_depth, rules.loose))


def placed(items: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """(id, triangles, root, path, further columns of items), written once for all that is made of it."""
    return written(with_paths(items, rules).select("id", "triangles", "root", "path", *keep), "placed")


def counted(items: DataFrame, rules: Rules) -> DataFrame:
    """(path, n_items, tri_sum, first_id, root) of each whole path that has items.

    All that a tree needs of its items, written once: queries that return no items make
    their trees of this.
    """
    if "n_items" in items.columns:
        return items
    root = written(root_box(items), "root")
    rows = items if "root" in items.columns else items.crossJoin(F.broadcast(root))
    each = with_paths(rows, rules).groupBy("path").agg(F.count("*").alias("n_items"), F.sum("triangles").alias("tri_sum"), F.min("id").alias("first_id"))
    return written(each.crossJoin(F.broadcast(root)), "counted")


def _counted(rows: DataFrame, low: int, high: int, rules: Rules) -> DataFrame:
    """(path, depth, n_items, tri_sum, first_id, stop) of the prefixes of low..high digits."""
    longest = F.substring("path", 1, high).alias("path")
    whole = rows.groupBy(longest).agg(F.sum("n_items").alias("n"), F.sum("tri_sum").alias("t"), F.min("first_id").alias("i"), F.first("side").alias("side"))
    each = whole.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "path", "n", "t", "i", "side")
    counts = each.groupBy(F.substring("path", 1, F.col("depth")).alias("path"), "depth").agg(F.sum("n").alias("n_items"), F.sum("t").cast("long").alias("tri_sum"), F.min("i").alias("first_id"), F.first("side").alias("side"))
    small = F.col("side") * F.pow(F.lit(rules.loose / 2), F.col("depth")) <= F.greatest(F.lit(1e-6), F.lit(rules.min_side))
    stop = (F.col("depth") >= rules.max_depth) | (F.col("n_items") <= rules.max_items) | (F.col("tri_sum") <= rules.max_triangles) | small
    return counts.withColumn("stop", stop).drop("side")


def nodes(items: DataFrame, rules: Rules) -> DataFrame:
    """path, depth, n_items, tri_sum, first_id, is_leaf of every node.

    items: items, or what ``counted`` makes of them.  Nodes are few (a share of items / max_items) and are used many times, so they
    are written to the shared folder, once for each ``LEVELS`` levels.
    """
    rows = counted(items, rules).select("path", "n_items", "tri_sum", "first_id", g.max_side(F.col("root")).alias("side"))
    tree = None
    for low in range(0, rules.max_depth + 1, LEVELS):
        high = min(low + LEVELS - 1, rules.max_depth)
        counts = written(_counted(rows, low, high, rules), "prefixes")
        going = counts.filter(~F.col("stop")).select(F.col("path").alias("_parent"), F.col("depth").alias("_depth"))
        parent = (F.substring("path", 1, F.col("depth") - 1) == F.col("_parent")) & (F.col("depth") - 1 == F.col("_depth"))
        below = counts.filter(F.col("depth") > low).join(going, parent, "left_semi")
        level = written(counts.filter(F.col("depth") == low).unionByName(below).withColumnRenamed("stop", "is_leaf"), "nodes")
        tree = level if tree is None else tree.unionByName(level)
        on = level.filter((F.col("depth") == high) & ~F.col("is_leaf")).select(F.col("path").alias("_on"))
        if on.isEmpty():
            break
        rows = rows.join(on, F.substring("path", 1, high) == F.col("_on"), "left_semi")
    return tree


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: each takes the last leaf at or before it in its partition, if any."""
    last = pa.scalar(None, pa.string())
    for b in batches:
        if b.num_rows:
            leaf = pc.fill_null_forward(pa.concat_arrays([pa.array([last.as_py()], pa.string()), b.column("leaf")])).slice(1)
            last = leaf[-1]
            yield b.set_column(b.schema.get_field_index("leaf"), "leaf", leaf)


def membership(items: DataFrame, tree: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """(path, item id, further columns of items) of the leaf that each item lies in.

    Leaves and the whole paths of items, each once, are sorted by range together; the
    leaf of the first paths of a partition is the last of the partitions before, one row
    each.  Items then look up the leaf of their path, which is sent to all tasks if small.
    """
    mine = with_paths(items, rules).select("path", F.col("id").alias("item_id"), *keep)
    ways = mine.select(F.col("path").alias("_key")).distinct().withColumns({"leaf": F.lit(None).cast("string"), "_item": F.lit(1)})
    first = tree.filter("is_leaf").select(F.rpad(F.concat("path"), rules.max_depth, "0").alias("_key"), F.col("path").alias("leaf"), F.lit(0).alias("_item"))
    order = ["_key", "_item"]
    rows = ways.unionByName(first).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(_carried, rows.schema).withColumn("_part", F.spark_partition_id()), "ways")
    ends = rows.filter("_item = 0").groupBy("_part").agg(F.max_by("leaf", "_key").alias("_last"))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).join(ends, "_part", "left")  # a row for each partition
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carry = parts.select("_part", before.alias("_before"))
    leaf = written(rows.filter("_item = 1").join(F.broadcast(carry), "_part").select("_key", F.coalesce("leaf", "_before").alias("_leaf")), "leaves")
    return mine.join(leaf, F.col("path") == F.col("_key")).select(F.col("_leaf").alias("path"), "item_id", *keep)


def with_tile_ids(tree: DataFrame) -> DataFrame:
    """tile_id in post-order: children before parents, octant by octant.

    The sort key alone orders them: a digit after all octants, 8, closes a path.
    """
    return dense_ids(tree.withColumn("_closed", F.concat("path", F.lit("8"))), ["_closed"], "tile_id").drop("_closed")


def _toward(bit: int, side: Column):
    def add(c: Column, w: Column) -> Column:
        return F.when(w["d"].bitwiseAND(F.lit(bit)) != 0, c + side * w["f"]).otherwise(c - side * w["f"])

    return add


def node_box(root: Column, node_path: Column, loose: float, depth: int = 20) -> Column:
    """The box of a node: its centre along the path, and the root's sides shrunk."""
    digits = F.transform(F.filter(F.split(node_path, ""), lambda c: c != ""), lambda c: c.cast("int"))
    far = F.slice(F.array(*[F.lit(x) for x in steps(depth, loose)]), F.lit(1), F.length(node_path))
    way = F.zip_with(digits, far, lambda d, f: F.struct(d.alias("d"), f.alias("f")))
    sides = {}
    for i, a in enumerate(g.AXES):
        step = g.extent(root, a)
        mid = F.aggregate(way, g.center(root, a), _toward(1 << i, step))
        half = step * F.pow(F.lit(loose / 2), F.length(node_path)) * 0.5
        sides[f"{a}min"], sides[f"{a}max"] = mid - half, mid + half
    return g.box(**sides)


def subtree(tree_members: DataFrame, prefix: str) -> DataFrame:
    """Items below a node."""
    return tree_members.filter(F.col("path").startswith(prefix))


def depth_of(tree: DataFrame) -> DataFrame:
    """Levels of a tree: a root alone has one."""
    return tree.agg((F.max("depth") + 1).cast("long").alias("levels"))
