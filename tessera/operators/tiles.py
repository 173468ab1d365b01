"""Tiles: a table of nodes with boxes, settings, errors and contents, and what is made of it."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import lod
from tessera.operators import octree
from tessera.storage import written


def node_table(items: DataFrame, rules: octree.Rules, sse: float = 80.0) -> DataFrame:
    """Nodes with tile_id, box, diagonals, levels and level-of-detail settings."""
    tree = octree.with_tile_ids(octree.nodes(items, rules))
    root = octree.root_box(items)
    levels = octree.depth_of(tree)
    t = tree.crossJoin(F.broadcast(root)).crossJoin(F.broadcast(levels))
    t = t.withColumn("box", octree.node_box(F.col("root"), F.col("path"), rules.loose, rules.max_depth))
    t = t.withColumn("diagonal", g.diagonal(F.col("box"))).withColumn("root_diagonal", g.diagonal(F.col("root")))
    settings = lod.tuning(F.col("diagonal"), F.col("root_diagonal"), F.col("depth"), F.col("levels"), F.col("is_leaf"), F.lit(float(sse)))
    return written(t.withColumns(settings).drop("root", "levels"), "tiles")


def with_parents(tiles: DataFrame, *columns: str) -> DataFrame:
    """Columns of the parent, as parent_<column>; null at the root."""
    up = tiles.select(F.col("path").alias("_up"), F.col("depth").alias("_up_depth"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    at = F.substring("path", 1, F.col("depth") - 1)
    return tiles.join(up, (F.col("depth") > 0) & (at == F.col("_up")) & (F.col("depth") - 1 == F.col("_up_depth")), "left").drop("_up", "_up_depth")


def tile_errors(tiles: DataFrame) -> DataFrame:
    """The error written for each tile: 0 at leaves, else the tile's own, but at most
    0.97 of what its parent's is, all the way from the root.

    Tiles of a level have one size and so one error; what the levels above leave
    of it is one window over the levels, at most 21 rows.
    """
    level = tiles.groupBy("depth").agg(F.min("own_error").alias("_own"))
    shrink = F.pow(F.lit(0.97), F.col("depth"))
    down = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = F.min(F.col("_own") / shrink).over(down) * shrink
    cap = level.select(F.col("depth").alias("_level"), above.alias("_cap"))
    t = tiles.join(F.broadcast(cap), F.col("depth") == F.col("_level"), "left")
    return t.withColumn("tile_error", F.when(F.col("is_leaf"), 0.0).otherwise(F.least("own_error", F.coalesce("_cap", "own_error")))).drop("_level", "_cap")


def cull_small(members: DataFrame, tiles: DataFrame, ratio: float = 1e-3) -> DataFrame:
    """Members (path, item_id, box) whose diagonal is at least ``ratio`` of their tile's (0: all)."""
    joined = members.join(tiles.select("path", F.col("diagonal").alias("_tile")), "path")
    keep = F.col("box").isNotNull() & (F.lit(ratio <= 0) | (g.diagonal(F.col("box")) / F.greatest(F.col("_tile"), F.lit(1e-12)) >= ratio))
    return joined.filter(keep).select("path", "item_id")


def metadata(tile_id: Column, leaf: Column, label: Column) -> Column:
    """A tile's metadata: its id, its kind, and the label of its first item."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("label", label), ("tileId", tile_id), ("tileKind", F.when(leaf, "leaf").otherwise("proxy")))])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def bottom_up(leaves: DataFrame, inner: DataFrame, combine: Callable[[DataFrame], DataFrame], reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Contents of all nodes, from the deepest level up.

    leaves: path, depth, and content columns, of leaves; inner: path, depth of
    the other nodes; reduce: content -> what a parent takes of it; combine: rows
    of all children, with the parent's path, -> content.  Each level is written
    to the shared folder, so a lost executor costs one level; there are at most
    21 levels.
    """
    depths = [r[0] for r in inner.select("depth").distinct().orderBy(F.desc("depth")).collect()]  # at most 21
    done, level = leaves, leaves
    for d in depths:
        up = reduce(done.filter(F.col("depth") == d + 1)).withColumn("path", F.substring("path", 1, F.lit(d))).withColumn("depth", F.lit(d))
        level = written(combine(up), "level")
        done = done.unionByName(level)
    return done


def visible_tiles(tiles: DataFrame, cameras: DataFrame, target: float = 80.0, most_depth: int = 6, height: float = 1080.0, fov: float = 60.0) -> DataFrame:
    """(camera, path, depth, tile_error): the tiles that each camera shows.

    tiles: path, depth, box, is_leaf, tile_error; cameras: camera, x, y, z, a stated set
    of views.  A tile is fine enough where its error, seen from the nearest point of its
    box (never from inside), takes at most ``target`` of ``height`` pixels; leaves and tiles
    at ``most_depth`` are shown in any case.  Tiles replace their parents, so of the fine
    enough tiles on a path the topmost is shown: for each camera every leaf lies under
    exactly one.  ``tiles`` is a whole tree, so what lies below ``most_depth`` is hidden by its
    ancestor there and left out at once.  A tile looks for fine enough ancestors by the
    prefixes of its path, in one join.
    """
    tiles = tiles.filter(F.col("depth") <= most_depth)
    c = cameras.select("camera", *[F.col(a).cast("double").alias(f"_{a}") for a in g.AXES])
    away = [F.greatest(F.col("box")[f"{a}min"] - F.col(f"_{a}"), F.lit(0.0), F.col(f"_{a}") - F.col("box")[f"{a}max"]) for a in g.AXES]
    distance = F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2])
    scale = height / (2 * math.tan(math.radians(fov) / 2))
    seen = tiles.select("path", "depth", "box", "is_leaf", "tile_error").crossJoin(c)  # views, not rows of the scene
    fine = F.col("is_leaf") | (F.col("depth") >= most_depth) | ((distance > 0) & (F.col("tile_error") * scale <= target * distance))
    enough = seen.filter(fine).select("camera", "path", "depth", "tile_error")
    above = enough.select("camera", "path", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.struct(F.substr("path", F.lit(1), k).alias("up"), k.alias("k")))).alias("u"))
    above = above.select("camera", "path", F.col("u.up").alias("_up"), F.col("u.k").alias("_k")).filter(F.length("path") > F.col("_k"))
    other = enough.select(F.col("camera").alias("_camera"), F.col("path").alias("_path"))
    hidden = above.join(other, (F.col("camera") == F.col("_camera")) & (F.col("_up") == F.col("_path"))).select("camera", "path").distinct()
    return enough.join(hidden, ["camera", "path"], "left_anti").select("camera", "path", "depth", "tile_error")


def tileset(tiles: DataFrame) -> DataFrame:
    """Rows of a tileset: path, box of 12 numbers, error, content uri."""
    return tile_errors(tiles).select("path", "depth", "tile_id", g.tile_box(F.col("box")).alias("box"), F.col("tile_error").alias("error"), "is_leaf", F.when(F.col("n_items") > 0, F.concat(F.lit("tile_"), F.col("tile_id").cast("string"), F.lit(".b3dm"))).otherwise("").alias("uri"))


def _tile(r: dict) -> dict:
    node = {"boundingVolume": {"box": [float(f"{x:.15g}") for x in r["box"]]}, "geometricError": float(f"{r['error']:.15g}"), "refine": "REPLACE"}
    if r["uri"]:
        node["content"] = {"uri": r["uri"]}
    return node


def _nested(rows: list[dict], top_error: float) -> str:
    """A tileset of rows in order of paths, the root first; children by octant."""
    made: dict[str, dict] = {}
    for r in rows:
        made[r["path"]] = _tile(r)
        if len(made) > 1:
            made[r["path"][:-1]].setdefault("children", []).append(made[r["path"]])
    return json.dumps({"asset": {"version": "1.0"}, "geometricError": top_error, "root": made[rows[0]["path"]]})


def tileset_json(rows: DataFrame, top_error: float, most_nodes: int = 200_000) -> str:
    """The nested JSON of a tileset, children by octant.

    A tileset file is one document and is assembled on the driver, so its number
    of tiles is checked; ``tileset_files`` cuts larger trees into several files.
    """
    if rows.limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"more than {most_nodes} tiles: use tileset_files")
    return _nested([r.asDict() for r in rows.orderBy("path").collect()], top_error)


def tileset_files(rows: DataFrame, top_error: float, levels: int = 4) -> DataFrame:
    """(uri, text): the tileset as files of ``levels`` levels each, ``tileset.json`` at
    the top.  A tile on the edge that has children is in its file a reference to
    the file that begins with it.

    A file has at most 8 ** levels * 8 / 7 tiles, so each is one small group.
    """
    prefix = F.substring("path", 1, (F.floor(F.col("depth") / levels) * levels).cast("int"))
    edge = (F.col("depth") > 0) & (F.col("depth") % levels == 0)
    above = F.substring("path", 1, F.col("depth") - levels)
    name = F.concat(F.lit("tileset_"), F.col("path"), F.lit(".json"))
    plain = ["path", "box", "error", "uri"]
    # leaves on the edge stay in the file above; other edge tiles begin a file and are referred to
    own = rows.select(F.when(edge & F.col("is_leaf"), above).otherwise(prefix).alias("file"), *plain)
    refer = rows.filter(edge & ~F.col("is_leaf")).select(above.alias("file"), "path", "box", "error", name.alias("uri"))

    def write(key, t):
        file = key[0].as_py()
        part = sorted(t.select(plain).to_pylist(), key=lambda r: r["path"])
        return pa.table({"uri": [f"tileset_{file}.json" if file else "tileset.json"], "text": [_nested(part, top_error if not file else part[0]["error"])]})

    return own.unionByName(refer).groupBy("file").applyInArrow(write, "uri string, text string")
