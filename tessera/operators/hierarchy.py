"""Assemblies and node trees, flattened level by level and then by doubling paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.text import node_path
from tessera.storage import written


#: Levels that are joined one by one before paths are doubled.
SHALLOW = 8


def flatten(roots: DataFrame, edges: DataFrame, most_levels: int | None = None, shallow: int = SHALLOW) -> DataFrame:
    """All placements below the roots, with matrices multiplied on the way down.

    roots: node, matrix, path; edges: parent, child, slot, matrix.  A node that is
    used in several places appears once for each.  Returns node, matrix, path,
    depth.  The first levels take one join each; what lies below them is found in a
    logarithmic number of rounds, by composing paths of 1, 2, 4, .. edges with
    themselves.  Every round is written to the shared folder.  A cycle below the
    roots, or more than ``most_levels`` levels if that is given, is an error.
    """
    level = written(roots.select("node", "matrix", "path", F.lit(0).alias("depth")), "level")
    done = level
    for d in range(1, shallow + 1):
        if most_levels is not None and d >= most_levels:
            shallow = d - 1
            break
        level = written(_placed(level, edges.select("parent", "child", "matrix", node_path(F.lit(""), F.col("child").cast("string"), F.col("slot")).alias("path"), F.lit(1).alias("length"))), "level")
        if level.isEmpty():
            return done
        done = done.unionByName(level)
    below = _doubled(level, edges)
    if most_levels is not None and not below.filter(F.col("depth") >= most_levels).isEmpty():
        raise RuntimeError("the hierarchy is deeper than allowed")
    return done.unionByName(below)


def _placed(above: DataFrame, paths: DataFrame) -> DataFrame:
    """Placements at the end of ``paths`` (parent, child, matrix, path, length) from those above."""
    up = above.select(F.col("node").alias("parent"), F.col("matrix").alias("_m"), F.col("path").alias("_p"), F.col("depth").alias("_d"))
    return up.join(paths, "parent").select(F.col("child").alias("node"), g.multiply(F.col("_m"), F.col("matrix")).alias("matrix"), F.concat("_p", "path").alias("path"), (F.col("_d") + F.col("length")).cast("int").alias("depth"))


def _composed(paths: DataFrame) -> DataFrame:
    """Paths of twice the length: each followed by one that begins where it ends."""
    then = paths.select(F.col("parent").alias("_mid"), F.col("child").alias("_end"), F.col("matrix").alias("_m"), F.col("path").alias("_p"))
    both = paths.join(then, F.col("child") == F.col("_mid"))
    return both.select("parent", F.col("_end").alias("child"), g.multiply(F.col("matrix"), F.col("_m")).alias("matrix"), F.concat("path", "_p").alias("path"), (F.col("length") * 2).alias("length"))


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the nodes at or below those of ``start``; rounds double the distance, and
    end where one finds nothing new, cycles or not."""
    seen = written(start.select("node").distinct(), "seen")
    step = written(edges.select("parent", "child").distinct(), "step")
    while True:
        more = seen.join(step, seen["node"] == step["parent"]).select(F.col("child").alias("node")).distinct()
        new = written(more.join(seen, "node", "left_anti"), "seen")
        if new.isEmpty():
            return seen
        seen = written(seen.unionByName(new), "seen")
        far = step.select(F.col("parent").alias("_mid"), F.col("child").alias("_end"))
        step = written(step.join(far, F.col("child") == F.col("_mid")).select("parent", F.col("_end").alias("child")).distinct(), "step")


def acyclic(edges: DataFrame) -> bool:
    """Whether no path returns to where it began: then no path is as long as there are nodes."""
    step = written(edges.select("parent", "child").distinct(), "step")
    nodes = step.select(F.explode(F.array("parent", "child")).alias("n")).distinct().count()
    length = 1
    while length <= nodes:
        if step.isEmpty():
            return True
        far = step.select(F.col("parent").alias("_mid"), F.col("child").alias("_end"))
        step = written(step.join(far, F.col("child") == F.col("_mid")).select("parent", F.col("_end").alias("child")).distinct(), "step")
        length *= 2
    return step.isEmpty()


def _doubled(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """All placements below ``frontier``, in rounds that double the depth."""
    inside = edges
    if not acyclic(inside):  # a cycle that no root reaches does no harm
        mine = reachable(frontier, edges)
        inside = written(edges.join(mine.withColumnRenamed("node", "parent"), "parent", "left_semi"), "edges")
        if not acyclic(inside):
            raise RuntimeError("the hierarchy has a cycle")
    paths = inside.select("parent", "child", "matrix", node_path(F.lit(""), F.col("child").cast("string"), F.col("slot")).alias("path"), F.lit(1).alias("length"))
    paths = written(paths, "paths")
    below, here = None, frontier
    while True:
        # here: all placements at less than the paths' length below the frontier, the frontier included
        found = written(_placed(here, paths), "below")
        if found.isEmpty():
            return below if below is not None else found
        below = found if below is None else below.unionByName(found)
        here = frontier.unionByName(below)
        paths = written(_composed(paths), "paths")


def scene_meshes(placed: DataFrame, node_mesh: DataFrame, meshes: DataFrame) -> DataFrame:
    """(mesh, matrix) of all nodes with a mesh; if none has one, all meshes in place."""
    used = placed.join(node_mesh, "node").select("mesh", "matrix")
    none = used.limit(1).agg(F.count("*").alias("_n"))
    rest = meshes.select("mesh", g.identity().alias("matrix")).crossJoin(F.broadcast(none)).filter("_n = 0").drop("_n")
    return used.unionByName(rest)


def first_mesh(placed: DataFrame, node_mesh: DataFrame) -> DataFrame:
    """The first mesh in depth-first order."""
    return placed.join(node_mesh, "node").orderBy("path").limit(1).select("mesh", "node", "path")


def solids_else_shells(shapes: DataFrame) -> DataFrame:
    """Solids of each label; shells only of labels that have no solid."""
    solids = shapes.filter("kind = 'SOLID'")
    shells = shapes.filter("kind = 'SHELL'").join(solids.select("label").distinct(), "label", "left_anti")
    return solids.unionByName(shells)


def union_of_lists(a, b):
    """Distinct strings of two lists, in order of first appearance."""
    return F.array_union(a, b)
