"""Deep assemblies: doubling against level-wise joins, cycles, shared nodes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import hierarchy


def frames(spark, roots, edges):
    r = spark.createDataFrame([(x,) for x in roots], "node string").select("node", g.identity().alias("matrix"), F.col("node").alias("path"))
    e = spark.createDataFrame(edges, "parent string, child string, slot int")
    return r, e.withColumn("matrix", g.translation(F.col("slot").cast("double") + 1, F.lit(0.0), F.lit(2.0)))


def brute(roots, edges):
    below = {}
    for p, c, s in edges:
        below.setdefault(p, []).append((c, s))
    out, todo = [], [(r, r, 0, 0.0) for r in roots]
    while todo:
        node, path, depth, x = todo.pop()
        out.append((node, path, depth, x, 2.0 * depth))
        todo += [(c, f"{path}/{c}#mesh_{s}", depth + 1, x + s + 1) for c, s in below.get(node, [])]
    return sorted(out)


def placed(spark, roots, edges, **more):
    got = hierarchy.flatten(*frames(spark, roots, edges), **more).collect()
    return sorted((r.node, r.path, r.depth, r.matrix[3], r.matrix[11]) for r in got)


@pytest.mark.parametrize("shallow", [1, 8])
def test_shared_nodes(spark, shallow):
    r = random.Random(2)
    edges = [(f"n{i}", f"n{j}", r.randrange(3)) for i in range(14) for j in range(i + 1, 14) if r.random() < 0.3] + [("n0", "n1", 0), ("n0", "n1", 1)]
    edges += [("alone", "loop", 0), ("loop", "loop", 0)]  # a cycle that no root reaches
    assert placed(spark, ["n0", "n3"], edges, shallow=shallow) == brute(["n0", "n3"], edges)


def test_long_chain(spark):
    n = 300
    edges = [(f"{i}", f"{i + 1}", 0) for i in range(n)]
    got = hierarchy.flatten(*frames(spark, ["0"], edges)).select("node", "depth", F.element_at("matrix", 4).alias("x")).collect()
    assert sorted((int(r.node), r.depth, r.x) for r in got) == [(i, i, float(i)) for i in range(n + 1)]


@pytest.mark.parametrize("edges", [[("r", "r", 0)], [("r", "a", 0), ("a", "b", 0), ("b", "a", 0), ("b", "a", 1)]])
def test_cycles(spark, edges):
    with pytest.raises(RuntimeError):
        hierarchy.flatten(*frames(spark, ["r"], edges), shallow=2)


def test_most_levels(spark):
    edges = [(f"{i}", f"{i + 1}", 0) for i in range(12)]
    with pytest.raises(RuntimeError):
        placed(spark, ["0"], edges, most_levels=12)
    assert len(placed(spark, ["0"], edges, most_levels=13)) == 13 and placed(spark, [], edges) == []
