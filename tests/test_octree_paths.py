"""Paths are made batch by batch; tiles that no camera can show are left out at once."""

import math

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import octree, tiles


def _fold(mid, root, depth, loose):
    """A centre's way down, digit by digit; NaN counts as large, void as small."""
    rest = [m - (low + high) * 0.5 for m, (low, high) in zip(mid, root, strict=True)]
    out = ""
    for step in octree.steps(depth, loose):
        digit = 0
        for i, (low, high) in enumerate(root):
            up = math.isnan(rest[i]) or rest[i] >= 0
            digit += (1 << i) if up else 0
            rest[i] += -(high - low) * step if up else (high - low) * step
        out += str(digit)
    return out


def test_paths_in_batches_are_those_of_the_fold(spark):
    boxes = [(k, [math.sin(k * a) * 40 for a in (1, 2, 3)]) for k in range(3000)]
    boxes += [(5000, [0.0, -0.0, 40.0]), (5001, [-40.0, -40.0, -40.0])]
    df = spark.createDataFrame([(k, *p) for k, p in boxes], "id long, x double, y double, z double")
    ends = [F.col(a) - 0.5 for a in g.AXES] + [F.col(a) + 0.5 for a in g.AXES]
    void = spark.range(1).select(F.lit(6000).cast("long").alias("id"), F.lit(None).cast("struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>").alias("box"))
    items = df.select("id", g.box(*ends).alias("box")).unionByName(void).withColumn("triangles", F.lit(1))
    got = octree.with_paths(items, octree.Rules())
    found = {r["id"]: r["path"] for r in got.select("id", "path").collect()}
    root = [(min(p[i] for _, p in boxes) - 0.5, max(p[i] for _, p in boxes) + 0.5) for i in range(3)]
    for k, p in boxes:
        assert found[k] == _fold([((v - 0.5) + (v + 0.5)) * 0.5 for v in p], root, 20, 1.8)
    assert found[6000] == "0" * 20
    # a fold of structs took some 70 microseconds an item
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()


def test_paths_of_nothing_but_void_boxes(spark):
    void = spark.range(3).select("id", F.lit(None).cast("struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>").alias("box"), F.lit(1).alias("triangles"))
    assert {r["path"] for r in octree.with_paths(void, octree.Rules()).collect()} == {"0" * 20}


def test_tiles_below_the_last_shown_level_are_not_compared(spark):
    box = g.box(*[F.lit(float(x)) for x in (0, 0, 0, 1, 1, 1)])
    rows = [("0" * k, k, k == 9) for k in range(10)]
    t = spark.createDataFrame(rows, "path string, depth int, is_leaf boolean").withColumns({"box": box, "tile_error": F.lit(1e9)})
    cameras = spark.createDataFrame([(1, 5.0, 5.0, 5.0)], "camera long, x double, y double, z double")
    shown = tiles.visible_tiles(t, cameras)
    assert [(r["camera"], r["path"]) for r in shown.collect()] == [(1, "000000")]
    assert "<= 6" in shown._jdf.queryExecution().optimizedPlan().toString()


def test_an_id_of_several_lines_is_one_item(spark, tmp_path):
    """The id of a line is not a key: on large tables two lines may share it."""
    import duckdb
    from tests.same import assert_same

    import __spark_entry__ as entry

    c = duckdb.connect()
    at = "/root/testdata/sf0.001"
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{at}/part.parquet'")
    c.execute(f"CREATE TABLE lineitem AS FROM '{at}/lineitem.parquet' UNION ALL (FROM '{at}/lineitem.parquet' WHERE l_orderkey % 50 = 0)")
    for t in ("part", "lineitem"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    assert_same(entry.queries()["containing_child"](spark, str(tmp_path)), c, entry.oracle_sql()["containing_child"])


def _many(spark, n=4000):
    """Items of ten places only."""
    x = (F.col("id") % 10).cast("double") * 7
    return spark.range(n).select("id", g.box(x, x, x, x + 1, x + 1, x + 1).alias("box"), F.lit(100).cast("long").alias("triangles"))


def test_trees_are_made_of_whole_paths_counted_once(spark):
    """A tree without its items is made of one row for each path, not of all items per band of levels."""
    rules = octree.Rules()
    items = _many(spark)
    paths = octree.counted(items, rules)
    assert paths.count() == 10 and paths.agg(F.sum("n_items")).first()[0] == 4000
    names = ["path", "depth", "n_items", "tri_sum", "first_id", "is_leaf"]
    one, two = (octree.nodes(x, rules).select(names).orderBy("path").collect() for x in (paths, octree.placed(items, rules)))
    assert one == two and one[0].n_items == 4000 and one[0].tri_sum == 400_000


def test_items_look_up_the_leaf_of_their_path(spark):
    """Only whole paths are sorted with the leaves; items are neither sorted nor written again."""
    rules = octree.Rules()
    items = octree.placed(_many(spark), rules)
    tree = octree.nodes(items, rules)
    got = octree.membership(items, tree, rules)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    leaves = {r.path for r in tree.filter("is_leaf").collect()}
    whole = {r.id: r.path for r in items.collect()}
    found = got.collect()
    assert len(found) == 4000 and all(r.path in leaves and whole[r.item_id].startswith(r.path) for r in found)
