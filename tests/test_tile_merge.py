"""Merged tiles against a direct computation: places, attributes, seams, files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import tile_merge
from tessera.sources import glb

NAMES = ("x", "y", "z", *tile_merge.ATTRIBUTES)
CORNER = "struct<" + ",".join(f"{n}:double" for n in NAMES) + ">"


def corner(x, y, z, normal=(0.0, 0.0, 1.0), uv=(0.0, 0.0), color=(1.0, 0.0, 0.0, 1.0)):
    return (float(x), float(y), float(z), *(normal or (None,) * 3), *(uv or (None,) * 2), *(color or (None,) * 4))


def frames(spark, rows):
    tree = spark.createDataFrame([("", 0, False), ("0", 1, True), ("1", 1, True)], "path string, depth int, is_leaf boolean")
    root = spark.range(1).select(g.box(*map(F.lit, (0.0, 0.0, 0.0, 64.0, 64.0, 64.0))).alias("root"))
    return tree, spark.createDataFrame(rows, f"path string, material int, a {CORNER}, b {CORNER}, c {CORNER}"), root


def inner(spark, rows, share=1 / 8):
    tree, t, root = frames(spark, rows)
    content = tile_merge.merge_tiles(tree, t, root, 1.8, share)
    assert content.filter("path <> ''").count() == len(rows)
    return content.filter("path = ''").collect()


def plane(path, material, n=16, z=lambda x, y: 5.0, first=0, **more):
    """A grid of triangles of step 2."""
    out = []
    for i in range(first, first + n):
        for j in range(n):
            p = [(2 * i, 2 * j), (2 * i + 2, 2 * j), (2 * i + 2, 2 * j + 2), (2 * i, 2 * j + 2)]
            c = [corner(x, y, z(x, y), **more) for x, y in p]
            out += [(path, material, c[0], c[1], c[2]), (path, material, c[0], c[2], c[3])]
    return out


def test_flat_planes_stay_flat(spark):
    got = inner(spark, plane("0", 1))
    assert 0 < len(got) < 2 * 16 * 16
    for r in got:
        for c in (r.a, r.b, r.c):
            assert math.isclose(c.z, 5.0, abs_tol=1e-6) and (c.nx, c.ny, c.nz, c.r, c.a) == (0.0, 0.0, 1.0, 1.0, 1.0)


def test_ridges_keep_their_place(spark):
    """The place of a cell lies on both planes that meet in it, not at its middle."""
    got = inner(spark, plane("0", 1, z=lambda x, y: 20.0 - abs(x - 12.0)))
    top = max(c.z for r in got for c in (r.a, r.b, r.c))
    assert top > 19.7
    for r in got:
        for c in (r.a, r.b, r.c):
            assert abs(c.z - (20.0 - abs(c.x - 12.0))) < 0.35


def test_borders_between_tiles_and_materials_stay_closed(spark):
    """Both sides of a border have the very same places."""
    got = inner(spark, plane("0", 1, 8) + plane("1", 2, 8, first=8, color=None, normal=(0.0, 1.0, 0.0)))
    sides = {m: {(c.x, c.y, c.z) for r in got if r.material == m for c in (r.a, r.b, r.c)} for m in (1, 2)}
    assert len(sides[1] & sides[2]) >= 2
    assert all(c.r is None and c.ny == 1.0 for r in got if r.material == 2 for c in (r.a, r.b, r.c))
    assert all(c.r == 1.0 and c.nz == 1.0 for r in got if r.material == 1 for c in (r.a, r.b, r.c))


def test_collapsed_and_repeated_triangles_go(spark):
    tiny = ("0", 1, corner(1, 1, 1), corner(1.1, 1, 1), corner(1, 1.1, 1))
    a, b, c = corner(1, 1, 1), corner(20, 1, 1), corner(1, 20, 1)
    got = inner(spark, [tiny, ("0", 1, a, b, c), ("1", 1, b, c, a), ("1", 2, c, b, a), ("0", None, a, b, c)])
    assert sorted((r.material is None, r.material or 0) for r in got) == [(False, 1), (False, 2), (True, 0)]
    tree, t, root = frames(spark, [("0", 1, a, a, b), ("0", 1, a, b, c)])
    assert tile_merge.merge_tiles(tree, t, root, 1.8).count() == 2  # the leaf's one and the root's
    assert tile_merge.merge_tiles(tree, t.limit(0), root, 1.8).count() == 0


def test_files_carry_all_attributes(spark):
    rows = [("0", 1, corner(0, 0, 0, uv=(0.25, 0.5)), corner(1, 0, 0), corner(0, 1, 0)), ("0", 1, corner(1, 0, 0), corner(1, 1, 0), corner(0, 1, 0)), ("0", 2, *[corner(x, 0, 1, None, None, None) for x in range(3)])]
    _, t, _ = frames(spark, rows)
    parts = tile_merge.parts(t).withColumnRenamed("path", "tile")
    back = {r.prim: r for r in glb.read_meshes(glb.write_meshes(parts).select(F.col("tile").alias("path"), F.col("glb").alias("content"))).collect()}
    one, two = back[0], back[1]
    assert len(one.positions) == 4 and len(one.indices) == 6 and two.normals is None and two.colors is None and two.texcoords is None
    at = one.positions.index([0.0, 0.0, 0.0])
    assert one.texcoords[at] == [0.25, 0.5] and one.colors[at] == [1.0, 0.0, 0.0, 1.0] and np.allclose(one.normals, [0, 0, 1])


def _flat(spark, rows, scale=1.0, at=0.0):
    from tessera.operators import models

    names = [f"{c}{x}" for c in "abc" for x in g.AXES]
    deep = "0" * 5
    tree = spark.createDataFrame([(deep[:k], k, k == 5) for k in range(6)], "path string, depth int, is_leaf boolean")
    root = spark.range(1).select(g.box(*[F.lit(v * scale + at) for v in (0.0, 0.0, 0.0, 64.0, 64.0, 64.0)]).alias("root"))
    t = spark.createDataFrame([(deep, m, *[float(v * scale + at) for v in p]) for m, p in rows], f"path string, material int, {', '.join(f'{n} double' for n in names)}")
    return models.merge_tiles(tree, t, root, 1.8)


def test_corners_of_merged_tiles_go_as_one_long(spark):
    """Levels carry a long for each corner, but where cells are too many; both ways give the same tiles."""
    rows = [(k % 3, [math.sin(k * i) * 20 + 30 for i in range(1, 10)]) for k in range(200)] + [(1, [1, 1, 1, 1.01, 1, 1, 1, 1.01, 1])] + [(0, [1, 1, 1, 9, 1, 1, 1, 9, 1]), (0, [1, 9, 1, 9, 1, 1, 1, 1, 1])]
    near, far = _flat(spark, rows), _flat(spark, rows, 1.0, 2.0**22)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (near, far)]
    assert ["shiftright" in p for p in plans] == [True, False]

    def wanted(at):
        """Places level by level, the corners of a triangle in any order."""
        own = {(m, frozenset(tuple(v + at for v in p[i : i + 3]) for i in (0, 3, 6))) for m, p in rows}
        own = {(m, t) for m, t in own if len(t) == 3}
        found = {("00000", len(own))}
        for d in range(4, -1, -1):
            step = 64.0 * math.pow(0.9, d) / 64
            own = {(m, frozenset(tuple((math.floor(v / step) + 0.5) * step for v in p) for p in t)) for m, t in own}
            own = {(m, t) for m, t in own if len(t) == 3}
            found.add(("0" * d, len(own)))
        return found

    for made, at in ((near, 0.0), (far, 2.0**22)):
        assert {(r.path, r["count"]) for r in made.groupBy("path").count().collect()} == wanted(at)


def test_cells_of_tiles_with_attributes_go_as_one_long(spark, monkeypatch):
    """But where a corner lies so far out that its cell needs more bits; the rest stays the same."""
    rows = plane("0", 1, 4) + plane("1", 2, 4, first=4, color=None)
    out = ("0", 3, corner(1e9, 0, 0), corner(2e9, 0, 0), corner(1e9, 2e9, 0))
    found, kinds, write = [], [], tile_merge.written

    def noted(df, name):
        if name == "clusters":
            kinds.append(df.schema["a"].dataType.simpleString())
        return write(df, name)

    monkeypatch.setattr(tile_merge, "written", noted)
    for some in (rows, [*rows, out]):
        tree, t, root = frames(spark, some)
        content = tile_merge.merge_tiles(tree, t, root, 1.8, 1 / 8).filter("path = '' and material < 3")
        places = {repr(r) for r in content.select("material", *[F.col(c)[x].alias(f"{c}{x}") for c in "abc" for x in g.AXES]).collect()}
        found.append((kinds[-1], places))
    assert found[0][1] == found[1][1] and found[0][1]
    assert [kind for kind, _ in found] == ["bigint", "struct<x:bigint,y:bigint,z:bigint>"]


@pytest.mark.parametrize("rows", [1 << 14, 1])
def test_parts_number_corners_in_one_exchange(spark, monkeypatch, rows):
    """Nulls, NaN and -0 of corners, and tiles and materials apart; rows of a primitive meet once."""
    monkeypatch.setattr(tile_merge, "ROWS", rows)
    nan, seam = float("nan"), corner(-0.0, 0, 0, uv=(None, 0.5))
    rows = [("0", 1, corner(0, 0, 0, uv=(0.25, 0.5)), seam, corner(0, nan, 0)), ("0", 1, corner(0.0, 0, 0, uv=(None, 0.5)), corner(0, nan, 0), corner(-1, 0, 0)), ("0", None, seam, seam, seam), ("1", 1, seam, corner(1, 0, 0), corner(2, 0, 0))]
    _, t, _ = frames(spark, rows)
    parts = tile_merge.parts(t)
    got = {(r.path, r.part): r for r in parts.collect()}
    assert sorted(got) == [("0", -1), ("0", 1), ("1", 1)]
    one = got["0", 1]
    x = np.array(one.positions).reshape(-1, 3)
    assert len(x) == 4 and x[0].tolist() == [-1, 0, 0] and np.isnan(x[3, 1]) and one.texcoords is None and len(one.normals) == 12 and len(one.colors) == 16
    assert one.indices[1] == one.indices[3] == 1 and one.indices[0] == 2 and one.indices[2] == one.indices[4] == 3 and one.indices[5] == 0
    assert got["0", -1].material is None and got["0", -1].indices == [0, 0, 0] and got["1", 1].material == 1 and len(set(got["1", 1].indices)) == 3
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_items_of_one_box_and_material_go_as_one(spark, tmp_path, monkeypatch):
    """Three copies of each line and part make no more rows of items, and the tiles of the SQL."""
    import duckdb

    from tessera.plans import model_queries
    from tessera.plans.oracles import ORACLES
    from tests.same import assert_same

    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    keys = {"lineitem": "l_orderkey + k * 10000 AS l_orderkey, l_partkey + k * 10000 AS l_partkey", "part": "CAST(p_partkey + k * 10000 AS BIGINT) AS p_partkey"}
    for name, key in keys.items():
        con.execute(f"COPY (SELECT * EXCLUDE (k) REPLACE ({key}) FROM '{at}/{name}.parquet', range(3) r(k)) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    rows, write = {}, model_queries.written

    def noted(df, name, **options):
        out = write(df, name, **options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(model_queries, "written", noted)
    assert_same(model_queries.merge_tiles(spark, str(tmp_path)), con, ORACLES["merge_tiles"])
    assert rows["placed"] <= con.execute(f"SELECT count(*) FROM '{at}/lineitem.parquet'").fetchone()[0]
