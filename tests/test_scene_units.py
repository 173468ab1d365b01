"""Probes of single operators: small inputs with known results."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import text as t
from tessera.operators import exchange_text as ex
from tessera.operators import hierarchy, mesh, octree, quality, scene, simplify, tiles
from tessera.operators.ids import dense_ids
from tessera.plans import queries
from tessera.plans.oracles import REC
from tessera.sources import formats, glb
from tessera.streaming import counts
from tests.same import assert_same


def test_adapter_probe(spark):
    occ = spark.createDataFrame([(0, "inst_a", "geom_shared", "mat_shared", False, 10), (1, "inst_b", "geom_shared", "mat_shared", False, 10), (2, "inst_c", "geom_unique", "mat_other", True, 5)], "occ_id long, source_label string, geometry_key string, material_key string, from_explicit boolean, triangles long")
    formats.require(occ)
    dims = scene.prototypes(occ)
    made = dims.withColumn("uri", F.concat(F.lit("instance_lods/proto_"), F.col("prototype_id").cast("string"), F.lit("_high.glb")))
    assert [r.uri for r in scene.with_uris(dims, made).orderBy("prototype_id").collect()] == ["instance_lods/proto_0_high.glb", "instance_lods/proto_1_high.glb"]
    c = scene.counters(occ).first()
    assert (c.instances, c.prototypes, c.dedup_hits, c.explicit_references) == (3, 2, 1, 1)
    inst = {r.source_label: r.prototype_id for r in scene.instances(occ, dims).collect()}
    assert inst == {"inst_a": 0, "inst_b": 0, "inst_c": 1}
    with pytest.raises(ValueError):
        formats.require(occ.drop("triangles"))


def test_mesh_edge_cases(spark):
    tri = spark.createDataFrame([(0, 0, 0, 1, 99), (0, 1, 0, 1, 2), (1, 0, 0, 1, 2)], "prim_id long, tidx long, a long, b long, c long")
    assert [r.prim_id for r in mesh.valid_primitives(tri, F.lit(3)).collect()] == [1]
    assert mesh.in_range(tri, F.lit(3)).count() == 2
    m = spark.range(1).select(g.scaling(F.lit(-1.0), F.lit(1.0), F.lit(1.0)).alias("m")).select(g.wind(g.determinant(F.col("m")), F.lit(0), F.lit(1), F.lit(2)).alias("w"))
    assert m.first().w == [0, 2, 1]


CORPUS = [
    ("#1=APPLIED_GROUP_ASSIGNMENT(#9,$);", None),
    ("#2=COMPLEX_TRIANGULATED_FACE('',#5,3,((0.,0.,1.)),$,(1,2,3),(),((1)));", None),
    ("#3=SURFACE_STYLE_RENDERING_WITH_PROPERTIES($,#4,(#5));", None),
    ("#4=GROUP_RELATIONSHIP($,$,#1,#2);", "#4=GROUP_RELATIONSHIP('','',#1,#2);"),
    ("#5=ITEM_DEFINED_TRANSFORMATION($,$,#6,#7);", "#5=ITEM_DEFINED_TRANSFORMATION('',$,#6,#7);"),
    ("#6=PRODUCT_DEFINITION_SHAPE($,$,#7);", "#6=PRODUCT_DEFINITION_SHAPE('',$,#7);"),
    ("#7=SURFACE_SIDE_STYLE('',(#3));", None),
    ("#8=TESSELLATED_SOLID('',(#2));", None),
    ("ENDSEC;", "ENDSEC;"),
]


def test_exchange_text(spark):
    r = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CORPUS)], "rec_no long, text string")
    c = ex.classify(r)
    assert {x.rec_no: x.text for x in ex.sanitize(c).collect()} == {i: y for i, (_, y) in enumerate(CORPUS) if y is not None}
    assert {(x.rec_no, x.round) for x in ex.removed(c).collect()} == {(0, 0), (1, 0), (2, 0), (6, 1), (7, 1)}


def test_structure_of_records(spark):
    """Brackets, commas and references within strings are none; blanks don't count."""
    rows = [
        "#1 = SURFACE_SIDE_STYLE ( 'a,(b#9' , ( #2 , #3 ) ) ;",
        "#2=TESSELLATED_SOLID($,(#7),#5);",
        "#3=( LENGTH_UNIT() NAMED_UNIT(*) SI_UNIT($,.METRE.) X(#1,RATIO(2.),'Y(') );",
        "#4=COMPLEX_TRIANGULATED_FACE('x,(),y',#5,3,((0.,0.,1.)),$,(1,2,3),((1)));",
        "#5=GROUP_RELATIONSHIP('n',$,#1,#2);",
        "#6=GROUP_RELATIONSHIP( $ , $ , #1,#2);",
        "#7=PRODUCT_DEFINITION_SHAPE($ , $,#7);",
        "#8=(REPRESENTATION_RELATIONSHIP($, $,#1,#2)SHAPE_REPRESENTATION_RELATIONSHIP($,#4));",
        "#x=A(1);",
        "#9=",
        "# 10=A(1);",
        "#11=1A(#2);",
        "#99999999999999999999=A(1);",
        "",
        "#12=SURFACE_STYLE_RENDERING_WITH_PROPERTIES( .NORMAL_SHADING. ,#4,(#5));",
        "#13=APPLIED_GROUP_ASSIGNMENT ( #9 , $ ) ;",
        "#14=APPLIED_GROUP_ASSIGNMENT('#9',$);",
        None,
    ]
    c = {x.rec_no: x for x in ex.classify(spark.createDataFrame(list(enumerate(rows)), "rec_no long, text string")).withColumn("bad", t.broken(F.col("norm"), F.col("kind"))).withColumn("new", t.patched(F.col("norm"), F.col("kind"))).collect()}
    assert [c[i].entity_id for i in range(len(rows))] == [1, 2, 3, 4, 5, 6, 7, 8, None, 9, None, 11, None, None, 12, 13, 14, None]
    assert c[0].kind == "SURFACE_SIDE_STYLE" and c[0].refs == [2, 3] and c[0].name == "'a,(b#9'" and c[0].types == ["SURFACE_SIDE_STYLE"]
    assert c[1].refs == [] and c[1].kind == "TESSELLATED_SOLID"
    assert c[2].kind == "UNKNOWN" and c[2].types == ["LENGTH_UNIT", "NAMED_UNIT", "SI_UNIT", "X", "RATIO"]
    assert [i for i in c if c[i].bad] == [15]
    assert {i: c[i].new for i in c if c[i].new} == {
        5: "#6=GROUP_RELATIONSHIP('','', #1,#2);",
        6: "#7=PRODUCT_DEFINITION_SHAPE('',$,#7);",
        7: "#8=(REPRESENTATION_RELATIONSHIP('', $,#1,#2)SHAPE_REPRESENTATION_RELATIONSHIP('',#4));",
    }
    assert c[8].kind == c[13].kind == c[17].kind == "NON_ENTITY" and c[11].kind == "UNKNOWN" and c[11].types == []


def test_lines_become_records(spark):
    lines = ["ISO;", "#1=A(1,", " 2);", "", "#2=B(", "#3)", ");", "#4=C("]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert [x.text for x in ex.split_lines(d).orderBy("rec_no").collect()] == ["ISO;", "#1=A(1,\n 2);", "", "#2=B(\n#3)\n);", "#4=C("]


def test_records_of_files_in_blocks(spark, tmp_path, monkeypatch):
    """Records that cross blocks, in files read in many pieces and by line numbers."""
    lines = ["ISO;", "HEADER;"] + [x for i in range(300) for x in ([f"#{i}=A(", f" {'x' * (i % 7)}", f"#{i});"] if i % 3 else [f"#{i}=B({i});"])] + ["ENDSEC;", "#9=C("]
    wanted = ["ISO;", "HEADER;"] + [f"#{i}=A(\n {'x' * (i % 7)}\n#{i});" if i % 3 else f"#{i}=B({i});" for i in range(300)] + ["ENDSEC;", "#9=C("]
    (tmp_path / "a.stp").write_text("\r\n".join(lines))
    (tmp_path / "b.stp").write_text("\n\n".join(lines))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = {}
        for r in formats.step_records(spark, f"file://{tmp_path}").orderBy("rec_no").collect():
            got.setdefault(r.file[-5:], []).append(r.text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert got == {"a.stp": wanted, "b.stp": wanted}
    monkeypatch.setattr(ex, "BLOCK_LINES", 4)
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert [x.text for x in ex.split_lines(d).orderBy("rec_no").collect()] == wanted


def test_shards_and_files(spark, tmp_path):
    c = ex.classify(spark.createDataFrame([(i, f"#{i}=X({i});") for i in range(10)], "rec_no long, text string"))
    assert sorted(x.shard for x in ex.shards(c, 3).collect()) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    (tmp_path / "a.STP").write_text("HEADER;\n#1=A(\n1);\n")
    (tmp_path / "b.txt").write_text("#1")
    assert [x.path.rsplit("/", 1)[1] for x in formats.step_files(spark, f"file://{tmp_path}").collect()] == ["a.STP"]
    assert formats.step_records(spark, f"file://{tmp_path}/a.STP").count() == 2
    assert formats.json_rows(spark, f"file://{tmp_path}/none.json", "a long").count() == 0
    formats.write_records(spark.createDataFrame([(1, "x")], "rec_no long, text string"), f"file://{tmp_path}/out")


def test_octree_equals_recursion(spark):
    rng = np.random.default_rng(3)
    pts = rng.random((600, 3)) ** 2
    d = spark.createDataFrame([(i, *map(float, p), 400) for i, p in enumerate(pts)], "id long, x double, y double, z double, triangles long")
    items = d.select("id", g.box("x", "y", "z", "x", "y", "z").alias("box"), "triangles")
    rules = octree.Rules(max_depth=6, max_items=20, max_triangles=100)
    tree = octree.with_tile_ids(octree.nodes(items, rules))
    got = {r.path: (r.n_items, r.is_leaf, r.tile_id) for r in tree.collect()}
    low, high = pts.min(0), pts.max(0)
    wanted, number = {}, [0]

    def grow(path, ids, mid, side):
        leaf = len(path) >= 6 or len(ids) <= 20 or 400 * len(ids) <= 100
        if not leaf:
            for k in range(8):
                sign = np.array([1 if k >> i & 1 else -1 for i in range(3)])
                inside = ids[(((pts[ids] >= mid) == (sign > 0)).all(axis=1))]
                if len(inside):
                    grow(path + str(k), inside, mid + sign * side / 4, side * 0.9)
        wanted[path] = (len(ids), leaf, number[0])
        number[0] += 1

    grow("", np.arange(len(pts)), (low + high) / 2, high - low)
    assert got == wanted
    rows = tiles.tileset(tiles.node_table(items, rules))
    doc = json.loads(tiles.tileset_json(rows, 1.0))
    assert doc["root"]["refine"] == "REPLACE" and doc["root"]["children"]
    with pytest.raises(ValueError):
        tiles.tileset_json(rows, 1.0, most_nodes=3)


def test_queries_divide_clusters_to_the_end(spark):
    """The queries' rules are the production ones: 20 levels, 96 items, 30,000 triangles."""
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.random((400, 3)), 0.3 + rng.random((1500, 3)) * 0.01])
    d = spark.createDataFrame([(i, *map(float, p), 400) for i, p in enumerate(pts)], "id long, x double, y double, z double, triangles long")
    items = d.select("id", g.box("x", "y", "z", "x", "y", "z").alias("box"), "triangles")
    got = {r.path: (r.n_items, r.is_leaf) for r in octree.nodes(items, queries.RULES).collect()}
    low, high = pts.min(0), pts.max(0)
    wanted = {}

    def grow(path, ids, mid, side):
        leaf = len(path) >= 20 or len(ids) <= 96 or 400 * len(ids) <= 30_000
        wanted[path] = (len(ids), leaf)
        for k in range(0 if leaf else 8):
            sign = np.array([1 if k >> i & 1 else -1 for i in range(3)])
            inside = ids[((pts[ids] >= mid) == (sign > 0)).all(axis=1)]
            if len(inside):
                grow(path + str(k), inside, mid + sign * side / 4, side * 0.9)

    grow("", np.arange(len(pts)), (low + high) / 2, high - low)
    assert max(map(len, wanted)) > 12 and got == wanted


def test_retarget_and_stub_leave_all_other_records(spark, duck):
    """All rows, of which the queries of these operators show a part."""
    sf = "/root/testdata/sf0.001"
    stub = "COMPLEX_TRIANGULATED_FACE('',#14338,3,((0.,0.,0.)),$,(1,2,3),(),((1)));"
    c = queries._classified(spark, sf)
    solid = "CASE WHEN m = 9 AND rec_no BETWEEN 1 AND 100 THEN regexp_replace(norm, '([(,])#\\d+', '\\1#7', 'g') ELSE text END"
    assert_same(ex.retarget(c, 1, 100, 7), duck, f"WITH {REC} SELECT rec_no, {solid} AS text FROM cls")
    face = "m = 2 AND entity_id BETWEEN 20 AND 90"
    text = "'#' || entity_id || '=" + stub.replace("'", "''") + "'"
    assert_same(ex.stub_range(c, "COMPLEX_TRIANGULATED_FACE", 20, 90, stub), duck, f"WITH {REC} SELECT rec_no, CASE WHEN {face} THEN {text} ELSE text END AS text, coalesce({face}, false) AS stubbed FROM cls")


def test_empty_tree(spark):
    items = spark.createDataFrame([], "id long, box struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>, triangles long")
    assert octree.nodes(items, octree.Rules()).count() == 0


def test_glb_and_b3dm(spark, tmp_path):
    data = glb.build([glb.box_mesh([0, 0, 0], [1, 2, 3])])
    assert glb.unwrap_b3dm(glb.wrap_b3dm(data, {"b": "2", "a": "1"})) == ({"BATCH_LENGTH": 1}, {"a": ["1"], "b": ["2"]}, data)
    with pytest.raises(ValueError):
        glb.wrap_b3dm(b"")
    bad = bytearray(data)
    struct.pack_into("<I", bad, 8, len(data) + 4)
    doc, body = glb.parse(data)
    x, i = glb.numbers(doc, body, 0), glb.accessor(doc, body, 1)[:, 0]
    i = i.copy()
    i[0] = 99
    odd = glb.build([{"positions": x, "indices": i}])
    got = {r.file: r.status for r in glb.read_meshes(spark.createDataFrame([("ok", bytearray(data)), ("cut", bad), ("odd", bytearray(odd)), ("none", None)], "path string, content binary")).collect()}
    assert got["ok"] == "ok" and got["cut"].startswith("file") and got["odd"].startswith("primitive") and got["none"].startswith("file")
    out = glb.write_meshes(spark.createDataFrame([(1, 0, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], [0, 1, 2], 0)], "tile long, part int, positions array<array<double>>, indices array<long>, material int")).first()
    assert glb.parse(bytes(out.glb))[0]["meshes"][0]["name"] == "merged-optimized"


def test_simplify_keeps_vertices_and_ratio(spark):
    n = 12
    v = [(0, y * n + x, float(x), float(y), 0.0) for y in range(n) for x in range(n)]
    tri, k = [], 0
    for y in range(n - 1):
        for x in range(n - 1):
            o = y * n + x
            tri += [(0, k, o, o + 1, o + n), (0, k + 1, o + 1, o + n + 1, o + n)]
            k += 2
    vd = spark.createDataFrame(v, "prim_id long, vidx long, x double, y double, z double")
    td = spark.createDataFrame(tri, "prim_id long, tidx long, a long, b long, c long")
    out = simplify.simplify(td, vd, 0.4, 0.5).collect()
    assert 0 < len(out) <= 0.45 * len(tri) and all(0 <= r.a < n * n for r in out)
    assert mesh.cluster(td, vd, 3.0).count() < len(tri)


def test_hierarchy(spark):
    roots = spark.range(1).select(F.lit("r").alias("node"), g.identity().alias("matrix"), F.lit("r").alias("path"))
    edges = spark.createDataFrame([("r", "a", 0), ("r", "a", 1), ("a", "m", 0)], "parent string, child string, slot int").withColumn("matrix", g.translation(F.lit(1.0), F.lit(0.0), F.col("slot").cast("double")))
    placed = hierarchy.flatten(roots, edges)
    assert sorted(r.path for r in placed.collect()) == ["r", "r/a#mesh_0", "r/a#mesh_0/m#mesh_0", "r/a#mesh_1", "r/a#mesh_1/m#mesh_0"]
    none = spark.createDataFrame([], "node string, mesh string")
    assert hierarchy.scene_meshes(placed, none, spark.createDataFrame([("m",), ("n",)], "mesh string")).count() == 2
    loop = spark.createDataFrame([("r", "r", 0)], "parent string, child string, slot int").withColumn("matrix", g.identity())
    with pytest.raises(RuntimeError):
        hierarchy.flatten(roots, loop, most_levels=4)


def test_functions(spark):
    d = spark.range(1)
    assert d.select(g.clamp(F.lit(float("nan")), 1.0, 2.0)).first()[0] == 1.0
    assert d.select(t.join_uri(F.lit(""), F.lit("x"))).first()[0] == "x"
    assert d.select(formats.route(F.lit("a.FBX"), F.lit("auto"))).first()[0] == "fbx"
    assert d.select(t.mime(F.lit("x/y.JPG"))).first()[0] == "image/jpeg"
    r = dense_ids(spark.createDataFrame([(x,) for x in "dbca"], "k string"), ["k"], "i")
    assert {x.k: x.i for x in r.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    tri = [(0, 0, [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 1.0, "z": 0.0}])]
    near = [(0, 5, [{"x": 0.004, "y": 1.0, "z": 0.0}, {"x": 0.0, "y": 0.003, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.002}])]
    kind = "prim_id long, tidx long, p array<struct<x:double,y:double,z:double>>"
    assert quality.near_triangles(spark.createDataFrame(tri, kind), spark.createDataFrame(near, kind), 0.01).count() == 1
    assert quality.near_triangles(spark.createDataFrame(tri, kind), spark.createDataFrame(near, kind), 0.001).count() == 0


def test_tileset_scan(spark, tmp_path):
    doc = {"root": {"geometricError": 2, "boundingVolume": {"box": [0.0] * 12}, "children": [{"geometricError": 0, "content": {"uri": "a"}, "boundingVolume": {"box": [1.0] * 12}}]}}
    (tmp_path / "tileset.json").write_text(json.dumps(doc))
    rows = formats.tileset_rows(spark, f"file://{tmp_path}/tileset.json").collect()
    assert {(r.path, r.depth, r.error, r.uri) for r in rows} == {("", 0, 2.0, None), ("0", 1, 0.0, "a")}


def test_scene_source(spark, tmp_path):
    from tessera.sources.datasource import SceneSource

    (tmp_path / "s.jsonl").write_text('{"occ_id": 1, "source_label": "a", "triangles": 3}\n\n')
    spark.dataSource.register(SceneSource)
    got = spark.read.format("scene").option("path", str(tmp_path)).load().collect()
    assert [(r.occ_id, r.triangles) for r in got] == [(1, 3)]


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    q = counts.event_windows(s).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == e.count()
    box = g.box(*[F.col("value").cast("double")] * 6)
    items = s.select(box.alias("box"), F.lit(1).cast("long").alias("triangles"))
    root = g.box(*[F.lit(0.0)] * 3, *[F.lit(100.0)] * 3)
    q = counts.prefix_counts(items, root, 3).writeStream.outputMode("complete").format("memory").queryName("p").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT n_items FROM p WHERE depth = 0").first()[0] == e.count()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("levels", [1, 3, 7])
def test_octree_equals_a_recursive_build(spark, levels, monkeypatch):
    """Clustered boxes, void ones and repeated places; nodes, members, ids and errors of a plain recursion."""
    import random

    monkeypatch.setattr(octree, "LEVELS", levels)
    rules = octree.Rules(max_depth=9, max_items=3, max_triangles=20)
    r = random.Random(4)
    rows = []
    for i in range(300):
        scale = 10.0 ** -r.randrange(5)
        c = [r.random() * scale for _ in range(3)]
        rows.append((i, None if i % 50 == 7 else tuple(x - 0.001 for x in c) + tuple(x + 0.001 for x in c), 1 + i % 4))
    rows += [(300 + i, rows[0][1], 9) for i in range(12)]
    items = spark.createDataFrame(rows, "id long, box struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>, triangles long").repartition(5)
    boxes = [b for _, b, _ in rows if b]
    low, high = [min(b[k] for b in boxes) for k in range(3)], [max(b[k + 3] for b in boxes) for k in range(3)]
    wanted, member = {}, {}

    def divide(path, center, inside):
        d = len(path)
        n, t = len(inside), sum(x[2] for x in inside)
        side = max(h - a for a, h in zip(low, high, strict=True)) * (rules.loose / 2) ** d
        leaf = d >= rules.max_depth or n <= rules.max_items or t <= rules.max_triangles or side <= 1e-6
        wanted[path] = (d, n, t, min(x[0] for x in inside), leaf)
        if leaf:
            member.update({x[0]: path for x in inside})
            return
        step = [0.25 * (rules.loose / 2) ** d * (h - a) for a, h in zip(low, high, strict=True)]
        parts = {}
        for x in inside:
            mid = [(x[1][k] + x[1][k + 3]) * 0.5 if x[1] else float("-inf") for k in range(3)]
            parts.setdefault(sum(1 << k for k in range(3) if mid[k] - center[k] >= 0), []).append(x)
        for k, part in parts.items():
            divide(path + str(k), [c + s * (1 if k >> i & 1 else -1) for i, (c, s) in enumerate(zip(center, step, strict=True))], part)

    divide("", [(a + b) / 2 for a, b in zip(low, high, strict=True)], rows)
    assert max(map(len, wanted)) >= 7
    placed = octree.placed(items, rules)
    tree = octree.nodes(placed, rules)
    assert {x.path: (x.depth, x.n_items, x.tri_sum, x.first_id, x.is_leaf) for x in tree.collect()} == wanted
    assert {x.item_id: x.path for x in octree.membership(placed, tree, rules, "triangles").collect()} == member
    order = {p: k for k, p in enumerate(sorted(wanted, key=lambda p: p + "8"))}
    assert {x.path: x.tile_id for x in octree.with_tile_ids(tree).collect()} == order


def test_tile_errors_shrink_all_the_way_down(spark):
    """Levels that hardly shrink: each is at most 0.97 of what its parent's is."""
    own = [10.0, 9.9, 9.8, 5.0, 4.99]
    t = spark.createDataFrame([("0" * d, d, e, d == 4) for d, e in enumerate(own)], "path string, depth int, own_error double, is_leaf boolean")
    got = {x.depth: x.tile_error for x in tiles.tile_errors(t).collect()}
    wanted = [own[0]]
    for e in own[1:]:
        wanted.append(min(e, 0.97 * wanted[-1]))
    assert all(abs(got[d] - w) < 1e-9 for d, w in enumerate(wanted[:-1])) and got[4] == 0.0


def test_shared_folder(spark, tmp_path, monkeypatch):
    """Tables lie in a folder of the application, which can be deleted; a cluster must name it."""
    import os

    from tessera import storage

    assert storage._home(spark).endswith(f"/tessera/{spark.sparkContext.applicationId}")
    monkeypatch.setattr(storage, "_home", lambda spark: f"file://{tmp_path}/shared/tessera/app")
    assert storage.written(spark.range(3), "x").count() == 3 and len(os.listdir(tmp_path / "shared/tessera/app")) == 1
    storage.forget(spark)
    assert os.listdir(tmp_path / "shared/tessera") == []

    class Other:
        master, applicationId = "spark://host:7077", "a"

        def get(self, key, default):
            return default

    other = Other()
    other.conf = other.sparkContext = other
    with pytest.raises(ValueError):
        storage.shared_dir(other)
    other.master = "local[2]"
    assert storage.shared_dir(other) == storage.shared_dir(other)


def test_options():
    from tessera.options import Options

    made = Options("in.stp", input_format="STEP")
    assert made.input_format == "step" and made.uri(7) == "tiles/tile_7.b3dm"
    wrong = [{"content_subdir": ""}, {"tile_prefix": ""}, {"input_format": "obj"}, {"viewer_sse": 0.0}, {"viewer_sse": float("nan")}, {"min_size_ratio": -1.0}, {"min_size_ratio": float("inf")}]
    for bad in wrong:
        with pytest.raises(ValueError, match=next(iter(bad))):
            Options("in.stp", **bad)
    with pytest.raises(ValueError):
        Options("")


def test_glb_with_textures_materials_and_colors(spark):
    """Equal images are stored once; unsound files have a status and stop nothing."""
    image = (b"\x89PNG....", "image/png")
    mesh_ = glb.box_mesh([0.0] * 3, [1.0] * 3) | {"colors": [[1.0, 0.0, 0.0, 1.0]] * 8, "material": 1}
    data = glb.build([mesh_], [{"name": "a", "image": image}, {"name": "b", "image": image, "pbrMetallicRoughness": {"metallicFactor": 0.0}}])
    doc, body = glb.parse(data)
    assert len(doc["images"]) == len(doc["textures"]) == 1 and doc["samplers"] == [glb.SAMPLER]
    assert [m["pbrMetallicRoughness"]["baseColorTexture"] for m in doc["materials"]] == [{"index": 0}] * 2
    view = doc["bufferViews"][doc["images"][0]["bufferView"]]
    assert body[view["byteOffset"] : view["byteOffset"] + view["byteLength"]] == image[0]
    prim = doc["meshes"][0]["primitives"][0]
    assert prim["material"] == 1 and (glb.numbers(doc, body, prim["attributes"]["COLOR_0"]) == [1.0, 0.0, 0.0, 1.0]).all()

    def other(text):
        part = text.encode() + b" " * (-len(text) % 4)
        return struct.pack("<4sIIII", b"glTF", 2, 20 + len(part), len(part), glb.JSON_CHUNK) + part

    files = [("ok", data), ("list", other("[1]")), ("meshes", other('{"meshes":[3]}')), ("prims", other('{"meshes":[{"primitives":[7,{"attributes":4}]}]}')), ("null", None), ("none", other("{}"))]
    got = {}
    for r in glb.read_meshes(spark.createDataFrame(files, "path string, content binary")).collect():
        got.setdefault(r.file, []).append((r.status, r.indices and len(r.indices), r.positions and len(r.positions)))
    assert got["ok"] == [("ok", 36, 8)] and "none" not in got
    assert all(x[0].startswith("file:") for k in ("list", "meshes", "null") for x in got[k]) and [x[0][:10] for x in got["prims"]] == ["primitive:"] * 2


def test_tile_content_as_files(spark):
    """Merged triangles of a tile become a primitive per material, with shared corners."""
    from tessera.operators import models

    names = [f"{c}{a}" for c in "abc" for a in "xyz"]
    square = [((0, 0, 0), (1, 0, 0), (1, 1, 0)), ((0, 0, 0), (1, 1, 0), (0, 1, 0))]
    rows = [("0", m, *[float(v) for p in t for v in p]) for m in (3, None) for t in square]
    d = spark.createDataFrame(rows, "path string, material long, " + ", ".join(f"{x} double" for x in names))
    parts = models.parts(d)
    assert {(r.part, r.material, len(r.positions), len(r.indices)) for r in parts.collect()} == {(3, 3, 12, 6), (-1, None, 12, 6)}
    made = glb.write_meshes(parts.withColumnRenamed("path", "tile")).withColumnRenamed("tile", "path").withColumnRenamed("glb", "content")
    doc, _ = glb.parse(made.first().content)
    assert len(doc["meshes"][0]["primitives"]) == 2 and len(doc["materials"]) == 1
    back = glb.read_meshes(made).orderBy("prim").collect()
    assert [r.material for r in back] == [None, 0]
    for r in back:
        corners = [tuple(r.positions[i]) for i in r.indices]
        assert {tuple(sorted(corners[k : k + 3])) for k in (0, 3)} == {tuple(sorted(tuple(map(float, p)) for p in t)) for t in square}


def test_evidence_and_shard_files(spark, tmp_path):
    from tessera.plans import model_queries as mq

    sf = "/root/testdata/sf0.001"
    occ = mq._appearances(spark, sf)
    formats.write_evidence(scene.evidence(occ), occ, f"file://{tmp_path}/e")
    assert spark.read.json(f"file://{tmp_path}/e/import_evidence").first().occurrences == 200
    assert spark.read.json(f"file://{tmp_path}/e/occurrence_evidence").filter("has_appearance").count() == occ.filter("size % 10 <> 0").count()
    rows = mq.export_evidence(spark, sf)
    for _ in range(2):
        formats.append_export_evidence(rows, f"file://{tmp_path}/e")
    assert spark.read.json(f"file://{tmp_path}/e/export_evidence").count() == 2 * rows.count()
    texts = [(i, f"#{i}=A({i});" if 1 < i < 12 else f"LINE {i}") for i in range(14)]
    c = ex.classify(spark.createDataFrame(texts, "rec_no long, text string"))
    formats.write_shards(ex.shard_texts(c, 3), 10, 3, "in.stp", f"file://{tmp_path}/shards")
    got = [next((tmp_path / f"shards/shard={k:02d}").glob("part-*")).read_text() for k in range(3)]
    head, foot = "LINE 0\nLINE 1\n", "LINE 12\nLINE 13\n"
    assert all(x.startswith(head) and x.endswith(foot) for x in got)
    assert "".join(x[len(head) : -len(foot)] for x in got) == "".join(f"{x}\n" for _, x in texts[2:12])
    manifest = spark.read.json(f"file://{tmp_path}/shards_manifest").first()
    assert (manifest.base, manifest.remainder, [s.entities for s in manifest.shards]) == (3, 1, [4, 3, 3])


def test_files_that_are_not_there(spark, tmp_path):
    assert formats.step_files(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "b.step").write_text("x")
    (tmp_path / "a.STP").write_text("xy")
    (tmp_path / "c.txt").write_text("x")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in formats.step_files(spark, f"file://{tmp_path}").collect()] == [("a.STP", 2), ("b.step", 1)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_tileset_files_say_what_one_file_says(spark, levels):
    """References followed, the files make up the whole tree."""
    paths = ["", "0", "1", "00", "01", "07", "000", "001", "0010", "0017", "00170", "001700", "1" + "2"]
    leaf = {p: not any(q != p and q.startswith(p) for q in paths) for p in paths}
    rows = spark.createDataFrame([(p, len(p), i, [float(i)] * 12, 0.0 if leaf[p] else 9.0 - len(p), leaf[p], f"tile_{i}.b3dm") for i, p in enumerate(paths)], "path string, depth int, tile_id long, box array<double>, error double, is_leaf boolean, uri string")
    files = {r.uri: json.loads(r.text) for r in tiles.tileset_files(rows, 50.0, levels).collect()}

    def follow(node):
        uri = node.get("content", {}).get("uri", "")
        if uri.startswith("tileset_"):
            assert node["geometricError"] == files[uri]["root"]["geometricError"]
            return follow(files[uri]["root"])
        return {k: [follow(c) for c in v] if k == "children" else v for k, v in node.items()}

    whole = json.loads(tiles.tileset_json(rows, 50.0))
    assert files["tileset.json"]["geometricError"] == 50.0 and follow(files["tileset.json"]["root"]) == whole["root"]
    assert len(files) > 1


def test_scene_occurrences(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"occ_id": 1, "source_label": "a", "triangles": 3, "from_explicit": true}\n\n{"occ_id": 2, "geometry_key": "g", "x": 1}\n')
    got = formats.scene_occurrences(spark, f"file://{tmp_path}").orderBy("occ_id").collect()
    assert [(r.occ_id, r.source_label, r.geometry_key, r.from_explicit, r.triangles) for r in got] == [(1, "a", None, True, 3), (2, None, "g", False, 0)]
    assert formats.scene_occurrences(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("most", [0, 1, 7, 20, 33, 60, 61, 100])
def test_budget_selects_what_an_order_would(spark, most):
    areas = [None, float("nan"), float("inf"), 0.0, -1.0, 1e-300, 1e300, *[1.0] * 20, *[1.0 + k / 1000 for k in range(20)], *[2.0**k for k in range(-7, 7)]]
    rows = [(k % 3, k, a) for k, a in enumerate(areas)]
    df = spark.createDataFrame(rows, "prim_id long, tidx long, area2 double")
    got = sorted(r.tidx for r in mesh.budget(df, most).collect())
    order = [r.tidx for r in df.orderBy("area2", "prim_id", "tidx").collect()]
    assert got == sorted(order[max(0, len(rows) - most) :])
