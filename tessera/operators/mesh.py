"""Mesh cleaning as relational operators.

vertices: prim_id, vidx, x y z and optional attributes; triangles: prim_id,
tidx, a, b, c (vertex indices).  Each operator is a group or an equi-join, so a
scene of any size is cleaned without holding one mesh in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.materials import canonical
from tessera.storage import written

CORNERS = ("a", "b", "c")


def cell(v: Column, step: float) -> Column:
    """The number of a value's grid cell; a step of 0 or less keeps all values apart."""
    return F.round(v / F.lit(step)).cast("long") if step > 0 else v


def weld(vertices: DataFrame, steps: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., vidx, to): each vertex and the first vertex that equals it on the grid."""
    keys = [cell(F.col(c), s).alias(f"_k{i}") for i, (c, s) in enumerate(steps.items())]
    names = [f"_k{i}" for i in range(len(keys))]
    v = vertices.select(*by, "vidx", *keys)
    first = v.groupBy(*by, *names).agg(F.min("vidx").alias("to"))
    return v.join(first, [*by, *names]).select(*by, "vidx", "to")


def welded(remap: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., to, new): kept vertices, numbered in order of first appearance."""
    kept = remap.filter("vidx = to").select(*by, "to")
    if by:
        return kept.withColumn("new", (F.row_number().over(Window.partitionBy(*by).orderBy("to")) - 1).cast("long"))
    from tessera.operators.ids import dense_ids

    return dense_ids(kept, ["to"], "new")


def gather(triangles: DataFrame, table: DataFrame, key: str, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Look the three corners up: <column>_a, <column>_b, <column>_c, null if missing."""
    out = triangles
    for c in CORNERS:
        side = table.select(*[F.col(k).alias(f"_{k}") for k in by], F.col(key).alias("_key"), *[F.col(x).alias(f"{x}_{c}") for x in columns])
        on = F.col(c) == F.col("_key")
        for k in by:
            on = on & (F.col(k) == F.col(f"_{k}"))
        out = out.join(side, on, "left").drop("_key", *[f"_{k}" for k in by])
    return out


def rewire(triangles: DataFrame, remap: DataFrame) -> DataFrame:
    """Corners after a weld; missing vertices become 0 and are counted."""
    got = gather(triangles, remap, "vidx", ["to"])
    missed = sum((F.col(f"to_{c}").isNull().cast("int") for c in CORNERS[1:]), F.col("to_a").isNull().cast("int"))
    return got.select("prim_id", "tidx", *[F.coalesce(f"to_{c}", F.lit(0).cast("long")).alias(c) for c in CORNERS], missed.alias("missed"))


def valid_primitives(triangles: DataFrame, vertex_count: Column) -> DataFrame:
    """Triangles of primitives in which every index is in range: one bad index
    rejects its whole primitive."""
    bad = F.lit(False)
    for c in CORNERS:
        bad = bad | (F.col(c) < 0) | (F.col(c) >= vertex_count)
    rejected = triangles.filter(bad).select("prim_id").distinct()
    return triangles.join(rejected, "prim_id", "left_anti")


def in_range(triangles: DataFrame, vertex_count: Column) -> DataFrame:
    ok = F.lit(True)
    for c in CORNERS:
        ok = ok & (F.col(c) >= 0) & (F.col(c) < vertex_count)
    return triangles.filter(ok)


def distinct_corners(triangles: DataFrame) -> DataFrame:
    return triangles.filter((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))


def with_area(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """The area metric, (2 * area) ** 2, of each triangle."""
    got = gather(triangles, vertices, "vidx", ["x", "y", "z"])
    p = [[F.col(f"{a}_{c}") for a in g.AXES] for c in CORNERS]
    return got.withColumn("area2", g.area_metric(*p)).select(*triangles.columns, "area2")


def solid(triangles: DataFrame, vertices: DataFrame, eps: float = 1e-20) -> DataFrame:
    """Triangles with distinct corners and an area."""
    return with_area(distinct_corners(triangles), vertices).filter(F.col("area2") > eps)


#: Parts of a doubling of the area that are counted apart.
FINE = 256


def budget(triangles: DataFrame, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` triangles (per ``by``): the smallest go first, ties by
    (prim_id, tidx).

    Over all, the threshold is selected, not sorted for: triangles are counted by the
    logarithm of their area, and only those of the class in which the budget ends are
    put in order.  Within budget nothing is counted but their number.
    """
    if by:
        total = triangles.groupBy(*by).agg(F.count("*").alias("_n"))
        all_ = triangles.join(total, list(by))
        within = all_.filter(F.col("_n") <= most).drop("_n")
        rank = Window.partitionBy(*by).orderBy("area2", "prim_id", "tidx")
        over = all_.filter(F.col("_n") > most).withColumn("_r", F.row_number().over(rank))
        return within.unionByName(over.filter(F.col("_r") > F.col("_n") - most).drop("_r", "_n"))
    from tessera.operators.ids import dense_ids

    # null areas come first and NaN last, as in an order; so do areas of 0 and infinite ones
    area = F.col("area2")
    kind = F.when(area.isNull(), F.lit(-1 << 40)).when(F.isnan(area), F.lit(1 << 40)).when(area <= 0, F.lit(-1 << 39)).when(area == float("inf"), F.lit(1 << 39)).otherwise(F.floor(F.log2(area) * FINE)).cast("long")
    classes = sorted(triangles.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect())  # at most FINE for each power of two
    drop, before = max(0, sum(c["n"] for c in classes) - most), 0
    if not drop:
        return triangles
    for c in classes:
        if before + c["n"] >= drop:
            break
        before += c["n"]
    edge = dense_ids(triangles.filter(kind == c["k"]), ["area2", "prim_id", "tidx"], "_r").filter(F.col("_r") >= drop - before).drop("_r")
    return triangles.filter(kind > c["k"]).unionByName(edge)


def compact(triangles: DataFrame) -> DataFrame:
    """(prim_id, vidx, new): used vertices, numbered by first use; others go."""
    use = triangles.select("prim_id", F.posexplode(F.array(*CORNERS)).alias("k", "vidx"), "tidx")
    first = use.groupBy("prim_id", "vidx").agg(F.min(F.struct("tidx", "k")).alias("at"))
    return first.select("prim_id", "vidx", (F.row_number().over(Window.partitionBy("prim_id").orderBy("at")) - 1).cast("long").alias("new"))


def groups(primitives: DataFrame) -> DataFrame:
    """Which primitives merge: equal material, mode and attributes; strips, fans
    and loops (modes other than 0, 1, 4) keep to themselves."""
    key = ["material", "mode", "has_normals", "has_texcoord", "has_color"]
    alone = F.when(F.col("mode").isin(0, 1, 4), 0).otherwise(F.row_number().over(Window.partitionBy(*key).orderBy("prim_id")) - 1)
    mergeable = primitives.filter(F.col("mode").isin(0, 1, 4)).withColumn("bucket", F.lit(0))
    rest = primitives.filter(~F.col("mode").isin(0, 1, 4)).withColumn("bucket", alone.cast("int"))
    both = mergeable.unionByName(rest)
    return both.groupBy(*key, "bucket").agg(F.count("*").alias("n_primitives"), F.sum("n_vertices").cast("long").alias("n_vertices"), F.sum("n_indices").cast("long").alias("n_indices"))


def group_order(grouped: DataFrame) -> DataFrame:
    """Groups numbered in the order of their keys, part by part."""
    from tessera.operators.ids import dense_ids

    return dense_ids(grouped, ["material", "mode", "has_normals", "has_texcoord", "has_color", "bucket"], "group_id")


def offsets(df: DataFrame, size: str, order: list[str], by: list[str], name: str) -> DataFrame:
    """Running totals: where each row's part begins."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def buffer_layout(buffers: DataFrame, by: list[str], order: list[str], align: int = 8) -> DataFrame:
    """Offsets of buffers in one buffer: each is padded to ``align`` bytes, and an
    empty one that is not the last takes ``align`` bytes."""
    last = F.lead(F.lit(1)).over(Window.partitionBy(*by).orderBy(*order)).isNull()
    padded = F.when((F.col("bytes") == 0) & ~last, align).otherwise(F.floor((F.col("bytes") + (align - 1)) / align).cast("long") * align)
    return offsets(buffers.withColumn("padded", padded.cast("long")), "padded", order, by, "offset")


def dedup_materials(materials: DataFrame) -> DataFrame:
    """(midx, to): each material and the first that equals it but for its name."""
    key = canonical(*(F.col(c) for c in ("base", "metallic", "roughness", "mode", "cutoff", "double_sided")))
    m = materials.select("midx", key.alias("k"))
    first = m.groupBy("k").agg(F.min("midx").alias("to"))
    return m.join(first, "k").select("midx", "to")


def opaque_black(vertices: DataFrame, colors: list[str], by: list[str], eps: float = 1e-6) -> DataFrame:
    """Groups all of whose vertex colours are black: their colours can go."""
    black = F.lit(True)
    for c in colors:
        black = black & (F.abs(F.col(c)) <= eps)
    return vertices.groupBy(*by).agg(F.bool_and(black).alias("all_black"))


def cluster(triangles: DataFrame, vertices: DataFrame, step: float) -> DataFrame:
    """Simplify by vertex clustering: vertices of a grid cell become its first, and
    triangles that collapse, or that then repeat, go."""
    to = weld(vertices, {a: step for a in g.AXES})
    moved = distinct_corners(rewire(triangles, to).drop("missed"))
    same = F.array_sort(F.array(*CORNERS))
    return moved.withColumn("_key", same).groupBy("prim_id", "_key").agg(F.min(F.struct("tidx", *CORNERS)).alias("t")).select("prim_id", "t.*")


def bake(instances: DataFrame, vertices: DataFrame) -> DataFrame:
    """A copy of a prototype's vertices for each instance, moved by its matrix."""
    m = F.col("world_m")
    moved = instances.join(vertices, "prototype_id")
    point = g.move_point(m, *(F.col(a) for a in g.AXES), projective=True)
    normal = g.move_normal(m, *(F.col(a) for a in ("nx", "ny", "nz")), least=1e-30)
    return moved.select("instance_id", "prototype_id", "vidx", *[p.alias(a) for p, a in zip(point, g.AXES, strict=True)], *[p.alias(a) for p, a in zip(normal, ("nx", "ny", "nz"), strict=True)])


def triangle_count(indices: Column, positions: Column, mode: Column) -> Column:
    return F.when(mode == 4, F.floor(F.coalesce(indices, positions) / 3)).otherwise(0).cast("long")


def optimiser_statistics(triangles: DataFrame, vertex_count: Column, vertices: DataFrame, steps: dict[str, float], eps: float, most: int) -> DataFrame:
    """One row: what each step of cleaning takes away, in order: primitives with a bad
    index, the weld, triangles of fewer than three corners, those without area, and
    what is over the budget."""
    valid = written(valid_primitives(triangles, vertex_count).select("prim_id", "tidx", *CORNERS), "valid")
    remap = written(weld(vertices, steps), "weld")
    moved = written(rewire(valid, remap).drop("missed"), "rewired")
    apart = distinct_corners(moved)
    area = written(with_area(apart, vertices).filter(F.col("area2") > eps), "solid")
    kept = budget(area, most)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name), F.count_distinct("prim_id").alias(f"{name}_prims"))

    sizes = count(triangles, "n0").crossJoin(count(valid, "n1")).crossJoin(count(apart, "n2")).crossJoin(count(area, "n3")).crossJoin(count(kept, "n4"))
    welded_ = remap.agg(F.count("*").alias("input_vertices"), F.count_if(F.col("vidx") == F.col("to")).alias("merged_vertices"))
    used = kept.select(F.explode(F.array(*CORNERS)).alias("v")).agg(F.count_distinct("v").alias("output_vertices"))
    return sizes.crossJoin(welded_).crossJoin(used).select(
        F.col("n0_prims").alias("primitives_seen"),
        F.col("n1_prims").alias("primitives_extracted"),
        (F.col("n0_prims") - F.col("n1_prims")).alias("primitives_with_bad_indices"),
        "input_vertices",
        "merged_vertices",
        "output_vertices",
        F.col("n0").alias("input_triangles"),
        F.col("n4").alias("output_triangles"),
        (F.col("n1") - F.col("n2")).alias("degenerate_by_corner"),
        (F.col("n2") - F.col("n3")).alias("degenerate_by_area"),
        (F.col("n1") - F.col("n3")).alias("removed_by_weld"),
        (F.col("n3") - F.col("n4")).alias("removed_by_budget"),
    )


def input_statistics(meshes: DataFrame, primitives: DataFrame, materials: DataFrame, triangles: DataFrame, vertices: DataFrame, remap: DataFrame) -> DataFrame:
    """One row about what cleaning finds: meshes, materials before and after those that are
    equal became one, primitives whose material changed by that, groups that primitives
    merge into, primitives without any known vertex, triangles with a corner that does not
    exist, and corners that the weld does not know.

    meshes: mesh; primitives: as of ``groups``, with midx; materials: as of
    ``dedup_materials``; triangles, vertices: prim_id and corners, vidx; remap: as of ``weld``.
    """
    same = dedup_materials(materials)
    slots = primitives.join(same, "midx").agg(F.count_if(F.col("midx") != F.col("to")).alias("material_slots_remapped"))
    kinds = same.agg(F.count("*").alias("materials_input"), F.count_distinct("to").alias("materials_canonical"))
    merged = groups(primitives).agg(F.count("*").alias("primitives_merged_out"))
    corner = triangles.select("prim_id", "tidx", F.explode(F.array(*CORNERS)).alias("vidx"))
    known = vertices.select("vidx", F.lit(True).alias("_there")).distinct()
    seen = corner.join(known, "vidx", "left").groupBy("prim_id", "tidx").agg(F.count("_there").alias("_n"))
    by_prim = seen.groupBy("prim_id").agg(F.count_if(F.col("_n") < len(CORNERS)).alias("_bad"), F.max("_n").alias("_most"))
    invalid = by_prim.agg(F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("triangles_with_unknown_vertices"), F.count_if(F.col("_most") == 0).alias("primitives_without_vertices"))
    missed = rewire(triangles, remap).agg(F.coalesce(F.sum("missed"), F.lit(0)).cast("long").alias("corners_without_remap"))
    out = meshes.agg(F.count_distinct("mesh").alias("meshes"))
    for one in (kinds, slots, merged, invalid, missed):  # a row each
        out = out.crossJoin(F.broadcast(one))
    return out
