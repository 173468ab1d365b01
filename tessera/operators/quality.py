"""Checks and probes: gates, contracts, texture coordinates, normals, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.mesh import gather
from tessera.storage import written


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def tile_gates(tiles: DataFrame) -> DataFrame:
    """Per tile (primitives, vertices, indices, box): which gates it fails."""
    ok = (F.col("primitives") >= 1) & (F.col("vertices") >= 3) & (F.col("indices") >= 3) & (F.col("indices") % 3 == 0)
    return tiles.select("path", ok.alias("geometry_ok"), g.valid_box(F.col("box"), content=True).alias("bounds_ok"))


def proxy_collapse(tiles: DataFrame, ratio: float = 1e-4) -> DataFrame:
    """Proxies that kept less than ``ratio`` of their children's triangles, or no material."""
    return tiles.filter((F.col("out_triangles") <= F.col("in_triangles") * ratio) | (F.col("materials") == 0))


def contract(evidence: DataFrame, minima: DataFrame) -> DataFrame:
    """Evidence (fixture, counter, value) against minima (fixture, counter, least)."""
    e = evidence.select("fixture", "counter", "value")
    return minima.join(e, ["fixture", "counter"], "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def contract_summary(checked: DataFrame) -> DataFrame:
    per = checked.groupBy("fixture").agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failures"))
    return per


def uv_range(vertices: DataFrame, by: list[str]) -> DataFrame:
    out = (F.col("u") < 0) | (F.col("u") > 1) | (F.col("v") < 0) | (F.col("v") > 1)
    return vertices.groupBy(*by).agg(F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("*").alias("n"), F.count_if(out).alias("outside"))


def normals_per_position(vertices: DataFrame, position: float = 1e6, normal: float = 1e4) -> DataFrame:
    """Of each position (on a grid): how many distinct normals meet there."""
    n = g.normalized(*(F.col(c) for c in ("nx", "ny", "nz")))
    v = vertices.select(*[g.grid(F.col(a), position).alias(f"k{a}") for a in g.AXES], *[g.grid(x, normal).alias(f"n{a}") for x, a in zip(n, g.AXES, strict=True)])
    return v.distinct().groupBy("kx", "ky", "kz").agg(F.count("*").alias("normals"))


def corner_angles(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Degrees between a triangle's normal and the normals of its corners."""
    got = gather(triangles, vertices, "vidx", ["x", "y", "z", "nx", "ny", "nz"])
    p = [[F.col(f"{a}_{c}") for a in g.AXES] for c in "abc"]
    face = g.normalized(*g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0])))
    each = [g.angle(face, g.normalized(*(F.col(f"n{a}_{c}") for a in g.AXES))) for c in "abc"]
    return got.select("prim_id", "tidx", F.explode(F.array(*each)).alias("angle")).filter("angle is not null")


def floor_percentile(df: DataFrame, value: str, by: list[str], share: float = 0.95, width: float = 0.05) -> DataFrame:
    """Mean, largest, and the value at place floor(share * (n - 1)) in order.

    Values are counted in buckets of ``width``, map-side first; the counts say in
    which bucket the place lies, and only that bucket's values are put in order.
    """
    df = written(df.select(*by, value).withColumn("_bucket", F.floor(F.col(value) / width)), "values")
    count = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    place = F.floor(F.lit(share) * (F.sum("_n").over(Window.partitionBy(*by)) - 1))
    at = count.select(*by, "_bucket", "_n", (place - F.coalesce(F.sum("_n").over(up_to), F.lit(0))).alias("_at")).filter("_at >= 0 and _at < _n").drop("_n")
    ranked = df.join(at, [*by, "_bucket"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1)
    total = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return total.join(ranked.filter("_r = _at").select(*by, F.col(value).alias("percentile")), by)


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    bucket = F.floor(value / F.lit(width)) * F.lit(width)
    return df.groupBy(bucket.cast("double").alias("bucket")).agg(F.count("*").alias("n"))


def corner_key(triangles: DataFrame, vertices: DataFrame, digits: int = 9) -> DataFrame:
    """Triangles with a key that does not depend on the order of their corners."""
    got = gather(triangles, vertices, "vidx", ["x", "y", "z"])
    corner = [F.struct(*[F.round(F.col(f"{a}_{c}"), digits).alias(a) for a in g.AXES]) for c in "abc"]
    return got.filter("x_a is not null and x_b is not null and x_c is not null").select("prim_id", "tidx", F.array_sort(F.array(*corner)).alias("key"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left triangle and the first right one with the same corners."""
    first = right.groupBy("key").agg(F.min(F.struct("prim_id", "tidx")).alias("m"))
    return left.join(first, "key").select("prim_id", "tidx", F.col("m.prim_id").alias("other_prim"), F.col("m.tidx").alias("other_tidx"))


def near_triangles(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Left triangles (prim_id, tidx, p: three corner structs) for which some right
    one has, for each corner, a corner within ``eps``.

    A grid of cells of ``eps`` makes candidates an equi-join: a right triangle is
    entered at the cells of its three corners, a left one at the 27 around its first.
    Triangles of equal corners meet as one, so copies do not multiply the rows.
    """
    size = F.lit(float(eps))

    def at(c: Column, d: int, a: str) -> Column:
        return F.floor(c[a] / size).cast("long") + d

    first = F.get("p", F.lit(0))
    around = [F.struct(*[at(first, d, a).alias(a) for d, a in zip((i, j, k), g.AXES, strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    l = left.select("p").distinct().select("p", F.explode(F.array(*around)).alias("cell"))  # noqa: E741
    own = F.array_distinct(F.transform("q", lambda c: F.struct(*[at(c, 0, a).alias(a) for a in g.AXES])))
    r = right.select(F.col("p").alias("q")).distinct().select("q", F.explode(own).alias("cell"))

    def close(x: Column, y: Column) -> Column:
        return (F.abs(x["x"] - y["x"]) <= size) & (F.abs(x["y"] - y["y"]) <= size) & (F.abs(x["z"] - y["z"]) <= size)

    both = l.join(r, "cell").filter(F.forall("p", lambda x: F.exists("q", lambda y: close(x, y))))
    return left.join(both.select("p").distinct(), "p", "left_semi").select("prim_id", "tidx").distinct()


def geometry_statistics(meshes: DataFrame, vertices: DataFrame, matrix: Column, samples: int = 16) -> DataFrame:
    """One row: meshes (prim_id), those with vertices (prim_id, vidx, x, y, z), their
    vertices, and of the first ``samples`` of each mesh how many are at a finite place
    once moved by ``matrix``."""
    first = Window.partitionBy("prim_id").orderBy("vidx")
    place = g.move_point(matrix, *(F.col(a) for a in g.AXES))
    finite = F.lit(True)
    for v in place:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    ranked = vertices.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= samples)
    sampled = ranked.groupBy("prim_id").agg(F.count("*").alias("tried"), F.count_if(finite).alias("finite"))
    size = vertices.groupBy("prim_id").agg(F.count("*").alias("positions"))
    each = meshes.select("prim_id").distinct().join(size, "prim_id", "left").join(sampled, "prim_id", "left")
    total = {"positions": "positions", "samples_tried": "tried", "finite_samples": "finite"}
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in total.items()]
    return each.agg(F.count("*").alias("meshes"), F.count("positions").alias("with_positions"), *sums, F.coalesce(F.sum(F.col("tried") - F.col("finite")), F.lit(0)).cast("long").alias("invalid_samples"))
