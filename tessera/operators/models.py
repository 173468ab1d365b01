"""Models as tables with foreign keys: primitives -> materials -> textures -> images.

primitives: model, prim, material (a material's number in its model, or null);
materials: model, midx, ...  Numbers count from 0 in each model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.materials import default_material
from tessera.operators.ids import dense_ids
from tessera.storage import written


def zip_faces(shapes: DataFrame, faces: str, appearances: str) -> DataFrame:
    """Faces of a shape and its face appearances, place by place; what one list has
    more than the other stays out, and ``mismatch`` says so.  shapes: an id first."""
    n = F.least(F.size(faces), F.size(appearances))
    pair = F.arrays_zip(F.slice(F.col(faces), 1, n).alias("face"), F.slice(F.col(appearances), 1, n).alias("appearance"))
    own = [c for c in shapes.columns if c not in (faces, appearances)]
    rows = shapes.select(*own, (F.size(faces) != F.size(appearances)).alias("mismatch"), F.posexplode(pair).alias("place", "_p"))
    return rows.select(*own, "place", "mismatch", "_p.face", "_p.appearance")


def any_face(appearances: Column, test) -> Column:
    """Whether any face of a list has what ``test`` asks for."""
    return F.coalesce(F.exists(appearances, test), F.lit(False))


def added_and_emitted(added: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of added and of emitted rows differ."""
    a = added.groupBy(key).agg(F.count("*").alias("added"))
    b = emitted.groupBy(key).agg(F.count("*").alias("emitted"))
    both = a.join(b, key, "full_outer").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "emitted")])
    return both.filter("added <> emitted")


def with_material(primitives: DataFrame, materials: DataFrame, *columns: str) -> DataFrame:
    """Columns of each primitive's material; null where it names none or one that is not there."""
    side = materials.select(F.col("model").alias("_model"), F.col("midx").alias("_midx"), *columns)
    on = (F.col("model") == F.col("_model")) & (F.col("material") == F.col("_midx"))
    return primitives.join(side, on, "left").drop("_model", "_midx")


def material_or_default(material: Column) -> Column:
    """material (a struct as of ``default_material``), or the default one for null."""
    return F.coalesce(material, default_material())


def offsets(sizes: DataFrame, *names: str) -> DataFrame:
    """By model, the running totals of its numbers of rows: <name>_base.

    A row per model, numbered by range and summed in blocks of 4,096 models, so
    no task holds all models.
    """
    x = dense_ids(sizes, ["model"], "_n").withColumn("_block", F.floor(F.col("_n") / 4096))
    total = x.groupBy("_block").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per 4,096 models
    start = total.select("_block", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in names])
    within = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    run = [(F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("long").alias(f"{c}_base") for c in names]
    return x.join(F.broadcast(start), "_block").select("model", *names, *run)


def union_models(primitives: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One model of many: (primitives, materials) with ``new_prim``, ``new_material``
    and ``new_midx``.  Keys move by the numbers of the models before; a material out
    of its model's range becomes null."""
    count = primitives.groupBy("model").agg(F.count("*").alias("prims"))
    m = materials.groupBy("model").agg(F.count("*").alias("materials"))
    sizes = count.join(m, "model", "full_outer").select("model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("prims", "materials")])
    base = offsets(sizes, "prims", "materials")
    inside = (F.col("material") >= 0) & (F.col("material") < F.col("materials"))
    p = primitives.join(base, "model").withColumn("new_prim", F.col("prim") + F.col("prims_base"))
    p = p.withColumn("new_material", F.when(inside, F.col("material") + F.col("materials_base")))
    made = materials.join(base.select("model", "materials_base"), "model").withColumn("new_midx", F.col("midx") + F.col("materials_base")).drop("materials_base")
    return p.select(*primitives.columns, "new_prim", "new_material"), made


def canonical_materials(primitives: DataFrame, remap: DataFrame) -> DataFrame:
    """primitives (.., new_material) with ``canonical`` of remap (midx, to); materials that remap lacks stay out."""
    return primitives.join(remap.select(F.col("midx").alias("new_material"), F.col("to").alias("canonical")), "new_material", "left")


def used_resources(primitives: DataFrame, slots: DataFrame, textures: DataFrame) -> DataFrame:
    """(kind, old, new): the materials that primitives use, the textures that these
    use and the images that those use, each numbered by first use.

    slots: midx, slot, texture; textures: texture, image.
    """
    material = primitives.filter("material is not null").groupBy(F.col("material").alias("old")).agg(F.min(F.struct("prim")).alias("at"))
    texture = slots.join(material.select(F.col("old").alias("midx")), "midx", "left_semi").filter("texture is not null").groupBy(F.col("texture").alias("old")).agg(F.min(F.struct("midx", "slot")).alias("at"))
    image = textures.join(texture.select(F.col("old").alias("texture"), "at"), "texture").filter("image is not null").groupBy(F.col("image").alias("old")).agg(F.min(F.struct("at", "texture")).alias("at"))
    out = None
    for kind, rows in (("material", material), ("texture", texture), ("image", image)):
        part = dense_ids(rows, ["at"], "new").select(F.lit(kind).alias("kind"), F.col("old").cast("long").alias("old"), "new")
        out = part if out is None else out.unionByName(part)
    return out


def texture_use(primitives: DataFrame) -> DataFrame:
    """By model: does any material have a texture, any primitive texture coordinates?
    Without either, vertices are welded regardless of them."""
    use = primitives.groupBy("model").agg(F.bool_or("has_texture").alias("any_texture"), F.bool_or("has_texcoord").alias("any_texcoord"))
    return use.withColumn("weld_texcoord", F.col("any_texture") | F.col("any_texcoord"))


def alpha_modes(materials: DataFrame, by: list[str]) -> DataFrame:
    """Materials, and those that blend and that mask."""
    return materials.groupBy(*by).agg(F.count("*").alias("materials"), F.count_if(F.col("mode") == "BLEND").alias("blend"), F.count_if(F.col("mode") == "MASK").alias("mask"))


def fidelity(materials: DataFrame) -> DataFrame:
    """One row: what a viewer counts of its materials (pbr, opacity, cutoff, metallic, has_maps, vertex_colors)."""
    pbr = F.col("pbr")
    return materials.agg(
        F.count("*").alias("materials"),
        F.count_if(pbr).alias("pbr"),
        F.count_if(pbr & (F.col("opacity") < 0.999)).alias("blend"),
        F.count_if(pbr & (F.col("cutoff") > 0)).alias("mask"),
        F.count_if("vertex_colors").alias("vertex_colors"),
        F.count_if(pbr & (F.col("metallic") >= 0.95) & ~F.col("has_maps")).alias("less_metal"),
    )


def strided(df: DataFrame, place: str, count: str, most: int) -> DataFrame:
    """Every k-th row by ``place`` (from 0), k being the least that leaves at most ``most`` of ``count``."""
    step = F.greatest(F.lit(1), F.ceil(F.col(count) / most))
    return df.filter(F.col(place) % step == 0)


def first_examples(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows that a report shows."""
    return df.orderBy(*order).limit(most)


def spheres(meshes: DataFrame, points: DataFrame, most: int = 3000) -> DataFrame:
    """(mesh, source, x, y, z, radius): a mesh's sphere, else that around its box, else
    that around the box of sampled points.

    meshes: mesh, sphere (x, y, z, radius) and box, both nullable; points: mesh,
    place, x, y, z.  Points that are not finite don't count; a mesh with none has
    no row, nor has one of no size.
    """
    count = points.groupBy("mesh").agg(F.count("*").alias("_count"))
    finite = F.lit(True)
    for a in g.AXES:
        finite = finite & (F.abs(F.col(a)) < float("inf"))
    some = strided(points.join(count, "mesh"), "place", "_count", most).filter(finite)
    ends = {f"{a}{e}": (F.min if e == "min" else F.max)(a) for a in g.AXES for e in ("min", "max")}
    sampled = some.groupBy("mesh").agg(*[v.alias(k) for k, v in ends.items()]).select("mesh", g.box(**{k: F.col(k) for k in ends}).alias("_sampled"))
    m = meshes.join(sampled, "mesh", "left")
    box = F.when(g.valid_box(F.col("box")), F.col("box")).otherwise(F.col("_sampled"))
    around = F.struct(*[g.center(box, a).alias(a) for a in g.AXES], (g.diagonal(box) / 2).alias("radius"))
    given = F.col("sphere.radius") > 0
    source = F.when(given, "sphere").when(g.valid_box(F.col("box")), "box").when(F.col("_sampled").isNotNull(), "points")
    out = m.select("mesh", source.alias("source"), F.when(given, F.col("sphere")).otherwise(around).alias("_s"))
    return out.select("mesh", "source", *[F.col(f"_s.{c}").alias(c) for c in (*g.AXES, "radius")]).filter("radius > 0")


def pair_corners(pairs: DataFrame, eps: float) -> DataFrame:
    """Corners of two triangles, nearest first: rows with ``places`` (which corner of q
    goes with each of p) and ``apart`` (the distances), if all are within ``eps``.

    pairs: p and q, arrays of three structs x, y, z.  Nine distances are sorted;
    each is taken unless one of its corners is.
    """

    def gaps(a: Column, i: Column) -> Column:
        return F.transform("q", lambda b, j: F.struct(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in g.AXES[1:]), (a["x"] - b["x"]) * (a["x"] - b["x"])).alias("d"), i.alias("i"), j.alias("j")))

    def take(taken: Column, x: Column) -> Column:
        free = F.forall(taken, lambda y: (y["i"] != x["i"]) & (y["j"] != x["j"]))
        return F.when(free, F.array_append(taken, x)).otherwise(taken)

    every = F.array_sort(F.flatten(F.transform("p", gaps)))
    none = F.array().cast("array<struct<d:double,i:int,j:int>>")
    x = pairs.withColumn("_taken", F.sort_array(F.transform(F.aggregate(every, none, take), lambda y: F.struct(y["i"].alias("i"), y["j"].alias("j"), F.sqrt(y["d"]).alias("d")))))
    x = x.filter((F.size("_taken") == 3) & F.forall("_taken", lambda y: y["d"] <= eps))
    return x.select(*pairs.columns, F.transform("_taken", lambda y: y["j"]).alias("places"), F.transform("_taken", lambda y: y["d"]).alias("apart"))


def instance_files(instances: DataFrame, high: DataFrame, low: DataFrame) -> DataFrame:
    """Each instance's file in high detail, by prototype, and in low detail, by place
    (null if there is none).  Instances without a file or a valid box stay out."""
    x = instances.join(high.select("prototype_id", "uri"), "prototype_id", "left").join(low.select(F.col("place").alias("instance_id"), F.col("uri").alias("low_uri")), "instance_id", "left")
    return x.filter((F.coalesce("uri", F.lit("")) != "") & g.valid_box(F.col("box")))


def missing_files(instances: DataFrame, high: DataFrame) -> DataFrame:
    """Instances whose prototype has no file: a scene with any is not sound."""
    named = high.filter(F.coalesce("uri", F.lit("")) != "").select("prototype_id")
    return instances.join(named, "prototype_id", "left_anti")


def referred(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(label, target, matrix): labels that refer to another stand for it, with both
    placements; others stand for themselves.  labels: label, refers, matrix;
    targets: label, matrix."""
    t = targets.select(F.col("label").alias("refers"), F.col("matrix").alias("_to"))
    both = labels.join(t, "refers", "left")
    return both.select("label", F.coalesce("refers", "label").alias("target"), F.when(F.col("_to").isNull(), F.col("matrix")).otherwise(g.multiply(F.col("matrix"), F.col("_to"))).alias("matrix"))


def distinct_per_tile(members: DataFrame, instances: DataFrame) -> DataFrame:
    """By tile: its items, and how many prototypes they are of."""
    x = members.join(instances.select(F.col("id").alias("item_id"), "prototype_id"), "item_id")
    return x.groupBy("path").agg(F.count("*").alias("n_items"), F.count_distinct("prototype_id").alias("n_prototypes"))


_NINE = [f"{c}{a}" for c in "abc" for a in g.AXES]


def _merged(rows: DataFrame) -> DataFrame:
    """rows (path, depth, material, ax .. cz) without collapsed triangles and with one of
    those that share their corners.  Corners are put in order and a flag says whether
    that turned the triangle over, so that all keys and sums are plain numbers."""
    a, b, c = (F.struct(*[F.col(f"{k}{x}").alias(x) for x in g.AXES]) for k in "abc")
    x = rows.select("path", "depth", "material", a.alias("a"), b.alias("b"), c.alias("c")).filter("a <> b and b <> c and a <> c")
    x = x.withColumn("s", F.sort_array(F.array("a", "b", "c")))
    one, two = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    kept = ((F.col("a") == one) & (F.col("b") == two)) | ((F.col("b") == one) & (F.col("c") == two)) | ((F.col("c") == one) & (F.col("a") == two))
    flat = [F.get("s", F.lit(i))[x_].alias(f"{k}{x_}") for i, k in enumerate("abc") for x_ in g.AXES]
    key = ["path", "depth", "material", *_NINE]
    found = x.select("path", "depth", "material", *flat, (~kept).cast("int").alias("over")).groupBy(*key).agg(F.min("over").alias("over"))
    turned = {"b": "c", "c": "b"}
    corner = [F.when(F.col("over") == 1, F.col(f"{turned.get(k, k)}{x_}")).otherwise(F.col(f"{k}{x_}")).alias(f"{k}{x_}") for k in "abc" for x_ in g.AXES]
    return found.select("path", "depth", "material", *corner)


#: Bits of a cell's number along an axis, where the three of a corner go into one long.
_BITS = 21


def _key(cells: list[Column], packed: bool) -> Column:
    """A corner's cell on all axes: one long, in the order of the axes, or a struct."""
    if not packed:
        return F.struct(*[v.alias(x) for x, v in zip(g.AXES, cells, strict=True)])
    x, y, z = (v + (1 << _BITS - 1) for v in cells)
    return F.shiftleft(x, 2 * _BITS).bitwiseOR(F.shiftleft(y, _BITS)).bitwiseOR(z)


def _cells(key: Column, packed: bool) -> list[Column]:
    if not packed:
        return [key[x] for x in g.AXES]
    return [F.shiftright(key, k * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)) - (1 << _BITS - 1) for k in (2, 1, 0)]


def _merged_cells(rows: DataFrame, by: tuple[str, ...] = ("path", "material")) -> DataFrame:
    """``_merged`` for rows (``by``, a, b, c) whose corners are keys of cells."""
    a, b, c = (F.col(k) for k in "abc")
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    x = rows.filter("a <> b and b <> c and a <> c").select(*by, "a", "b", "c", F.least(a, b, c).alias("s"), middle.alias("t"), F.greatest(a, b, c).alias("u"))
    kept = ((a == F.col("s")) & (b == F.col("t"))) | ((b == F.col("s")) & (c == F.col("t"))) | ((c == F.col("s")) & (a == F.col("t")))
    found = x.groupBy(*by, "s", "t", "u").agg(F.min((~kept).cast("int")).alias("over"))
    turned = F.col("over") == 1
    return found.select(*by, F.col("s").alias("a"), F.when(turned, F.col("u")).otherwise(F.col("t")).alias("b"), F.when(turned, F.col("t")).otherwise(F.col("u")).alias("c"))


def merge_tiles(tree: DataFrame, triangles: DataFrame, root: DataFrame, loose: float, share: float = 1 / 64) -> DataFrame:
    """The content of every tile: (path, material, ax .. cz), a row per triangle.

    triangles: path (of their leaf), material, ax ay az bx .. cz.  A leaf has its
    own triangles; a parent those of its children, with corners moved to the middle
    of their cell on a grid of ``share`` of its largest side.  Triangles that collapse
    go, and of those of a material that share their corners one is left.  Levels are
    made from the deepest up, each from the contents one level below, as numbers of
    cells: a corner is one long where these are small enough, as in most scenes.
    """
    leaves = written(_merged(triangles.withColumn("depth", F.length("path"))), "content")
    depths = [r[0] for r in tree.filter(~F.col("is_leaf")).select("depth").distinct().orderBy(F.desc("depth")).collect()]  # at most 21
    side = root.select(g.max_side(F.col("root"))).first()[0] or 0.0
    void = sum((F.col(n).isNull().cast("int") for n in _NINE[1:]), F.col(_NINE[0]).isNull().cast("int"))
    far, voids = leaves.agg(F.max(F.greatest(*[F.abs(n) for n in _NINE])), F.max(void)).first()
    finest = side * (loose / 2) ** max(depths, default=0) * share
    packed = not voids and (far or 0.0) < finest * ((1 << _BITS - 1) - 2)

    def step(d: int) -> Column:
        return F.lit(float(side)) * F.pow(F.lit(loose / 2), F.lit(d)) * share

    def places(d: int) -> list[Column]:
        return [((v + 0.5) * step(d)).alias(f"{k}{x}") for k in "abc" for x, v in zip(g.AXES, _cells(F.col(k), packed), strict=True)]

    def moved(rows: DataFrame, d: int) -> DataFrame:
        keys = [_key([F.floor(F.col(f"{k}{x}") / step(d)) for x in g.AXES], packed).alias(k) for k in "abc"]
        return rows.select(F.substring("path", 1, d).alias("path"), "material", *keys)

    content, below = leaves.select("path", "material", *_NINE), None
    for d in depths:
        up = moved(leaves.filter(F.col("depth") == d + 1), d)
        if below is not None:
            up = up.unionByName(moved(below, d))
        below = written(_merged_cells(up), "level").select("path", "material", *places(d))
        content = content.unionByName(below)
    return content


def tile_totals(content: DataFrame) -> DataFrame:
    """By tile: triangles, distinct corners and materials of its content."""
    count = content.groupBy("path").agg(F.count("*").alias("triangles"), F.count_distinct("material").alias("materials"))
    corner = content.select("path", F.explode(F.array(*[F.struct(*[F.col(f"{c}{a}").alias(a) for a in g.AXES]) for c in "abc"])).alias("p"))
    return count.join(corner.distinct().groupBy("path").agg(F.count("*").alias("vertices")), "path")


def parts(content: DataFrame) -> DataFrame:
    """(path, part, material, positions, indices): a primitive per tile and material,
    for ``glb.write_meshes``; corners that coincide are one vertex."""

    each = content.select("path", "material", F.monotonically_increasing_id().alias("_t"), F.posexplode(F.array(*[F.struct(*[F.col(f"{c}{a}").cast("float").alias(a) for a in g.AXES]) for c in "abc"])).alias("_k", "p"))
    by = ["path", "material"]
    each = written(each.withColumn("material", F.coalesce("material", F.lit(-1))), "corners")
    vertex = each.select(*by, "p").distinct().withColumn("v", F.row_number().over(Window.partitionBy(*by).orderBy("p")) - 1)
    vertices = vertex.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("v", "p"))).alias("_v"))
    corners = each.join(vertex, [*by, "p"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_t", "_k", "v"))).alias("_i"))
    flat = F.flatten(F.transform("_v", lambda v: F.array(*[v["p"][a] for a in g.AXES])))
    rows = vertices.join(corners, by).withColumn("part", F.col("material").cast("int"))
    return rows.select("path", "part", F.nullif(F.col("part"), F.lit(-1)).alias("material"), flat.alias("positions"), F.transform("_i", lambda i: i["v"]).alias("indices"))
