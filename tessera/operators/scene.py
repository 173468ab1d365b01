"""Scenes as star schemas: occurrences -> prototypes, instances, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.keys import has_color
from tessera.functions.text import qualified_key
from tessera.operators.ids import dense_ids


def keyed(occurrences: DataFrame) -> DataFrame:
    return occurrences.withColumn("qualified_key", qualified_key(F.col("geometry_key"), F.col("material_key")))


def prototypes(occurrences: DataFrame) -> DataFrame:
    """One row per qualified key, taken from its first occurrence, numbered in
    order of first sight.  A struct's minimum picks the row map-side."""
    first = F.min(F.struct("occ_id", "source_label", "geometry_key", "material_key", "triangles")).alias("f")
    dims = keyed(occurrences).groupBy("qualified_key").agg(first, F.count("*").alias("n_occurrences")).select("qualified_key", "f.*", "n_occurrences").withColumnRenamed("occ_id", "first_occ")
    return dense_ids(dims, ["first_occ"], "prototype_id")


def instances(occurrences: DataFrame, dims: DataFrame) -> DataFrame:
    """One row per occurrence with its prototype; numbered in order of arrival."""
    with_id = dense_ids(keyed(occurrences).select("occ_id", "source_label", "from_explicit", "qualified_key"), ["occ_id"], "instance_id")
    return with_id.join(dims.select("qualified_key", "prototype_id"), "qualified_key").select("instance_id", "prototype_id", "occ_id", "source_label", "from_explicit")


def face_seeds(faces: DataFrame) -> DataFrame:
    """Prototypes of faces (occ_id, face, geometry_key, material_key): first seen wins."""
    key = F.concat(F.lit("face|"), qualified_key(F.col("geometry_key"), F.col("material_key")))
    first = F.min(F.struct("occ_id", "face")).alias("f")
    return faces.groupBy(key.alias("qualified_key")).agg(first, F.count("*").alias("n_faces")).select("qualified_key", F.col("f.occ_id").alias("occ_id"), F.col("f.face").alias("face"), "n_faces")


def all_prototypes(occurrences: DataFrame, faces: DataFrame) -> DataFrame:
    """Occurrences' and faces' prototypes in one space of ids: an occurrence
    before its faces, in order of first sight."""
    whole = keyed(occurrences).groupBy("qualified_key").agg(F.min("occ_id").alias("occ_id")).withColumn("slot", F.lit(0).cast("long"))
    seeds = face_seeds(faces).select("qualified_key", "occ_id", (F.col("face") + 1).cast("long").alias("slot"))
    return dense_ids(whole.unionByName(seeds), ["occ_id", "slot"], "prototype_id")


def counters(occurrences: DataFrame) -> DataFrame:
    """One row: the scene's totals."""
    key = qualified_key(F.col("geometry_key"), F.col("material_key"))
    n, d = F.count("*"), F.count_distinct(key)
    return occurrences.agg(n.alias("instances"), d.alias("prototypes"), (n - d).alias("dedup_hits"), F.count_if("from_explicit").alias("explicit_references"), F.sum("triangles").cast("long").alias("triangles"))


def bake_reference(occurrences: DataFrame, ready: Column) -> DataFrame:
    """For each occurrence the first of its key that is ``ready``: the one whose
    frame its mesh is made in (null if there is none)."""
    ranked = keyed(occurrences).withColumn("_ready", ready)
    first = ranked.filter("_ready").groupBy("qualified_key").agg(F.min("occ_id").alias("reference_occ"))
    return ranked.join(first, "qualified_key", "left").select("occ_id", "qualified_key", "reference_occ")


def with_uris(dims: DataFrame, uris: DataFrame) -> DataFrame:
    """Left lookup of made files by qualified key; none made: empty."""
    return dims.join(uris.select("qualified_key", "uri"), "qualified_key", "left").withColumn("uri", F.coalesce("uri", F.lit("")))


def tile_items(insts: DataFrame, dims: DataFrame) -> DataFrame:
    """id, box, triangles of instances; an unknown prototype has no triangles."""
    return insts.join(dims.select("prototype_id", "triangles"), "prototype_id", "left").select(F.col("instance_id").alias("id"), "box", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def bounds(items: DataFrame) -> DataFrame:
    return items.agg(*g.union_of(F.col("box")), F.count("box").alias("n_boxes"))


def signature_top(colored: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest colour signatures; ties in the order of the signature."""
    return colored.groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(k)


def signature(gen: Column, surf: Column, curv: Column, face_entries: Column) -> Column:
    """A text that equal colourings share; each colour is a text or null."""
    has = [F.when(c.isNotNull(), "1").otherwise("0") for c in (gen, surf, curv)]
    flags = F.concat(F.lit("shape("), F.concat_ws(",", *has), F.lit(")"))
    named = [F.concat(F.lit(f"{n}:"), c) for n, c in (("gen", gen), ("surf", surf), ("curv", curv))]
    return F.concat_ws("|", flags, *named, F.concat(F.lit("faceColorEntries:"), face_entries.cast("string")))


def use_counts(nodes: DataFrame) -> DataFrame:
    """(mesh, uses, explicit): a mesh that several nodes use is referenced explicitly."""
    return nodes.groupBy("mesh").agg(F.count("*").alias("uses")).withColumn("explicit", F.col("uses") > 1)


def key_summary(occurrences: DataFrame, root_diagonal: Column) -> DataFrame:
    """Occurrences and largest diagonal per key, never below the root's."""
    return keyed(occurrences).groupBy("qualified_key").agg(F.count("*").alias("n"), F.greatest(F.max("diagonal"), F.first(root_diagonal)).alias("max_diagonal"))


def rejects(leaves: DataFrame, most: int = 20) -> DataFrame:
    """The first leaves without geometry, and how many more there are."""
    bad = leaves.filter(~F.col("renderable"))
    shown = bad.orderBy("leaf").limit(most)
    more = bad.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return shown.crossJoin(F.broadcast(more))


def evidence(occurrences: DataFrame) -> DataFrame:
    """One row of what an import has found.

    occurrences: appearance (colors, has_material, faces; may be null), face_count,
    has_metadata, and what ``counters`` takes.
    """
    a = F.col("appearance")
    faces = F.coalesce(a["faces"], F.array())
    colored, solid = F.size(F.filter(faces, lambda f: has_color(f["colors"]))), F.size(F.filter(faces, lambda f: f["has_material"]))
    key = qualified_key(F.col("geometry_key"), F.col("material_key"))
    return occurrences.agg(
        F.count("*").alias("occurrences"),
        F.count_distinct(key).alias("prototypes"),
        F.count_if(a.isNotNull() & has_color(a["colors"])).alias("shape_color_occurrences"),
        F.count_if(a.isNotNull() & a["has_material"]).alias("shape_material_occurrences"),
        F.coalesce(F.sum(colored), F.lit(0)).cast("long").alias("face_color_entries"),
        F.coalesce(F.sum(solid), F.lit(0)).cast("long").alias("face_material_entries"),
        F.count_if((colored > 0) | (solid > 0)).alias("occurrences_with_face_style"),
        F.coalesce(F.sum(F.size(faces)), F.lit(0)).cast("long").alias("face_slots"),
        F.coalesce(F.sum("face_count"), F.lit(0)).cast("long").alias("source_faces"),
        F.count_if("has_metadata").alias("metadata_occurrences"),
    )


def export_evidence(occurrences: DataFrame, sse: float, linear: float, angular: float) -> DataFrame:
    """A row per written file: what went in, what came out, and how.

    occurrences: glb (the file), appearance, triangles, glb_triangles, face_slots
    (faces that the export visited).  A file without triangles has status error.
    """
    a = F.col("appearance")
    faces = F.coalesce(a["faces"], F.array())
    rows = occurrences.groupBy("glb").agg(
        F.count("*").alias("occurrences"),
        F.sum("triangles").cast("long").alias("source_triangles"),
        F.sum("glb_triangles").cast("long").alias("glb_triangles"),
        F.count_if(a.isNotNull() & F.coalesce(a["colors"]["surf"], a["colors"]["gen"]).isNotNull()).alias("shape_color_applied"),
        F.count_if(a.isNotNull() & a["has_material"]).alias("shape_material_applied"),
        F.count_if(F.size(faces) > 0).alias("occurrences_with_faces"),
        F.sum(F.size(F.filter(faces, lambda f: F.coalesce(f["colors"]["surf"], f["colors"]["gen"]).isNotNull()))).cast("long").alias("face_color_applied"),
        F.sum(F.size(F.filter(faces, lambda f: f["has_material"]))).cast("long").alias("face_material_applied"),
        F.count_if(a.isNotNull() & (F.size(faces) != F.col("face_slots"))).alias("face_mismatches"),
    )
    status = F.when(F.col("glb_triangles") > 0, "ok").otherwise("error")
    return rows.select("*", F.lit(sse).alias("sse"), F.lit(linear).alias("linear_deflection"), F.lit(angular).alias("angular_deflection"), status.alias("status"))


def scene_evidence(found: DataFrame) -> DataFrame:
    """One row about the scene itself, of a row of ``evidence``."""
    names = ("shape_color_occurrences", "shape_material_occurrences", "face_color_entries", "face_material_entries", "metadata_occurrences")
    return found.select(F.col("occurrences").alias("instances"), "prototypes", *names)


def with_materials(evidence: DataFrame, materials: DataFrame) -> DataFrame:
    """Rows of ``export_evidence`` with the materials of each file (glb, alpha_mode): how
    many there are, are blended and are masked."""
    mode = F.upper(F.coalesce("alpha_mode", F.lit("OPAQUE")))
    counts = materials.groupBy("glb").agg(F.count("*").alias("_all"), F.count_if(mode == "BLEND").alias("_blend"), F.count_if(mode == "MASK").alias("_mask"))
    names = {"_all": "exported_materials", "_blend": "alpha_blend_materials", "_mask": "alpha_mask_materials"}
    return evidence.join(counts, "glb", "left").select(*evidence.columns, *[F.coalesce(k, F.lit(0).cast("long")).alias(v) for k, v in names.items()])


def union_occurrences(*files: DataFrame) -> DataFrame:
    """Occurrences of several files as one scene: numbered anew, file by file, with
    ``file`` (from 0) and their own number as ``file_occ``."""
    out = None
    for i, df in enumerate(files):
        part = df.withColumn("file", F.lit(i)).withColumnRenamed("occ_id", "file_occ")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return dense_ids(out, ["file", "file_occ"], "occ_id")


def with_triangles(occurrences: DataFrame, triangles: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences that have a triangle, with their number; the bounds of all).

    occurrences, triangles, vertices: prim_id and what belongs to it.  An occurrence
    without a triangle goes, but what it spans still counts for the scene's bounds.
    """
    size = triangles.groupBy("prim_id").agg(F.count("*").alias("triangles"))
    bounds = vertices.join(occurrences.select("prim_id").distinct(), "prim_id", "left_semi").agg(*[f(a).alias(f"{a}{e}") for a in g.AXES for e, f in (("min", F.min), ("max", F.max))])
    return occurrences.join(size, "prim_id"), bounds
