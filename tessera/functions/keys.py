"""Keys by which shapes, meshes and their materials count as the same.

A key is the JSON text of a struct, so two keys are equal iff all of their parts
are; a missing part is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def significant(x: Column, digits: int = 6) -> Column:
    """x rounded to a number of significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / unit) * unit)


def shape_key(kind: Column, orientation: Column, faces: Column, edges: Column, vertices: Column, box: Column) -> Column:
    """A CAD shape: its type, orientation, numbers of parts and size, wherever it
    lies.  The box is that of the shape with all placements applied."""
    size = F.when(g.valid_box(box), F.array(*[g.extent(box, a) for a in g.AXES]))
    return F.to_json(F.struct(kind.alias("type"), orientation.alias("orientation"), faces.alias("faces"), edges.alias("edges"), vertices.alias("vertices"), size.alias("size")))


def colors_key(colors: Column) -> Column:
    """gen, surf and curv, each a list of three or null, to six digits."""
    return F.struct(*[F.transform(colors[c], lambda x: significant(x)).alias(c) for c in ("gen", "surf", "curv")])


def has_color(colors: Column) -> Column:
    return F.coalesce(colors["gen"], colors["surf"], colors["curv"]).isNotNull()


def shape_material_key(appearance: Column) -> Column:
    """appearance: colors, has_material and faces (each colors and has_material).
    All shapes without an appearance share a key."""
    faces = F.transform(appearance["faces"], lambda f: F.struct(colors_key(f["colors"]).alias("colors"), f["has_material"].alias("has_material")))
    key = F.struct(colors_key(appearance["colors"]).alias("colors"), appearance["has_material"].alias("has_material"), faces.alias("faces"))
    return F.when(appearance.isNull(), "none").otherwise(F.to_json(key))


def face_material_key(appearance: Column, face: Column) -> Column:
    """The face's own colours; of faces without an entry, which colours and whether
    a material the shape has."""
    own = F.get(appearance["faces"], face.cast("int"))
    given = F.struct(F.lit("face").alias("of"), colors_key(own["colors"]).alias("colors"), own["has_material"].alias("has_material"))
    kept = F.struct(*[appearance["colors"][c].isNotNull().alias(c) for c in ("gen", "surf", "curv")])
    shape = F.struct(F.lit("shape").alias("of"), kept.alias("colors"), appearance["has_material"].alias("has_material"))
    inside = face < F.size(appearance["faces"])
    return F.when(appearance.isNull(), "none").when(inside, F.to_json(given)).otherwise(F.to_json(shape))


def mesh_key(vertices: Column, faces: Column, kinds: Column, box: Column) -> Column:
    """A mesh: its numbers of vertices and faces, its kinds of primitives and its
    box on a grid of 1e-5, of which six digits count."""
    corner = F.array(*[significant(F.round(box[f"{a}{e}"] * 100_000.0)) for e in ("min", "max") for a in g.AXES])
    return F.to_json(F.struct(vertices.alias("vertices"), faces.alias("faces"), kinds.alias("kinds"), F.when(g.valid_box(box), corner).alias("box")))


def mesh_material_key(index: Column, base: Column, base_texture: Column, diffuse_texture: Column) -> Column:
    """A mesh's material: its place in the file, its base colour in thousandths (grey
    without one), its texture.  No index: no material."""
    rgba = F.transform(F.coalesce(base, F.array(*[F.lit(0.7)] * 3, F.lit(1.0))), lambda x: F.round(x * 1000).cast("long"))
    return F.when(index.isNull(), "none").otherwise(F.to_json(F.struct(index.alias("index"), rgba.alias("rgba"), F.coalesce(base_texture, diffuse_texture).alias("texture"))))
