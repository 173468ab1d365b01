"""Colours, materials and packed numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import quantize

#: glTF component types -> (divisor, least value) of a normalised number (fixed values).
COMPONENTS = {5120: (127.0, -1.0), 5121: (255.0, 0.0), 5122: (32767.0, -1.0), 5123: (65535.0, 0.0), 5125: (4294967295.0, 0.0)}


def decode(kind: Column, value: Column, normalized: Column) -> Column:
    """A stored component as a number; null for an unknown type."""
    v = value.cast("double")
    scaled = F.when(kind == 5126, v)
    for code, (by, low) in COMPONENTS.items():
        scaled = scaled.when(kind == code, F.greatest(F.lit(low), v / F.lit(by)))
    plain = F.when(kind.isin(5126, *COMPONENTS), v)
    return F.when(normalized, scaled).otherwise(plain)


def triangle_estimate(existing: Column, faces: Column, per_face: int = 24) -> Column:
    """Triangles there are, else an estimate from faces, within 32 bits."""
    guess = F.least(F.coalesce(faces, F.lit(0)).cast("long") * per_face, F.lit(4294967295))
    return F.when(existing > 0, existing.cast("long")).otherwise(guess)


def expand_color(rgba: Column) -> Column:
    """Four components, alpha 1 where there are three."""
    return F.when(F.size(rgba) == 3, F.concat(rgba, F.array(F.lit(1.0)))).otherwise(rgba)


def canonical(base: Column, metallic: Column, roughness: Column, mode: Column, cutoff: Column, double_sided: Column, unit: float = 1 / 1024) -> Column:
    """What makes two materials one: factors on a grid of 1/1024, and no name."""
    return F.struct(
        F.transform(base, lambda x: quantize(x, unit)).alias("base"),
        quantize(metallic, unit).alias("metallic"),
        quantize(roughness, unit).alias("roughness"),
        mode.alias("mode"),
        quantize(cutoff, unit).alias("cutoff"),
        double_sided.alias("double_sided"),
    )


def pbr_fallback(metallic: Column, roughness: Column, has_texture: Column) -> Column:
    """CAD surfaces are not metal unless a texture says so; odd roughness is 1."""
    ok = roughness.isNotNull() & ~F.isnan(roughness) & (F.abs(roughness) < F.lit(float("inf")))
    return F.struct(F.when(has_texture, metallic).otherwise(0.0).alias("metallic"), F.when(ok, roughness).otherwise(1.0).alias("roughness"))


def default_material() -> Column:
    grey = F.array(*[F.lit(0.8)] * 3, F.lit(1.0))
    return F.struct(grey.alias("base"), F.lit(0.0).alias("metallic"), F.lit(1.0).alias("roughness"), F.lit("OPAQUE").alias("mode"), F.lit(0.5).alias("cutoff"), F.lit(True).alias("double_sided"))


def less_metal(metallic: Column, roughness: Column, has_maps: Column) -> Column:
    """What a viewer shows: near-full metal without maps becomes rough plastic."""
    tame = (metallic >= 0.95) & ~has_maps
    return F.struct(F.when(tame, 0.1).otherwise(metallic).alias("metallic"), F.when(tame, F.greatest(roughness, F.lit(0.8))).otherwise(roughness).alias("roughness"))


def pick_color(*sources: Column) -> Column:
    """The last source that has a colour wins."""
    return F.coalesce(*reversed(sources))


def export_color(surface: Column, general: Column) -> Column:
    return F.coalesce(surface, general)


def first_face_color(shape: Column, faces: Column) -> Column:
    """The shape's colour, else that of its first coloured face (surface, general, curve)."""
    colored = F.filter(faces, lambda f: F.coalesce(f["surf"], f["gen"], f["curv"]).isNotNull())
    return F.coalesce(shape, F.get(F.transform(colored, lambda f: F.coalesce(f["surf"], f["gen"], f["curv"])), F.lit(0)))


def base_color(base: Column, diffuse: Column) -> Column:
    return F.coalesce(base, diffuse, F.array(*[F.lit(0.7)] * 3, F.lit(1.0)))


def uv_channel(base: Column, diffuse: Column, channels: Column) -> Column:
    """The channel of the base colour, else of the diffuse one, else 0; null if the mesh lacks it."""
    c = F.coalesce(base, diffuse, F.lit(0))
    return F.when(c < channels, c)


def double_sided(given: Column, force: Column) -> Column:
    """What the material says, or true where all are to be."""
    return F.coalesce(given, F.lit(False)) | force
