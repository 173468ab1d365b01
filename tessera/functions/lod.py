"""Level-of-detail settings as Column expressions, in double precision.

Fixed values: the constants below are those that tiles made for the same viewer
must agree on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import clamp, lerp

VIEWER_SSE = 80.0

#: (fraction, least, most) of a diagonal that its geometric error may be.
TILE_ERROR, LOW_ERROR = (0.25, 0.08, 0.35), (0.65, 0.25, 0.95)
TILE_SSE, LOW_SSE = (0.5, 2.0), (0.75, 3.0)


def _at_least(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


def node_ratio(node: Column, root: Column) -> Column:
    return clamp(node / _at_least(root, 1e-9), 1e-12, 1e6)


def sse_scale(sse: Column, low: float = TILE_SSE[0], high: float = TILE_SSE[1]) -> Column:
    return clamp(_at_least(sse, 1.0) / F.lit(VIEWER_SSE), low, high)


def geometric_error(diagonal: Column, scale: Column, fraction: float = TILE_ERROR[0], least: float = TILE_ERROR[1], most: float = TILE_ERROR[2]) -> Column:
    low = diagonal * F.lit(least)
    return clamp(diagonal * F.lit(fraction) * scale, low, F.greatest(low, diagonal * F.lit(most)))


def weld_step(node: Column, root: Column) -> Column:
    low = F.greatest(F.lit(1e-12), root * F.lit(1e-9), node * F.lit(1e-9))
    return clamp(node * F.lit(8e-4), low, F.greatest(low, node * F.lit(2e-2)))


def importance(relative: Column, depth: Column) -> Column:
    return clamp(relative * F.lit(0.75) + (F.lit(1.0) - depth) * F.lit(0.25), 0.0, 1.0)


def tuning(node: Column, root: Column, depth: Column, max_depth: Column, leaf: Column, sse: Column) -> dict[str, Column]:
    """A tile's settings from its diagonal, the root's, and where it stands.

    max_depth counts levels: a root alone has one.
    """
    relative = clamp(node / _at_least(root, 1e-9), 0.0, 1.0)
    deep = clamp(depth.cast("double") / F.greatest(max_depth, F.lit(1)).cast("double"), 0.0, 1.0)
    eager = clamp((F.lit(1.0) - relative) * F.lit(0.65) + deep * F.lit(0.35), 0.0, 1.0)
    ratio = node_ratio(node, root)
    error = geometric_error(node, sse_scale(sse))
    share = _at_least(error / _at_least(root, 1e-9), 1e-8)
    loss = _at_least(share * F.lit(0.4), 0.0015) * (F.lit(0.85) + F.lit(0.3) * deep)
    return {
        "relative_size": relative,
        "normalized_depth": deep,
        "importance": importance(relative, deep),
        "position_step": weld_step(node, root),
        "normal_step": clamp(ratio * F.lit(1.5e-3), 3e-5, 2e-2),
        "texcoord_step": clamp(ratio * F.lit(5e-6), 1e-9, 1e-3),
        "simplify_ratio": lerp(0.42, 0.68, F.lit(1.0) - eager),
        "simplify_error": clamp(loss * F.lit(5.0), 0.0075, 0.1),
        "own_error": error,
        "geometric_error": F.when(leaf, 0.0).otherwise(error),
    }


#: Options of the three passes over a tile's meshes.
PRESETS = {
    "leaf": {"weld": True, "dedup_materials": True, "drop_degenerate": True, "simplify": True, "overdraw": False, "texcoord_step": 0.0, "color_step": 1 / 255, "area_eps_sq": 1e-20, "aggression": 1.0},
    "proxy": {"weld": True, "dedup_materials": True, "drop_degenerate": True, "simplify": False, "overdraw": False, "texcoord_step": 0.0, "color_step": 1 / 255, "area_eps_sq": 1e-20, "aggression": 1.0},
    "low_for_parent": {"weld": True, "dedup_materials": True, "drop_degenerate": True, "simplify": True, "overdraw": False, "texcoord_step": 0.0, "color_step": 1 / 255, "area_eps_sq": 1e-20, "aggression": 1.8},
}


def more_aggressive(settings: dict[str, Column], factor: float) -> dict[str, Column]:
    """Coarser steps, more error, and a smaller share of triangles kept."""
    if not factor > 1.0:
        return settings
    out = dict(settings)
    for k in ("position_step", "normal_step", "texcoord_step", "simplify_error"):
        out[k] = settings[k] * F.lit(factor)
    r = settings["simplify_ratio"]
    out["simplify_ratio"] = F.when(r < 1.0, _at_least(r - (F.lit(1.0) - r) * F.lit(factor - 1.0), 0.01)).otherwise(r)
    return out


def tessellation(diagonal: Column, error: Column, sse: Column, proxy: bool, quality: float, linear: tuple[float, float], angular: tuple[float, float]) -> dict[str, Column]:
    """Linear and angular deflection that a policy allows, at twice the density."""
    d = _at_least(diagonal, 1e-9)
    wanted = d * _at_least(_at_least(error, 0.0) / d * F.lit(2.4 if proxy else 0.55) * F.lit(quality) * sse_scale(sse), 5e-4)
    wanted = F.when(error <= 1e-12, d * F.lit(3e-2 if proxy else 2e-3)).otherwise(wanted)
    low = F.greatest(F.lit(1e-12), d * F.lit(max(1e-9, linear[0])))
    length = clamp(wanted, low, F.greatest(low, d * F.lit(max(linear))))
    turn = F.lit(1.6 if proxy else 0.5) + clamp(F.log10(_at_least(length / d, 1e-6)), -2.0, 1.0) * F.lit(0.7)
    return {"linear": _at_least(length * F.lit(0.5), 1e-15), "angular": _at_least(clamp(turn, *angular) * F.lit(0.5), 1e-6), "sse": _at_least(sse, 1.0)}


def high_tessellation(diagonal: Column, sse: Column) -> dict[str, Column]:
    return tessellation(diagonal, F.lit(0.0), sse, False, 0.75, (2e-4, 1.5e-2), (3.0, 9.0))


def low_tessellation(diagonal: Column, sse: Column) -> dict[str, Column]:
    error = geometric_error(F.greatest(diagonal, F.lit(0.0)), sse_scale(sse, *LOW_SSE), *LOW_ERROR)
    return tessellation(diagonal, error, sse, True, 4.0, (5e-3, 8.5e-1), (35.0, 120.0))
