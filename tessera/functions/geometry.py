"""Boxes, 4x4 matrices and vectors as Column expressions.

A box is a struct of six doubles (xmin .. zmax); a null struct is a void box.  A
matrix is an array of 16 doubles, row by row unless said otherwise.  All of this
stays in generated code: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")

#: Thresholds that results must share (fixed values): how far w may be from 1, and from
#: 0, for a point to be divided by it; the least length of a normal; the least radius
#: of a box with content.
W_IS_ONE, W_IS_ZERO = 1e-8, 1e-12
LEAST_NORMAL = 1e-18
LEAST_RADIUS = 1e-9


def box(xmin, ymin, zmin, xmax, ymax, zmax) -> Column:
    values = dict(xmin=xmin, ymin=ymin, zmin=zmin, xmax=xmax, ymax=ymax, zmax=zmax)
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(k) for k, v in values.items()])


def extent(b: Column, axis: str) -> Column:
    return b[f"{axis}max"] - b[f"{axis}min"]


def center(b: Column, axis: str) -> Column:
    return (b[f"{axis}min"] + b[f"{axis}max"]) * F.lit(0.5)


def diagonal(b: Column) -> Column:
    """Length of the diagonal; 0 for a void box."""
    dx, dy, dz = (extent(b, a) for a in AXES)
    return F.coalesce(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(0.0))


def max_side(b: Column) -> Column:
    """Longest side; 0 for a void box."""
    return F.coalesce(F.greatest(*(extent(b, a) for a in AXES)), F.lit(0.0))


def tile_box(b: Column) -> Column:
    """The 12 numbers of a 3D-tile bounding volume.  Scenes are y-up and tiles z-up, so
    y is -z and z is y (fixed values, as is the order of the numbers)."""
    c = {a: center(b, a) for a in AXES}
    h = {a: extent(b, a) * F.lit(0.5) for a in AXES}
    zero = F.lit(0.0)
    return F.array(c["x"], -c["z"], c["y"], h["x"], zero, zero, zero, zero, h["y"], zero, -h["z"], zero)


def sphere(tile: Column) -> Column:
    """Centre and radius around a tile's box: root of the summed squares of its half axes."""
    total = None
    for i in range(4, 13):
        e = F.element_at(tile, i)
        total = e * e if total is None else total + e * e
    return F.struct(*[F.element_at(tile, i + 1).alias(a) for i, a in enumerate(AXES)], F.sqrt(total).alias("radius"))


def volume_sphere(volume: Column) -> Column:
    """The sphere of a bounding volume (box, sphere, region; all nullable): a sphere's
    own four numbers, else that around the box; regions have none."""
    given = F.struct(*[F.element_at(volume["sphere"], i + 1).alias(n) for i, n in enumerate((*AXES, "radius"))])
    return F.when(volume["sphere"].isNotNull(), given).when(volume["box"].isNotNull(), sphere(volume["box"]))


def octant(parent: Column, item: Column) -> Column:
    """0..7: which octant of ``parent`` the centre of ``item`` lies in (void: 0)."""
    bits = [F.when(center(item, a) >= center(parent, a), 1 << i).otherwise(0) for i, a in enumerate(AXES)]
    return F.coalesce(bits[0] + bits[1] + bits[2], F.lit(0))


def child(parent: Column, index: Column, loose: float) -> Column:
    """The loose octant ``index``: centred a quarter side out, a quarter side times ``loose`` wide either way."""
    sides = {}
    for i, a in enumerate(AXES):
        side = extent(parent, a)
        sign = F.when(index.bitwiseAND(F.lit(1 << i)) != 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        mid = center(parent, a) + sign * (side * F.lit(0.25))
        half = side * F.lit(0.25) * F.lit(float(loose))
        sides[f"{a}min"], sides[f"{a}max"] = mid - half, mid + half
    return box(**sides)


def inside(outer: Column, inner: Column) -> Column:
    """Closed containment of one box in another."""
    tests = [(inner[f"{a}min"] >= outer[f"{a}min"]) & (inner[f"{a}max"] <= outer[f"{a}max"]) for a in AXES]
    return tests[0] & tests[1] & tests[2]


def only_child(parent: Column, item: Column, loose: float) -> Column:
    """The one loose octant that contains ``item``; -1 if none or several do.

    An octant contains a box iff it does on each axis, so the axes are tested
    apart: on each, exactly one of the two sides must hold the box.
    """
    index, one = None, F.lit(True)
    for i, a in enumerate(AXES):
        quarter = extent(parent, a) * F.lit(0.25)
        half = quarter * F.lit(float(loose))
        holds = [(item[f"{a}min"] >= mid - half) & (item[f"{a}max"] <= mid + half) for mid in (center(parent, a) - quarter, center(parent, a) + quarter)]
        one = one & (holds[0] != holds[1])
        bit = F.when(holds[1], 1 << i).otherwise(0)
        index = bit if index is None else index + bit
    return F.when(one, index).otherwise(-1)


def union_of(b: Column) -> list[Column]:
    """Aggregates for the smallest box around all boxes (null boxes do not count)."""
    low = [F.min(b[f"{a}min"]).alias(f"{a}min") for a in AXES]
    return low + [F.max(b[f"{a}max"]).alias(f"{a}max") for a in AXES]


# -- matrices ---------------------------------------------------------------


def _m(m: Column, row: int, col: int) -> Column:
    return F.element_at(m, 4 * row + col + 1)


def once(make, *values: Column) -> Column:
    """make(values) with each value computed once, however often it is used."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: make(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def multiply(a: Column, b: Column) -> Column:
    """a times b, both row by row (of columns; bind expressions with ``once``)."""
    cells = []
    for r in range(4):
        for c in range(4):
            cells.append(_m(a, r, 0) * _m(b, 0, c) + _m(a, r, 1) * _m(b, 1, c) + _m(a, r, 2) * _m(b, 2, c) + _m(a, r, 3) * _m(b, 3, c))
    return F.array(*cells)


def transpose(m: Column) -> Column:
    """Row by row <-> column by column."""
    return F.array(*[_m(m, c, r) for r in range(4) for c in range(4)])


def multiply_by_columns(a: Column, b: Column) -> Column:
    """a times b, both column by column."""
    return once(multiply, b, a)


def identity() -> Column:
    return F.array(*[F.lit(1.0 if r == c else 0.0) for r in range(4) for c in range(4)])


def translation(x: Column, y: Column, z: Column) -> Column:
    o, i = F.lit(0.0), F.lit(1.0)
    return F.array(i, o, o, x, o, i, o, y, o, o, i, z, o, o, o, i)


def scaling(x: Column, y: Column, z: Column) -> Column:
    o, i = F.lit(0.0), F.lit(1.0)
    return F.array(x, o, o, o, o, y, o, o, o, o, z, o, o, o, o, i)


def rotation(x: Column, y: Column, z: Column, w: Column) -> Column:
    """From a unit quaternion."""
    o, i = F.lit(0.0), F.lit(1.0)

    return F.array(
        i - (y * y + z * z) * 2.0, (x * y - z * w) * 2.0, (x * z + y * w) * 2.0, o,
        (x * y + z * w) * 2.0, i - (x * x + z * z) * 2.0, (y * z - x * w) * 2.0, o,
        (x * z - y * w) * 2.0, (y * z + x * w) * 2.0, i - (x * x + y * y) * 2.0, o,
        o, o, o, i,
    )


def local_matrix(matrix: Column, t: Column, r: Column, s: Column) -> Column:
    """A node's matrix if it has one of 16 numbers, else translation * rotation * scale."""

    def part(v: Column, i: int, default: float) -> Column:
        return F.coalesce(F.try_element_at(v, F.lit(i)), F.lit(default))

    moved = translation(*(part(t, i, 0.0) for i in (1, 2, 3)))
    turned = rotation(*(part(r, i, d) for i, d in ((1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0))))
    built = once(multiply, once(multiply, moved, turned), scaling(*(part(s, i, 1.0) for i in (1, 2, 3))))
    return F.when(F.size(matrix) == 16, matrix).otherwise(built)


def move_point(m: Column, x: Column, y: Column, z: Column, projective: bool = False) -> list[Column]:
    """The point's coordinates after m; projective: divided by w where that is neither 1 nor 0."""
    out = [_m(m, r, 0) * x + _m(m, r, 1) * y + _m(m, r, 2) * z + _m(m, r, 3) for r in range(3)]
    if projective:
        w = _m(m, 3, 0) * x + _m(m, 3, 1) * y + _m(m, 3, 2) * z + _m(m, 3, 3)
        divide = (F.abs(w - 1.0) > W_IS_ONE) & (F.abs(w) > W_IS_ZERO)
        out = [F.when(divide, c / F.when(divide, w).otherwise(1.0)).otherwise(c) for c in out]
    return out


def move_box(m: Column, b: Column) -> Column:
    """The box around the eight moved corners."""
    corners = [move_point(m, *(b[f"{a}{'max' if k >> i & 1 else 'min'}"] for i, a in enumerate(AXES))) for k in range(8)]
    low = [F.least(*(c[i] for c in corners)) for i in range(3)]
    high = [F.greatest(*(c[i] for c in corners)) for i in range(3)]
    return F.when(b.isNotNull(), box(*low, *high))


def determinant(m: Column) -> Column:
    """Of the upper left 3x3 part."""
    a, b, c, d, e, f, g, h, i = (_m(m, r, k) for r in range(3) for k in range(3))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def normalized(x: Column, y: Column, z: Column, least: float = LEAST_NORMAL) -> list[Column]:
    n = F.sqrt(x * x + y * y + z * z)
    ok = n > least
    return [F.when(ok, v / F.when(ok, n).otherwise(1.0)).otherwise(0.0) for v in (x, y, z)]


def move_direction(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return normalized(*[_m(m, r, 0) * x + _m(m, r, 1) * y + _m(m, r, 2) * z for r in range(3)])


def move_normal(m: Column, x: Column, y: Column, z: Column, least: float = LEAST_NORMAL) -> list[Column]:
    """By the inverse transpose; unchanged where the matrix is singular."""
    a, b, c, d, e, f, g, h, i = (_m(m, r, k) for r in range(3) for k in range(3))
    det = determinant(m)
    ok = F.abs(det) > least
    by = F.when(ok, det).otherwise(1.0)
    # rows of the cofactor matrix, over the determinant
    rows = ((e * i - f * h, f * g - d * i, d * h - e * g), (c * h - b * i, a * i - c * g, b * g - a * h), (b * f - c * e, c * d - a * f, a * e - b * d))
    moved = normalized(*[(p * x + q * y + r * z) / by for p, q, r in rows])
    return [F.when(ok, new).otherwise(old) for new, old in zip(moved, (x, y, z), strict=True)]


def wind(det: Column, a: Column, b: Column, c: Column) -> Column:
    """A triangle's corners; mirrored matrices swap the last two."""
    return F.when(det < 0, F.array(a, c, b)).otherwise(F.array(a, b, c))


# -- vectors ----------------------------------------------------------------


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def area_metric(p: list[Column], q: list[Column], r: list[Column]) -> Column:
    """The squared length of the cross product of two sides: (2 * area) ** 2."""
    n = cross(minus(q, p), minus(r, p))
    return dot(n, n)


def clamp(v: Column, low, high) -> Column:
    """low .. high; NaN becomes low."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(F.isnan(v), low).otherwise(F.greatest(low, F.least(v, high)))


def lerp(a, b, t: Column) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return a + (b - a) * t


def quantize(v: Column, step: float) -> Column:
    """v on a grid of ``step``, ties away from zero; a step of 0 or less leaves it."""
    return F.round(v / F.lit(step)) * F.lit(step) if step > 0 else v


def grid(v: Column, per_unit: float) -> Column:
    """The whole number of the grid cell, with ``per_unit`` cells to a unit."""
    return F.round(v * F.lit(float(per_unit))).cast("long")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def valid_box(b: Column, content: bool = True) -> Column:
    """Present, finite, ordered and, if content is expected, not a point."""
    ok = b.isNotNull()
    for a in AXES:
        ok = ok & finite(b[f"{a}min"]) & finite(b[f"{a}max"]) & (b[f"{a}min"] <= b[f"{a}max"])
    return F.coalesce(ok & (diagonal(b) * 0.5 > LEAST_RADIUS) if content else ok, F.lit(False))


def camera(radius: Column, fov_degrees: float) -> Column:
    """Distance, near and far planes, and speed that fit a sphere in view."""
    fit = radius / F.sin(F.radians(F.lit(float(fov_degrees))) / 2)
    return F.struct((fit * 1.2).alias("distance"), F.greatest(fit / 1000, F.lit(0.01)).alias("near"), (fit * 20).alias("far"), F.greatest(radius * 0.5, F.lit(1.0)).alias("speed"))
