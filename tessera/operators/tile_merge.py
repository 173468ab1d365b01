"""Contents of inner tiles by quadrics: clustered triangles with all their attributes.

Corners fall into cells of a grid that is halved, or kept, from level to level, so a
cell of a tile is made of whole cells of its children.  What a cell needs is a sum:
the ten numbers of a quadric (squared distances to the planes of its triangles, by
area), the weighted place, normal, texture coordinates and colour.  Tiles add up
those below them, a few levels at a time from the deepest, in plain sums; the place
of a cell is the solution of a three by three system, in SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import AXES, max_side
from tessera.operators.models import _BITS, _NINE, _cells, _key, _merged_cells
from tessera.storage import written

#: Attributes of a corner by the weight that counts for them (fixed values, as are the next two).
SETS = {"normal": ("nx", "ny", "nz"), "texcoord": ("u", "v"), "color": ("r", "g", "b", "a")}
ATTRIBUTES = [c for names in SETS.values() for c in names]

#: How much the mean of its corners pulls at a cell's place, against its planes.
PULL = 0.01

_PLANE = ("nx", "ny", "nz", "d")
_Q = [f"q{i}{j}" for i in range(4) for j in range(i, 4)]
SUMS = [*_Q, "w", *[f"s{a}" for a in AXES], *ATTRIBUTES, *[f"w_{s}" for s in SETS]]

#: Levels that are made in one step.
BAND = 7

#: Triangles whose corners are numbered at once.
ROWS = 1 << 14

#: No cell is weighed less than this, so that triangles without area still have a place.
LEAST_WEIGHT = 1e-12


def grid_levels(loose: float, depths: int = 21) -> list[int]:
    """How often the grid of each depth is halved: as often as tiles of a loose octree halve."""
    return [math.floor(d * math.log2(2 / loose) + 1e-9) for d in range(depths + 1)]


def _of(levels: list[int], depth: Column) -> Column:
    return F.get(F.array(*map(F.lit, levels)), depth)


def _plane(t: dict[str, Column]) -> tuple[Column, list[Column]]:
    """(area, unit normal and distance) of a triangle of columns ax .. cz."""
    u, v = ([t[f"{c}{x}"] - t[f"a{x}"] for x in AXES] for c in "bc")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return size / 2, [F.when(size > 0, x / size).otherwise(0.0) for x in n]


def _prepared(triangles: DataFrame, root: DataFrame, share: float, levels: list[int]) -> DataFrame:
    """path, depth, material, a, b, c; places relative to the root's least corner, and the
    cells (ca, cb, cc) of the leaf's own grid."""
    r = root.select(*[F.col("root")[f"{x}min"].alias(f"_o{x}") for x in AXES], (max_side(F.col("root")) * share).alias("_step"))
    t = triangles.crossJoin(F.broadcast(r)).withColumn("depth", F.length("path"))  # one row
    step = F.col("_step") / F.pow(F.lit(2.0), _of(levels, F.col("depth")))

    def corner(c: str) -> Column:
        return F.struct(*[(F.col(c)[x] - F.col(f"_o{x}")).alias(x) for x in AXES], *[F.col(c)[x].alias(x) for x in ATTRIBUTES])

    def cell(c: str) -> Column:
        return F.struct(*[F.floor((F.col(c)[x] - F.col(f"_o{x}")) / step).cast("long").alias(x) for x in AXES])

    return t.select("path", "depth", "material", *[corner(c).alias(c) for c in "abc"], *[cell(c).alias(f"c{c}") for c in "abc"])


def _leaf_sums(t: DataFrame) -> DataFrame:
    """(path, depth, material, x, y, z, sums): what the corners in a leaf's cells add up to."""
    places = t.select("*", *[F.col(c)[x].alias(f"{c}{x}") for c in "abc" for x in AXES])
    area, normal = _plane({n: F.col(n) for n in _NINE})
    flat = places.withColumn("_w", F.greatest(area, F.lit(LEAST_WEIGHT))).withColumn("_n", F.array(*normal))
    n = [F.get("_n", F.lit(i)) for i in range(3)]
    flat = flat.withColumn("_e", F.array(*n, -(n[0] * F.col("ax") + n[1] * F.col("ay") + n[2] * F.col("az"))))
    each = flat.select("path", "depth", "material", "_w", "_e", F.explode(F.array(*[F.struct(F.col(c).alias("p"), F.col(f"c{c}").alias("cell")) for c in "abc"])).alias("_c"))
    p, w = F.col("_c.p"), F.col("_w")
    e = [F.get("_e", F.lit(i)) for i in range(4)]
    made = {f"q{i}{j}": w * e[i] * e[j] for i in range(4) for j in range(i, 4)}
    made |= {"w": w} | {f"s{x}": w * p[x] for x in AXES} | {x: w * p[x] for x in ATTRIBUTES}
    made |= {f"w_{s}": F.when(p[names[0]].isNotNull(), w) for s, names in SETS.items()}
    cells = each.select("path", "depth", "material", *[F.col("_c.cell")[x].alias(x) for x in AXES], *[v.alias(f"_{k}") for k, v in made.items()])
    return cells.groupBy("path", "depth", "material", *AXES).agg(*[F.sum(f"_{k}").alias(k) for k in made])


def _upwards(leaves: DataFrame, names: list[str], coarser: Callable[[Column], list[Column]], combine: Callable[[DataFrame], DataFrame], levels: list[int]) -> DataFrame:
    """The contents of all nodes above the leaves, ``BAND`` levels at a time from the deepest.

    Rows (path, depth, cells in ``names``, ..) go to each of their ancestors in a band, in
    the cells of its grid (``coarser`` makes them); above the band only what it has made goes on.
    """
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    source, made = leaves, None
    for low in range((deepest - 1) // BAND * BAND if deepest else -1, -1, -BAND):
        mine = source.filter((F.col("depth") > low) & (F.col("depth") <= low + BAND))
        each = mine.withColumn("_d", F.explode(F.sequence(F.lit(low), F.col("depth") - 1)))
        by = F.pow(F.lit(2.0), _of(levels, F.col("depth")) - _of(levels, F.col("_d")))
        up = each.select(F.substr("path", F.lit(1), F.col("_d")).alias("path"), F.col("_d").alias("depth"), *coarser(by), *[c for c in leaves.columns if c not in ("path", "depth", *names)])
        level = written(combine(up), "level")
        made = level if made is None else made.unionByName(level)
        source = leaves.unionByName(made.select(leaves.columns))
    return made if made is not None else combine(leaves).limit(0)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "depth", "material", *AXES).agg(*[F.sum(k).alias(k) for k in SUMS])


def _places(cells: DataFrame, root: DataFrame, share: float, levels: list[int]) -> DataFrame:
    """(path, x, y, z cells, place): the point nearest to all planes of a cell, of any
    material, pulled to the mean of its corners and kept inside the cell."""
    total = cells.groupBy("path", "depth", *AXES).agg(*[F.sum(k).alias(k) for k in (*_Q, "w", "sx", "sy", "sz")])
    pull = F.col("w") * PULL
    a = [[F.col(f"q{min(i, j)}{max(i, j)}") + (pull if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]
    right = [pull * (F.col(f"s{x}") / F.col("w")) - F.col(f"q{i}3") for i, x in enumerate(AXES)]

    def determinant(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    # the pull makes the matrix definite, so its determinant is above 0
    solved = [determinant([[right[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]) / determinant(a) for k in range(3)]
    r = root.select(*[F.col("root")[f"{x}min"].alias(f"_o{x}") for x in AXES], (max_side(F.col("root")) * share).alias("_step"))
    step = F.col("_step") / F.pow(F.lit(2.0), _of(levels, F.col("depth")))
    inside = [F.greatest(F.col(x) * step, F.least((F.col(x) + 1) * step, v)) + F.col(f"_o{x}") for x, v in zip(AXES, solved, strict=True)]
    return total.crossJoin(F.broadcast(r)).select("path", *AXES, F.struct(*[v.alias(x) for x, v in zip(AXES, inside, strict=True)]).alias("place"))  # one row


def _attributes() -> list[Column]:
    """Means by weight; normals of length 1, or none where they cancel out."""
    out = []
    size = F.sqrt(sum((F.col(x) * F.col(x) for x in SETS["normal"][1:]), F.col("nx") * F.col("nx")))
    for s, names in SETS.items():
        for x in names:
            out.append((F.when(size > LEAST_WEIGHT * LEAST_WEIGHT, F.col(x) / size) if s == "normal" else F.col(x) / F.col(f"w_{s}")).alias(x))
    return out


def merge_tiles(tree: DataFrame, triangles: DataFrame, root: DataFrame, loose: float, share: float = 1 / 64) -> DataFrame:
    """(path, material, a, b, c): the triangles of every tile, a row each.

    triangles: path (of their leaf), material and three corners: structs of x, y, z and
    ``ATTRIBUTES``, any of which may be null.  Leaves keep their own triangles, but those
    with repeated corners.  A parent has those of its children with corners moved to the
    place of their cell (``share`` of the root's largest side, halved as tiles are); those
    that collapse go, and of those of a material with the same cells one is left.  Places
    are one for all materials, so borders between them stay closed; attributes are means
    of their own material.
    """
    levels = grid_levels(loose)
    raw = triangles.select("path", "material", *[F.col(c) for c in "abc"])
    xyz = [F.struct(*[F.col(c)[x] for x in AXES]) for c in "abc"]
    own = raw.filter((xyz[0] != xyz[1]) & (xyz[1] != xyz[2]) & (xyz[0] != xyz[2]))
    t = written(_prepared(own, root, share, levels), "corners")
    inner = tree.filter(~F.col("is_leaf")).select("path")

    ends = [F.col(f"c{c}")[x] for c in "abc" for x in AXES]
    void = sum((v.isNull().cast("int") for v in ends[1:]), ends[0].isNull().cast("int"))
    far, voids = t.agg(F.max(F.greatest(*map(F.abs, ends))), F.max(void)).first()
    packed = not voids and (far or 0) < (1 << _BITS - 1) - 2

    def halved(cells: list[Column], by: Column) -> list[Column]:
        return [F.floor(v / by).cast("long") for v in cells]

    by = ("path", "depth", "material")
    keyed = t.select(*by, *[_key([F.col(f"c{c}")[x] for x in AXES], packed).alias(c) for c in "abc"])
    clusters = _upwards(
        written(_merged_cells(keyed, by), "clusters"),
        list("abc"),
        lambda times: [_key(halved(_cells(F.col(c), packed), times), packed).alias(c) for c in "abc"],
        lambda rows: _merged_cells(rows, by),
        levels,
    ).join(inner, "path", "left_semi")
    up = _upwards(written(_leaf_sums(t), "cells"), list(AXES), lambda times: [v.alias(x) for x, v in zip(AXES, halved([F.col(x) for x in AXES], times), strict=True)], _added, levels)
    sums = up.join(inner, "path", "left_semi")

    corner = sums.select("path", "material", *AXES, *_attributes()).join(_places(sums, root, share, levels), ["path", *AXES])
    cell = _key([F.col(x) for x in AXES], packed).alias("cell")
    table = written(corner.select("path", "material", cell, F.struct(*[F.col("place")[x].alias(x) for x in AXES], *ATTRIBUTES).alias("corner")), "places")
    merged = clusters.select("path", "material", *[F.col(c).alias(f"c{c}") for c in "abc"])
    for c in "abc":
        side = table.select(F.col("path").alias("_path"), F.col("material").alias("_material"), F.col("cell").alias(f"c{c}_"), F.col("corner").alias(c))
        merged = merged.join(side, (F.col("path") == F.col("_path")) & F.col("material").eqNullSafe(F.col("_material")) & (F.col(f"c{c}") == F.col(f"c{c}_"))).drop("_path", "_material", f"c{c}", f"c{c}_")
    return own.unionByName(merged.select("path", "material", "a", "b", "c"))


def _numbered(t: pa.Table) -> pa.RecordBatch:
    """Whole primitives, one after the other, of rows path, part, _p (twelve numbers of three
    corners) and _void (a bit for each that is null): a row each.  Corners equal in all are
    numbered once, in the order of their numbers."""
    n = len(AXES) + len(ATTRIBUTES)
    starts = _starts(t)
    own = np.repeat(np.cumsum(starts) - 1, 3)
    at = np.add(t.column("_p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n), np.float32(0))  # no -0
    at[np.isnan(at)] = np.nan
    void = (t.column("_void").to_numpy()[:, None] >> np.arange(3 * n) & 1).reshape(-1, n).astype(bool)
    at[void] = -np.inf  # nulls come first
    keys = [k for c in range(n - 1, -1, -1) for k in ((at[:, c], ~void[:, c]) if void[:, c].any() else (at[:, c],))]
    order = np.lexsort([*keys, own])
    at, void, own = at[order], void[order], own[order]
    new = np.ones(len(at), bool)
    new[1:] = (at.view(np.uint32)[1:] != at.view(np.uint32)[:-1]).any(axis=1) | (void[1:] != void[:-1]).any(axis=1) | (own[1:] != own[:-1])
    at, void, first = at[new], void[new], np.flatnonzero(np.diff(own[new], prepend=-1))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1 - first[own]
    ends = np.append(first, len(at))
    names = [*AXES, *ATTRIBUTES]

    def lists(wanted: tuple[str, ...], whole: bool) -> pa.Array:
        c = [names.index(x) for x in wanted]
        values = pa.array(at[:, c].ravel(), pa.float32(), mask=void[:, c].ravel())
        lacks = np.logical_or.reduceat(void[:, c[0]], first) if whole else np.zeros(len(first), bool)
        return pa.ListArray.from_arrays(pa.array(ends * len(c), pa.int32()), values, mask=pa.array(lacks))

    rows = np.flatnonzero(starts)
    part = t.column("part").to_numpy()[rows]
    indices = pa.ListArray.from_arrays(pa.array(np.append(rows, t.num_rows) * 3, pa.int32()), pa.array(number, pa.int32()))
    path = t.column("path").combine_chunks().take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [path, pa.array(part, pa.int32()), pa.array(part, pa.int32(), mask=part == -1), lists(tuple(AXES), False), *[lists(SETS[x], True) for x in ("normal", "texcoord", "color")], indices],
        ["path", "part", "material", "positions", "normals", "texcoords", "colors", "indices"],
    )


def _starts(t: pa.Table) -> np.ndarray:
    """Where a primitive begins in sorted rows."""
    path = t.column("path").combine_chunks().dictionary_encode().indices.to_numpy()
    part = t.column("part").to_numpy()
    return np.concatenate([[True], (path[1:] != path[:-1]) | (part[1:] != part[:-1])])


def _primitives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many small primitives at a time, or one that is larger."""
    held, n, enough = [], 0, ROWS
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= enough:
            t = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_starts(t))[-1])  # may go on
            if last:
                yield _numbered(t.slice(0, last))
            held, n = t.slice(last).to_batches(), t.num_rows - last
            enough = max(ROWS, 2 * n)
    if n:
        yield _numbered(pa.Table.from_batches(held))


def parts(content: DataFrame) -> DataFrame:
    """(path, part, material, positions, normals, texcoords, colors, indices): a primitive
    per tile and material for ``glb.write_meshes``; corners equal in all are one vertex,
    and an attribute that some corner lacks is null.  Rows of a primitive meet once, as
    plain numbers, where they become one row."""
    values = [F.col(c)[x].cast("float") for c in "abc" for x in (*AXES, *ATTRIBUTES)]
    void = sum((F.shiftleft(v.isNull().cast("long"), i) for i, v in enumerate(values)), F.lit(0).cast("long"))
    each = content.select("path", F.coalesce("material", F.lit(-1)).cast("int").alias("part"), F.array(*[F.coalesce(v, F.lit(0.0).cast("float")) for v in values]).alias("_p"), void.alias("_void"))
    met = each.repartition("path", "part").sortWithinPartitions("path", "part")
    numbers = "array<float>"
    return met.mapInArrow(_primitives, f"path string, part int, material int, positions {numbers}, normals {numbers}, texcoords {numbers}, colors {numbers}, indices array<int>")
