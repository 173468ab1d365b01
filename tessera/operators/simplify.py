"""Simplification of meshes by edge collapse, cell by cell.

A mesh is cut in space into cells of at most ``CELL`` triangles: triangles are
numbered along a space-filling order, and a cell is a run of numbers.  Cells are
simplified apart; a vertex that two cells share is locked, so cells still fit
together.  Further rounds number what is left and shift the cuts by half a cell, so
that former borders are simplified, too.  A primitive of any size is so dealt to
tasks of one size.  Triangles of the same corners go together as one that counts for
all of them, so repeated triangles neither fill cells nor lie on both sides of a cut.
What borders still hold back goes in rounds without any: of vertices that share no
triangle each takes its own triangles along, until no edge is left that may go.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.ids import dense_ids
from tessera.storage import written

CORNERS = ("a", "b", "c")

#: The most (different) triangles of a cell, and how often cells are cut anew.
CELL, ROUNDS = 16_384, 3

#: How much a change of an attribute counts against a change of place (fixed values).
ATTRIBUTE_WEIGHTS = {"nx": 0.5, "ny": 0.5, "nz": 0.5, "u": 1.0, "v": 1.0, "r": 0.25, "g": 0.25, "b": 0.25, "a": 0.25}


#: How much an open border counts against the planes of its triangles.
BORDER = 10.0


def _products(normal: np.ndarray, through: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The quadrics of planes: ten numbers each."""
    e = np.concatenate([normal, -(normal * through).sum(axis=1)[:, None]], axis=1)
    return np.stack([e[:, i] * e[:, j] for i in range(4) for j in range(i, 4)], axis=1) * weight[:, None]


def _quadrics(x: np.ndarray, t: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex' sum of squared distances to its triangles' planes, by area, and to
    planes that stand on open borders: ten numbers and the area."""
    p = x[t]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    area = np.linalg.norm(n, axis=1)
    n = n / np.where(area > 0, area, 1)[:, None]
    area = area * times
    products = _products(n, p[:, 0], area)
    q, weight = np.zeros((len(x), 10)), np.zeros(len(x))
    for k in range(3):
        np.add.at(q, t[:, k], products)
        np.add.at(weight, t[:, k], area)
    # an edge of one triangle, repeated ones counted once, is a border
    once = np.unique(np.sort(t, axis=1), axis=0, return_index=True)[1]
    ends = np.concatenate([t[once][:, [i, (i + 1) % 3]] for i in range(3)])
    _, first, count = np.unique(np.sort(ends, axis=1), axis=0, return_index=True, return_counts=True)
    border = first[count == 1]
    u, v = ends[border].T
    along = x[v] - x[u]
    up = np.cross(along, n[np.tile(once, 3)[border]])
    size = np.linalg.norm(up, axis=1)
    upright = _products(up / np.where(size > 0, size, 1)[:, None], x[u], (along**2).sum(axis=1) * BORDER)
    for end in (u, v):
        np.add.at(q, end, upright)
    return q, weight


class Collapse:
    """Edges of one piece of a mesh, cheapest first, with live counts of triangles.

    An end of an edge goes into the other one: corners stay original vertices.  The
    cost is the squared distance to the planes that either end has gathered, plus what
    attributes change; locked vertices never move.  A row of t counts as ``times`` triangles.
    """

    def __init__(self, x: np.ndarray, t: np.ndarray, more: np.ndarray | None = None, locked: np.ndarray | None = None, times: np.ndarray | None = None):
        self.scale = float(np.ptp(x, axis=0).max() or 1.0) if len(x) else 1.0
        times = np.ones(len(t), np.int64) if times is None else times
        q, weight = _quadrics(x, t, times)
        self.times = times.tolist()
        self.x, self.q, self.weight = x.tolist(), q.tolist(), weight.tolist()
        self.more = (more * self.scale).tolist() if more is not None and more.shape[1] else None
        self.locked = locked.tolist() if locked is not None else [False] * len(x)
        proper = (t[:, 0] != t[:, 1]) & (t[:, 1] != t[:, 2]) & (t[:, 0] != t[:, 2])
        self.t = {i: list(c) for i, c in enumerate(t.tolist()) if proper[i]}
        self.left = sum(self.times[i] for i in self.t)
        self.of: list[set[int]] = [set() for _ in range(len(x))]
        for i, c in self.t.items():
            for v in c:
                self.of[v].add(i)
        self.version = [0] * len(x)

    def _cost(self, into: int, gone: int) -> float:
        a, b = self.q[into], self.q[gone]
        x, y, z = self.x[into]
        xx, xy, xz, xw, yy, yz, yw, zz, zw, ww = (p + r for p, r in zip(a, b))  # noqa: B905
        plane = xx * x * x + yy * y * y + zz * z * z + 2 * (xy * x * y + xz * x * z + yz * y * z + xw * x + yw * y + zw * z) + ww
        out = max(0.0, plane) / max(self.weight[into] + self.weight[gone], 1e-30)
        if self.more:
            out += sum((p - r) ** 2 for p, r in zip(self.more[into], self.more[gone]))  # noqa: B905
        return out

    def _push(self, heap: list, u: int, v: int) -> None:
        ways = [(self._cost(a, b), a, b) for a, b in ((u, v), (v, u)) if not self.locked[b]]
        if ways:
            cost, a, b = min(ways)
            heapq.heappush(heap, (cost, a, b, self.version[a], self.version[b]))

    def _flips(self, into: int, gone: int, shared: set[int]) -> bool:
        """Whether a triangle that stays would face the other way, or lose its area."""
        for i in self.of[gone]:
            if i not in shared:
                before = _normal(*[self.x[v] for v in self.t[i]])
                after = _normal(*[self.x[into if v == gone else v] for v in self.t[i]])
                if any(before) and sum(p * r for p, r in zip(before, after)) <= 0:  # noqa: B905
                    return True
        return False

    def run(self, target: int, most_error: float, flips: bool = False) -> dict[int, list[int]]:
        """Collapse until ``target`` triangles are left or no edge fits: {row of t: corners}.

        The count never falls below ``target``: an edge that more triangles share than
        may go is passed over.  Edges that turn a triangle over stay or, with ``flips``, wait
        until no other is left.
        """
        limit = (most_error * self.scale) ** 2
        for may_flip in (False, True) if flips else (False,):
            heap: list[tuple[float, int, int, int, int]] = []
            edges = {(min(c[i], c[i - 1]), max(c[i], c[i - 1])) for c in self.t.values() for i in range(3)}
            for u, v in sorted(edges):
                self._push(heap, u, v)
            while heap and self.left > target:
                cost, a, b, va, vb = heapq.heappop(heap)
                if cost > limit:
                    break
                if self.version[a] != va or self.version[b] != vb:
                    continue
                shared = self.of[a] & self.of[b]
                if not shared or self.left - sum(self.times[i] for i in shared) < target or (not may_flip and self._flips(a, b, shared)):
                    continue
                self._collapse(heap, a, b, shared)
            if self.left <= target:
                break
        return self.t

    def _collapse(self, heap: list, a: int, b: int, shared: set[int]) -> None:
        for i in shared:
            self.left -= self.times[i]
            for v in self.t.pop(i):
                self.of[v].discard(i)
        for i in self.of[b]:
            self.t[i] = [a if v == b else v for v in self.t[i]]
            self.of[a].add(i)
        self.of[b] = set()
        self.q[a] = [p + r for p, r in zip(self.q[a], self.q[b])]  # noqa: B905
        self.weight[a] += self.weight[b]
        self.version[a] += 1
        self.version[b] += 1
        for v in {v for i in self.of[a] for v in self.t[i]} - {a}:
            self._push(heap, a, v)


def _normal(p: list[float], q: list[float], r: list[float]) -> tuple[float, float, float]:
    (ax, ay, az), (bx, by, bz) = ([s - o for s, o in zip(c, p)] for c in (q, r))  # noqa: B905
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def collapsed(x: np.ndarray, t: np.ndarray, target: int, most_error: float, more: np.ndarray | None = None, locked: np.ndarray | None = None, flips: bool = False, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of t that stay, their corners)."""
    left = Collapse(x, t, more, locked, times).run(target, most_error, flips)
    rows = sorted(left)
    return np.array(rows, np.int64), np.array([left[i] for i in rows], np.int64).reshape(-1, 3)


def _along(x: Column, low: Column, high: Column) -> Column:
    """0..1023: where x lies between low and high."""
    return F.when(high > low, F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * 1024)))).otherwise(0).cast("long")


def _interleaved(cells: list[Column]) -> Column:
    """Ten bits of each axis by turns: near in space is mostly near in this order."""
    out = F.lit(0).cast("long")
    for bit in range(10):
        for axis, cell in enumerate(cells):
            out = out + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + axis)
    return out


def _cells(t: DataFrame, sizes: DataFrame, shift: int) -> DataFrame:
    """t with ``_cell``: 0 where a primitive fits a cell, else a run of its triangles along ``_code``.
    sizes: prim_id, rows of t (n), and the triangles that they count for (all)."""
    sized = t.join(sizes.select("prim_id", F.col("n").alias("_n"), F.col("all").alias("_all")), "prim_id")
    small = sized.filter(F.col("_n") <= CELL).withColumn("_cell", F.lit(0).cast("long"))
    ranked = dense_ids(sized.filter(F.col("_n") > CELL), ["prim_id", "_code", "tidx"], "_rank")
    first = ranked.groupBy("prim_id").agg(F.min("_rank").alias("_first"))
    large = ranked.join(first, "prim_id").withColumn("_cell", F.floor((F.col("_rank") - F.col("_first") + shift) / CELL).cast("long")).drop("_rank", "_first")
    return small.unionByName(large)


def _one_round(t: DataFrame, vertices: DataFrame, names: list[str], weights: dict[str, float], error: float, flips: bool, free: DataFrame | None = None) -> DataFrame:
    """The triangles after each cell is simplified; t: prim_id, tidx, a, b, c, _times, _0, _1, _2, _code, _n, _all, _target, _cell,
    and _budget: how many a cell may lose (null: its share).  Only the vertices in ``free`` move, without it those of one cell."""
    use = t.select("prim_id", "_cell", F.explode(F.array(*CORNERS)).alias("vidx")).distinct()
    borders = use.groupBy("prim_id", "vidx").agg((F.min("_cell") != F.max("_cell")).alias("_locked"))
    if free is not None:
        moving = free.select(F.col("prim_id").alias("_prim"), F.col("vidx").alias("_free"))
        borders = borders.join(moving, (F.col("prim_id") == F.col("_prim")) & (F.col("vidx") == F.col("_free")), "left").select("prim_id", "vidx", F.col("_free").isNull().alias("_locked"))
    known = vertices.select("prim_id", "vidx", *names).join(borders, ["prim_id", "vidx"])
    # fresh columns, as both sides come from the same table
    v = use.join(known, ["prim_id", "vidx"]).select(*[F.col(c).alias(c) for c in ("prim_id", "_cell", "vidx", *names, "_locked")])

    def run(t: pa.Table, v: pa.Table) -> pa.Table:
        ids = np.array(v.column("vidx"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        corner = np.stack([np.array(t.column(c)) for c in CORNERS], axis=1)
        there = np.zeros(len(corner), bool)
        if len(ids):
            at = np.minimum(np.searchsorted(ids, corner), len(ids) - 1)
            there = (ids[at] == corner).all(axis=1)
        t = t.filter(pa.array(there))
        if not t.num_rows:
            return t.select(kept)
        at = at[there]
        x = np.stack([np.array(v.column(a))[order] for a in g.AXES], axis=1)
        more = np.stack([np.nan_to_num(np.array(v.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)))[order] * w for c, w in weights.items()], axis=1) if weights else None
        locked = np.array(v.column("_locked").to_numpy(zero_copy_only=False), bool)[order]
        n, every, target = (t.column(c)[0].as_py() for c in ("_n", "_all", "_target"))
        times = np.array(t.column("_times"))
        # cells get their share, rounded up, so that all together keep the target
        budget = t.column("_budget")[0].as_py()
        share = int(times.sum()) - budget if budget is not None else target if n <= CELL else -(-int(times.sum()) * target // every)
        rows, left = collapsed(x, at, share, error, more, locked, flips, times)
        out = t.take(pa.array(rows, pa.int64()))
        for i, c in enumerate(CORNERS):
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(ids[left[:, i]], pa.int64()))
        return out.select(kept)

    kept = ["prim_id", "tidx", *CORNERS, "_times", "_0", "_1", "_2", "_code"]
    return t.groupBy("prim_id", "_cell").cogroup(v.groupBy("prim_id", "_cell")).applyInArrow(run, "prim_id long, tidx long, a long, b long, c long, _times long, _0 long, _1 long, _2 long, _code long")


_ALIKE = ["prim_id", "_0", "_1", "_2"]


def _free_vertices(rows: DataFrame, k: int) -> DataFrame:
    """(prim_id, vidx, _least): vertices at an edge that few enough triangles share to go, no
    two of them in one triangle.  rows: triangles of primitives that may lose ``_more``.

    Of the vertices of a triangle the one with the smallest such edge moves, so one at the
    smallest edge of all always does.  Those of over ``CELL`` triangles stand back.
    """
    sides = F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = rows.select("prim_id", "_more", "_times", F.explode(sides).alias("e")).groupBy("prim_id", "e").agg(F.sum("_times").alias("n"), F.first("_more").alias("more")).filter("n <= more")
    least = edges.select("prim_id", "n", F.explode(F.array("e.u", "e.v")).alias("vidx")).groupBy("prim_id", "vidx").agg(F.min("n").alias("_least"))
    corner = rows.select(*_ALIKE, F.explode(F.array(*CORNERS)).alias("vidx"))
    many = corner.groupBy("prim_id", "vidx").agg((F.count("*") > CELL).alias("_many"))
    rank = F.struct("_many", "_least", F.xxhash64("vidx", F.lit(k)).alias("by"), "vidx").alias("_rank")
    ranks = least.join(many, ["prim_id", "vidx"]).select(F.col("prim_id").alias("_prim"), F.col("vidx").alias("_vidx"), rank)
    ranked = written(corner.join(ranks, (F.col("prim_id") == F.col("_prim")) & (F.col("vidx") == F.col("_vidx"))).select(*_ALIKE, "vidx", "_rank"), "ranks")
    first = ranked.groupBy(*_ALIKE).agg(F.min("_rank").alias("_first"))
    near = ranked.join(first, _ALIKE).groupBy("prim_id", "vidx").agg(F.min("_first").alias("_first"), F.first("_rank").alias("_rank"))
    return written(near.filter("_rank = _first").select("prim_id", "vidx", F.col("_rank._least").alias("_least")), "free")


def _without_borders(now: DataFrame, targets: DataFrame, run) -> DataFrame:
    """``now`` after rounds without borders, until each primitive is at its target, none of
    its edges may go by what it still has too many, or a round takes none.

    targets: prim_id, _target of the primitives that were cut.  ``run`` simplifies cells.
    A cell is made of the triangles of free vertices.  It may lose its share of what is too
    much; shares too small for any edge go to the cell of the smallest edge.
    """
    k, before = 0, None
    while True:
        left = now.groupBy("prim_id").agg(F.sum("_times").alias("_all"), F.count("*").alias("_n")).join(targets, "prim_id").withColumn("_more", F.col("_all") - F.col("_target"))
        left = written(left.filter("_more > 0"), "mesh-sizes")
        over = left.agg(F.sum("_more")).first()[0]
        if not over or over == before:
            return now
        rows = now.join(left, "prim_id")
        free = _free_vertices(rows, k)
        if free.isEmpty():
            return now
        corner = rows.select(*_ALIKE, "_times", "_more", F.explode(F.array(*CORNERS)).alias("vidx"))
        taken = written(corner.join(free, ["prim_id", "vidx"]), "taken")
        buckets = taken.groupBy("prim_id").agg(F.ceil(F.count("*") / CELL).alias("_buckets"), F.sum("_times").alias("_taken"))
        piece = taken.join(buckets, "prim_id").withColumn("_cell", F.pmod(F.xxhash64("vidx"), F.col("_buckets")).cast("long"))
        cell = piece.groupBy("prim_id", "_cell").agg(F.min("_least").alias("_least"), F.first("_more").alias("more"), (F.floor(F.first("_more") * (F.sum("_times") / F.first("_taken")) * (1 - 1e-9))).cast("long").alias("_part"))
        cell = cell.withColumn("_part", F.when(F.col("_part") >= F.col("_least"), F.col("_part")).otherwise(0))
        spent = cell.groupBy("prim_id").agg(F.sum("_part").alias("_spent"), F.min(F.struct("_least", "_cell")).alias("_first"))
        rest = F.when(F.col("_cell") == F.col("_first._cell"), F.col("more") - F.col("_spent")).otherwise(0)
        budget = cell.join(spent, "prim_id").select("prim_id", "_cell", (F.col("_part") + rest).alias("_budget"))
        cut = rows.drop("_more").join(piece.select(*_ALIKE, "_cell").join(budget, ["prim_id", "_cell"]), _ALIKE)
        same = now.join(taken.select(*_ALIKE), _ALIKE, "left_anti")
        now = written(same.select(*now.columns).unionByName(run(cut, free)), "simplified")
        k, before = k + 1, over


def simplify(triangles: DataFrame, vertices: DataFrame, ratio: float, error: float = 0.05, weights: dict[str, float] | None = None, flips: bool = False) -> DataFrame:
    """(prim_id, tidx, a, b, c): about ``ratio`` of each primitive's triangles.

    triangles: prim_id, tidx, a, b, c; vertices: prim_id, vidx, x, y, z and the
    attributes in ``weights`` (as of ``ATTRIBUTE_WEIGHTS``) that edges should keep; null
    attributes count as 0.  Of n triangles at least max(1, floor(n * ratio)) stay,
    whatever edges share; more only where an edge's cost exceeds ``error`` (a share of
    the piece's size), where the last edges are shared by more triangles than may go or
    would turn one over, or where both ends have over ``CELL`` triangles.  With ``flips`` triangles may be turned
    over where nothing else is left (for loose triangles, whose sides mean nothing).  Triangles with repeated corners or unknown vertices go.  Those
    that stay keep their tidx, and their corners are vertices from before.
    """
    weights = weights or {}
    box = vertices.groupBy("prim_id").agg(*[f(a).alias(f"_{a}{k}") for a in g.AXES for k, f in ((0, F.min), (1, F.max))])
    proper = (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c"))
    size = triangles.groupBy("prim_id").agg(F.count("*").alias("n"), F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") * F.lit(float(ratio))).cast("long")).alias("target"))
    goals = written(size.select("prim_id", "target", F.ceil(F.col("n") * F.lit(float(ratio))).alias("up")), "mesh-sizes")
    targets = goals.select("prim_id", F.col("target").alias("_target"))
    names = [*g.AXES, *weights]
    ends = F.sort_array(F.array(*CORNERS))
    each = triangles.filter(proper).select("prim_id", "tidx", *CORNERS, *[F.get(ends, F.lit(i)).alias(f"_{i}") for i in range(3)])
    alike = written(each.groupBy("prim_id", "_0", "_1", "_2").agg(F.min("tidx").alias("_first"), F.count("*").alias("_times")), "alike")
    t = alike.select("prim_id", F.col("_first").alias("tidx"), *[F.col(f"_{i}").alias(c) for i, c in enumerate(CORNERS)], "_times", "_0", "_1", "_2")

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("prim_id").agg(F.count("*").alias("n"), F.sum("_times").alias("all"))

    before = written(sizes(t), "mesh-sizes")
    if (before.agg(F.max("n")).first()[0] or 0) <= CELL:
        none = F.lit(0).cast("long")
        cut = t.withColumns({"_code": none, "_cell": none, "_budget": F.lit(None).cast("long")}).join(before.withColumnsRenamed({"n": "_n", "all": "_all"}), "prim_id").join(targets, "prim_id")
        now = _one_round(cut, vertices, names, weights, error, flips)
    else:
        at = vertices.join(box, "prim_id")
        code = at.select(F.col("prim_id").alias("_prim"), F.col("vidx").alias("_vidx"), _interleaved([_along(F.col(a), F.col(f"_{a}0"), F.col(f"_{a}1")) for a in g.AXES]).alias("_code"))
        now = t.join(code, (F.col("prim_id") == F.col("_prim")) & (F.col("a") == F.col("_vidx"))).drop("_prim", "_vidx")
        for k in range(ROUNDS):
            cut = _cells(now, before if k == 0 else sizes(now), CELL // 2 * (k % 2)).join(targets, "prim_id").withColumn("_budget", F.lit(None).cast("long"))
            now = written(_one_round(cut, vertices, names, weights, error, flips), "simplified")
        # surfaces keep their share rounded up, as cells do
        large = goals.select("prim_id", F.greatest("target", F.lit(0) if flips else F.col("up")).alias("_target")).join(before.filter(F.col("n") > CELL).select("prim_id"), "prim_id", "left_semi")
        now = _without_borders(now, large, lambda cut, free: _one_round(cut, vertices, names, weights, error, flips, free))
    # all triangles of the same corners, each in its own order of corners
    moved = now.select("prim_id", "_0", "_1", "_2", *[F.col(c).alias(f"_to_{i}") for i, c in enumerate(CORNERS)])
    new = [F.when(F.col(c) == F.col("_0"), F.col("_to_0")).when(F.col(c) == F.col("_1"), F.col("_to_1")).otherwise(F.col("_to_2")).alias(c) for c in CORNERS]
    return each.join(moved, ["prim_id", "_0", "_1", "_2"]).select("prim_id", "tidx", *new)
