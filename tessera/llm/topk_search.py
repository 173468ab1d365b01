"""Exact top-k inner-product search over an impact-ordered index.

Vectors are dealt into shards.  A shard's index holds, for each dimension, its
vectors in segments of equal quantised impact (value), i.e. postings cut into
``LEVELS`` levels.  A query scores a shard segment by segment in descending
order of the segments' quantised impact on that query, weight times value; each
posting adds the segment's middle.  What has not been seen is bounded on both
sides, dimension by dimension; scoring stops only when the bounds prove that no
vector outside a short list can be among the best k.  The list's members are
then rescored exactly in whole numbers.  If the proof never comes, all segments
are read, and the list is what the bounds still allow.

Queries are dealt in blocks; each block meets each shard once and sends on at
most k rows per query, from which the k best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of a shard, queries of a block, and levels of a dimension.
SHARD, BLOCK, LEVELS = 8192, 1024, 16
#: A short list this long is rescored rather than proved further.
SHORT = 64


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as long, vectors that are null,
    or hold a null or non-finite component, left out."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(x.isNotNull() & finite, whole).alias("v")).filter("v is not null and vec_id is not null")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length: shorter vectors end in zeros."""
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Index:
    """The impact-ordered segments of one shard."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, levels: int = LEVELS):
        self.ids, self.v = ids, v
        n, d = v.shape
        low, high = v.min(0), v.max(0)
        step = np.maximum(1, -(-(high - low + 1) // levels))
        level = (v - low) // step
        code = level + np.arange(d) * levels
        order = np.argsort(code.T.ravel(), kind="stable")  # by dimension, then level
        self.member = np.tile(np.arange(n), d)[order]
        size = np.bincount(code.ravel(), minlength=d * levels)
        there = np.flatnonzero(size)
        self.size, self.dim = size[there], there // levels
        self.at = np.cumsum(self.size) - self.size
        self.low = low[self.dim] + (there % levels) * step[self.dim]
        self.high = np.minimum(self.low + step[self.dim] - 1, high[self.dim])

    def search(self, q: np.ndarray, k: int, skip: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id), without vectors whose id is ``skip``."""
        d = self.v.shape[1]
        w = q[self.dim]
        least, most = np.minimum(w * self.low, w * self.high), np.maximum(w * self.low, w * self.high)
        order = np.argsort(-most, kind="stable")
        middle, half = (least + most) / 2, (most - least) / 2
        total = int(self.size.sum())
        acc, err = np.zeros(len(self.ids)), np.zeros(d)
        others = self.ids != skip
        want = min(k, int(others.sum()))
        if not want:
            return []
        done, seen = 0, 0
        cuts = np.searchsorted(np.cumsum(self.size[order]), [total // 2, total * 3 // 4, total * 7 // 8, total], side="left") + 1
        short = np.flatnonzero(others)
        for stop in np.minimum(cuts, len(order)):
            part = order[done:stop]
            if not len(part):
                continue
            size = self.size[part]
            ends = np.cumsum(size)
            rows = self.member[np.arange(ends[-1]) + np.repeat(self.at[part] - (ends - size), size)]
            acc += np.bincount(rows, np.repeat(middle[part], size), len(acc))
            np.maximum.at(err, self.dim[part], half[part])
            done, seen = stop, seen + int(ends[-1])
            rest = order[done:]
            # a posting is met once in each dimension: what is unseen adds between these
            up, down = np.zeros(d), np.zeros(d)
            np.maximum.at(up, self.dim[rest], most[rest])
            np.minimum.at(down, self.dim[rest], least[rest])
            best = np.partition((acc - err.sum() + down.sum())[others], -want)[-want]
            short = np.flatnonzero(others & (acc + err.sum() + up.sum() >= best))
            if len(short) <= SHORT:
                break
        score = self.v[short] @ q
        best = np.lexsort((self.ids[short], -score))[:k]
        return list(zip(score[best].tolist(), self.ids[short][best].tolist(), strict=True))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best vectors of each query by inner product, exactly.

    vectors, queries: as ``usable`` returns them.  Vectors with the query's own
    id are no candidates.  Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller vec_id.  Rows that repeat an id count each on their own;
    repeated queries are answered once.  Vectors of different lengths count as
    ending in zeros.  Further columns do not matter, whatever their names.  Empty inputs
    give an empty result.
    """
    shards = max(1, -(-vectors.count() // SHARD))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    row = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    dealt = vectors.select("vec_id", "v", (row % shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"))
    met = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), (row % blocks).cast("int").alias("block"), F.lit(True).alias("asks"))

    def cell(t: pa.Table) -> pa.Table:
        asks, ids = np.array(t.column("asks")), np.array(t.column("vec_id"))
        out: list[tuple[int, int, int]] = []
        if asks.any() and not asks.all():
            v = _matrix(t.column("v"))
            index = Index(ids[~asks], v[~asks])
            for q, x in zip(ids[asks].tolist(), v[asks], strict=True):
                out += [(q, s, i) for s, i in index.search(x, k, q)]
        q, s, i = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "score": pa.array(s, pa.int64()), "vec_id": pa.array(i, pa.int64())})

    part = dealt.unionByName(met).groupBy("shard", "block").applyInArrow(cell, "query_id long, score long, vec_id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
