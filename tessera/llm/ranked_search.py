"""Ranked lexical search: the k documents of highest score for each item, exactly.

A document is an impact vector over the terms that the items hold, an item a vector
of term weights; the score is their inner product.  Both sides carry the root of a
term's weight, so that lengths are small where only common terms are shared.
Documents are dealt into buckets by their vectors' length, longest first.  An item
skips a bucket whose longest vector times its own length (Cauchy-Schwarz) cannot
reach the k-th best score that it has so far.  Inside a bucket it reads its heaviest
coordinates first; what they leave open is bounded by the lengths of the rests, and
only documents whose bound reaches the score are rescored, over all coordinates and
in whole numbers.  Buckets come in rounds, so that scores of the first raise the bar
of the rest.  Nothing is cut off but by proof.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Words, chunks, documents, flat, names, table

#: Documents of a bucket; lengths within a step count as one.
BUCKET, STEP = 4096, 1.05

#: Terms of the items that one pass over the documents looks for (16 bytes each are sent to the tasks).
TERMS = 4_000_000

#: Shares of the documents after which a round ends.
ROUNDS = (1 / 16, 1 / 4, 1.0)

#: Bounds are floats: this much is added to them.
SLACK = 1 + 1e-9

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased."""
    upper = (data >= 0x41) & (data <= 0x5A)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~inside))
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _arrays(column: pa.Array | pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype), sizes


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, a, b, uses): an item's distinct terms by two names, and how often it uses them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = terms(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(w.doc, pa.int64())), pa.array(w.names().view(np.int64)), pa.array(w.names(7).view(np.int64))],
                names=["item_id", "a", "b"],
            )

    found = items.select("item_id", "text").mapInArrow(run, "item_id long, a long, b long")
    return found.groupBy("item_id", "a", "b").agg(F.count("*").alias("uses"))


class Vocabulary:
    """Numbers of the terms that items use, found by two independent 64-bit names."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        self.a, self.b = a[order], b[order]

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 for other terms."""
        if not len(self.a):
            return np.full(len(a), -1, np.int64)
        out = np.full(len(a), -1, np.int64)
        at, open_ = np.searchsorted(self.a, a), np.arange(len(a))
        while len(open_):  # terms that share their first name stand next to each other
            open_ = open_[at[open_] < len(self.a)]
            open_ = open_[self.a[at[open_]] == a[open_]]
            hit = self.b[at[open_]] == b[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return out


def _forward(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with at least one term: all its terms' number,
    and the distinct ones that the vocabulary holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for part, data, bounds in chunks(batch):
                w = terms(data, bounds)
                n = np.diff(w.first)
                number = known.numbers(w.names().view(np.int64), w.names(7).view(np.int64))
                mine = number >= 0
                size = max(1, len(known.a))
                code, tf = np.unique(w.doc[mine] * size + number[mine], return_counts=True)
                held = np.bincount(code // size, minlength=len(n))
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), _lists(code % size, held, pa.int32()), _lists(tf, held, pa.int32())],
                    names=["doc_id", "n", "terms", "tf"],
                )
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _vectors(forward: DataFrame, weights, many: int, long_: int) -> DataFrame:
    """(doc_id, terms, impacts, length, level): impact vectors, without terms of no weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            t, size = _arrays(batch.column("terms"), np.int64)
            tf, _ = _arrays(batch.column("tf"), np.int64)
            own = np.repeat(np.arange(len(n)), size)
            m = 100 - 75 + (75 * n * many) // long_
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[own])
            use = (w[t] > 0) & (impact > 0)
            t, impact, own = t[use], impact[use], own[use]
            length = np.sqrt(np.bincount(own, impact.astype(float) ** 2 * w[t], len(n))) * SLACK
            held = np.bincount(own, minlength=len(n))
            level = np.floor(np.log(np.maximum(length, 1e-9)) / math.log(STEP)).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(t, held, pa.int32()), _lists(impact, held, pa.int32()), pa.array(length), pa.array(level)],
                names=["doc_id", "terms", "impacts", "length", "level"],
            )
            yield out.filter(pa.array(held > 0))

    return forward.mapInArrow(run, "doc_id long, terms array<int>, impacts array<int>, length double, level long")


def _buckets(levels: list[tuple[int, int]]) -> list[tuple[int, int, float, int, int]]:
    """(bucket, level, its longest vector, parts, documents up to here), longest first: small levels
    next to each other share a bucket, large ones are dealt into parts."""
    out, bucket, held, top, total = [], -1, 0, 0.0, 0
    for level, n in sorted(levels, reverse=True):
        if bucket < 0 or held + n > BUCKET:
            bucket, held, top = bucket + 1, 0, STEP ** (level + 1) * SLACK
        held, total = held + n, total + n
        out.append((bucket, level, top, -(-n // BUCKET), total))
    return out


class Postings:
    """The impact vectors of one bucket, by coordinate."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, t: np.ndarray, impact: np.ndarray, length: np.ndarray):
        order = np.argsort(t, kind="stable")
        self.ids, self.length = ids, length
        self.t, self.doc, self.impact = t[order], np.repeat(np.arange(len(ids)), sizes)[order], impact[order]

    def search(self, t: np.ndarray, uses: np.ndarray, w: np.ndarray, bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the k best with a score of ``bar`` and more."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.t, t), np.searchsorted(self.t, t, side="right")
        there = hi > lo
        t, uses, w, lo, hi = t[there], uses[there], w[there], lo[there], hi[there]
        if not len(t):
            return nothing
        share = uses.astype(float) ** 2 * w
        order = np.argsort(-w * uses, kind="stable")
        lo, hi, uses, w, share = lo[order], hi[order], uses[order], w[order], share[order]
        rest = share.sum() - np.cumsum(share)
        # the focus: the coordinates that hold three quarters of the item's length
        focus = int(np.searchsorted(-rest, -0.25 * share.sum())) + 1
        partial, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for i in range(min(focus, len(lo))):
            d, p = self.doc[lo[i] : hi[i]], self.impact[lo[i] : hi[i]]
            partial[d] += p * (w[i] * uses[i])
            seen[d] += p.astype(float) ** 2 * w[i]
        if focus < len(lo):
            open_ = math.sqrt(max(0.0, float(rest[focus - 1]))) * np.sqrt(np.maximum(0.0, self.length**2 * SLACK - seen)) * SLACK
            alive = (partial + open_ >= bar) & (self.length * (math.sqrt(share.sum()) * SLACK) >= bar)
            for i in range(focus, len(lo)):  # survivors exactly
                d = self.doc[lo[i] : hi[i]]
                use = alive[d]
                partial[d[use]] += self.impact[lo[i] : hi[i]][use] * (w[i] * uses[i])
        else:
            alive = np.ones(len(partial), bool)
        rows = np.flatnonzero(alive & (partial >= max(1, bar)))
        if len(rows) > k:  # ties with the k-th stay until ids decide
            least = np.partition(partial[rows], -k)[-k]
            rows = rows[partial[rows] >= least]
        best = rows[np.lexsort((self.ids[rows], -partial[rows]))[:k]]
        return partial[best], best


def _round(vectors: DataFrame, asked: DataFrame, cells: list, k: int) -> DataFrame:
    """(item, score, doc_id): up to k of each item from each cell whose bound reaches its bar.

    cells: (bucket, longest vector, parts)."""

    def cell(v: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids = v.column("doc_id")
        missing = np.array(ids.is_null())
        if v.num_rows and q.num_rows:
            t, sizes = _arrays(v.column("terms"), np.int64)
            impact, _ = _arrays(v.column("impacts"), np.int64)
            # null ids come last among equal scores
            known = np.where(missing, np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
            index = Postings(known, sizes, t, impact, v.column("length").to_numpy())
            for row in q.select(["item", "bar", "terms", "uses", "weights"]).to_pylist():
                score, at = index.search(*(np.array(row[c], np.int64) for c in ("terms", "uses", "weights")), row["bar"], k)
                out.append((np.full(len(at), row["item"], np.int64), score, at))
        item, score, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"item": pa.array(item, pa.int64()), "score": pa.array(score, pa.int64()), "doc_id": ids.take(pa.array(at, pa.int64()))})

    spark = vectors.sparkSession
    bounds = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(top).alias("top"), F.lit(parts).alias("parts")) for b, top, parts in cells])
    open_ = F.filter(bounds, lambda c: F.col("length") * c["top"] >= F.col("bar"))
    met = asked.select("*", F.explode(open_).alias("c")).select("*", F.col("c.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)).alias("part")).drop("c", "length")
    many = spark.createDataFrame([(b, parts) for b, _, parts in cells], "bucket int, parts int")
    dealt = vectors.join(F.broadcast(many), "bucket").withColumn("part", F.pmod("row", F.col("parts")).cast("int"))  # one row a bucket
    return dealt.groupBy("bucket", "part").cogroup(met.groupBy("bucket", "part")).applyInArrow(cell, "item long, score long, doc_id long")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0.

    docs: doc_id, text; items: item_id, text.  Equal scores go by ascending doc_id (null
    last).  Null texts hold no term.  Of items that repeat an id the smallest text
    counts; a null item_id is an id like any other.  Rows that repeat a doc_id are
    documents each.  Further columns do not matter; empty tables give no rows.
    """
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = table(spark, _item_terms(texts.groupBy("item_id").agg(F.min("text").alias("text"))), "item_terms")
    used = held.groupBy("a", "b").agg(F.count("*")).count()
    blocks = max(1, -(-used // TERMS))
    out = None
    for block in range(blocks):
        mine = held.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else held
        part = _search_block(spark, documents(docs), mine, k)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(spark: SparkSession, docs: DataFrame, held: DataFrame, k: int) -> DataFrame:
    named = held.select("a", "b").distinct().toArrow()  # at most about TERMS rows
    known = Vocabulary(np.array(named.column("a"), np.int64), np.array(named.column("b"), np.int64))
    forward = table(spark, _forward(docs, spark.sparkContext.broadcast(known)), "forward")
    many, long_ = forward.agg(F.count("*"), F.sum("n")).first()
    counted = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # at most about TERMS rows
    w = np.zeros(max(1, len(known.a)), np.int64)
    df = np.array(counted.column("df"), np.int64)
    w[np.array(counted.column("t"), np.int64)] = np.floor(1000 * np.log((2.0 * many + 2) / (2.0 * df + 1))).astype(np.int64)
    vectors = table(spark, _vectors(forward, spark.sparkContext.broadcast(w), many, long_ or 1), "vectors")
    levels = _buckets([(r["level"], r["n"]) for r in vectors.groupBy("level").agg(F.count("*").alias("n")).collect()])  # a few hundred levels

    numbers = known.numbers(*(np.array(named.column(c), np.int64) for c in ("a", "b")))
    weighed = pa.table({"a": named.column("a"), "b": named.column("b"), "t": pa.array(numbers, pa.int32()), "w": pa.array(w[numbers] if len(numbers) else [], pa.int64())})
    looked_up = held.join(spark.createDataFrame(weighed), ["a", "b"]).filter("w > 0")
    sums = F.sqrt(F.sum(F.col("uses") * F.col("uses") * F.col("w").cast("double"))) * SLACK
    each = looked_up.groupBy("item_id").agg(F.collect_list(F.struct("t", "uses", "w")).alias("x"), sums.alias("length"))
    # items by a number, which has no null
    asked = table(spark, each.select("item_id", F.monotonically_increasing_id().alias("item"), "length", F.col("x.t").alias("terms"), F.col("x.uses").alias("uses"), F.col("x.w").alias("weights")), "asked")

    best = None
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    if levels:
        by_level = spark.createDataFrame([(level, b) for b, level, *_ in levels], "level long, bucket int")
        numbered = vectors.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(by_level), "level").drop("level")  # a few hundred rows
        ends = [0.0, *ROUNDS]
        total = levels[-1][-1]
        for lo, hi in zip(ends, ends[1:], strict=False):
            cells: dict[int, list] = {}
            for b, _, top, parts, upto in levels:
                at = cells.setdefault(b, [top, 0, upto])
                at[1], at[2] = max(at[1], parts), upto
            cells_now = [(b, top, parts) for b, (top, parts, upto) in cells.items() if lo * total < upto <= hi * total]
            if not cells_now:
                continue
            bar = F.lit(0).cast("long").alias("bar")
            now = asked.drop("item_id")
            if best is not None:
                bars = best.filter(F.col("rank") == k).select("item", F.col("score").alias("bar"))
                now = now.join(bars, "item", "left").withColumn("bar", F.coalesce("bar", F.lit(0).cast("long")))
            else:
                now = now.select("*", bar)
            found = _round(numbered, now, cells_now, k)
            if best is not None:
                found = found.unionByName(best.select("item", "score", "doc_id"))
            best = table(spark, found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), "best")
    if best is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
