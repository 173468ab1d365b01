"""SimHash near-dedup by anchor-point covering.

Two fingerprints within ``distance`` bits agree within half of that (rounded
down) in one of the two 32-bit halves.  On each half the anchors are the words of
a perfect covering code, a [31, 26] Hamming code with one free bit: every half
has an anchor within radius 1.  A fingerprint is at home at the anchor nearest to
it and visits every anchor within radius 1 + threshold; so of two fingerprints
that link, each finds the other as a visitor at its home.  Homes and visitors are
compared anchor by anchor, on all 64 bits.  No link is lost.

Distinct fingerprints, not documents, are compared, so thousands of exact copies
cost one row.  Of each anchor only the edges of a spanning forest leave the task,
never all pairs.  Anchors that more than ``ANCHOR_ROWS`` rows visit are
divided: homes and visitors are cut into parts, and each pair of parts is a group
of its own.  Components follow from the edges by alternating star contraction,
each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import chunks, documents, flat, free_name, table, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Rows of one anchor beyond which its group is divided.
ANCHOR_ROWS = 20_000

_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *more) -> DataFrame:
    """doc_id and a 64-bit SimHash (as a signed long) of each whole text.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D;
    shingles of ``shingle`` words, repeats included, are joined by one space and
    hashed with XXH64 (seed 42).  Fewer words: the whole sequence is the only
    shingle.  No words (null or blank text): fingerprint zero.  more: further
    columns, which follow.
    """
    given = documents(docs, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for batch in batches:
            for part, data, bounds in chunks(batch):
                w = words(_LOWER[data], bounds)
                # words of a text, joined by one space
                size = w.end - w.start
                joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
                to = np.cumsum(size + 1) - size - 1
                inside = np.zeros(len(w.data) + 1, np.int8)
                inside[w.start] += 1
                inside[w.end] -= 1
                target = np.ones(len(joined), bool)
                target[to + size] = False
                joined[target] = w.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
                raw = joined.tobytes()
                out = np.zeros(len(bounds) - 1, np.uint64)
                for i, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    if hi > lo:
                        k = min(shingle, hi - lo)
                        begin, end = to[lo : hi - k + 1].tolist(), (to[lo + k - 1 : hi] + size[lo + k - 1 : hi]).tolist()
                        out[i] = _fingerprint(np.array([h(raw[a:b], 42) for a, b in zip(begin, end, strict=True)], np.uint64))
                columns = [part.column("doc_id"), pa.array(out.view(np.int64)), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *part.schema.names[2:]])

    doc_id, _, *rest = given.schema.fields
    return given.mapInArrow(run, T.StructType([doc_id, T.StructField("fp", T.LongType()), *rest]))


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the Hamming code on bits 1..31: 0, or the place of the bit to flip."""
    s = np.zeros(len(half), np.uint32)
    for bit in range(1, 32):
        s ^= np.where((half >> np.uint32(bit)) & np.uint32(1), np.uint32(bit), np.uint32(0))
    return s


def _flip(half: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Flip one bit, bit 0 not being part of the code: place 0 flips nothing."""
    return half ^ np.where(place > 0, np.uint32(1) << place, np.uint32(0))


def _visited(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within ``radius`` of each half."""
    rows, found = [], []
    free = [0] if radius < 1 else [0, 1]
    for f in free:
        left = radius - f
        base = half ^ np.uint32(f)
        s = _syndrome(base)
        all_ = np.arange(len(half))
        # flips of n places lead to the code if their places sum (xor) to s
        for n in range(left + 1):
            if n == 0:
                ok = s == 0
                rows.append(all_[ok])
                found.append(base[ok])
            elif n == 1:
                ok = s > 0
                rows.append(all_[ok])
                found.append(_flip(base[ok], s[ok]))
            else:
                for chosen in combinations(range(1, 32), n - 1):
                    x = np.uint32(0)
                    for c in chosen:
                        x ^= np.uint32(c)
                    last = s ^ x
                    ok = last > chosen[-1]
                    flipped = base[ok]
                    for c in chosen:
                        flipped = flipped ^ (np.uint32(1) << np.uint32(c))
                    rows.append(all_[ok])
                    found.append(_flip(flipped, last[ok]))
    return np.concatenate(rows), np.concatenate(found)


def _replicas(distance: int):
    """At home: (anchor, fp, true); visiting: (anchor, fp, false).

    The anchor is a long: which half, then the code word."""
    near = distance // 2  # by pigeonhole, in one of two halves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array(b.column("fp")).view(np.uint64)
            for half in (0, 1):
                x = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                row, anchor = _visited(x, 1 + near)
                anchor = np.concatenate([_flip(x, _syndrome(x)), anchor]).astype(np.int64) | np.int64(half << 32)
                home = np.zeros(len(anchor), bool)
                home[: len(x)] = True
                own = fp[np.concatenate([np.arange(len(x)), row])]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own.view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFFFF)
    return _BITS[(x & low).astype(np.uint16)] + _BITS[((x >> np.uint64(16)) & low).astype(np.uint16)] + _BITS[((x >> np.uint64(32)) & low).astype(np.uint16)] + _BITS[(x >> np.uint64(48)).astype(np.uint16)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the graph with edges a[i] - b[i]: roots are the smallest nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[u], label[v])
        np.minimum.at(low, label[v], label[u])
        low = np.minimum(low, low[label])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _compare(homes: np.ndarray, guests: np.ndarray, distance: int, width: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (larger, smaller) of the links between homes and guests."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    for lo in range(0, len(homes), max(1, width // max(len(guests), 1))):
        h = homes[lo : lo + max(1, width // max(len(guests), 1))]
        for g in range(0, len(guests), width):
            i, j = np.nonzero(_popcount(h[:, None] ^ guests[None, g : g + width]) <= distance)
            x, y = h[i].view(np.int64), guests[g + j].view(np.int64)
            keep = x != y
            found_a.append(x[keep])
            found_b.append(y[keep])
            held += int(keep.sum())
            if held > 4 * width:  # keep a forest, not all pairs
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], 0
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _groups(distance: int):
    """Rows sorted by anchor and cell, homes first -> spanning edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def work(rows):
            anchor, cell, fp, home = rows
            if not home.any() or len(anchor) < 2:
                return None
            edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])) + 1
            at = np.concatenate([[0], edge, [len(anchor)]])
            size, homes = np.diff(at), np.add.reduceat(home.astype(np.int64), at[:-1])
            some = (homes > 0) & (size > homes)
            a, b = [], []
            for s, n, h in zip(at[:-1][some].tolist(), size[some].tolist(), homes[some].tolist(), strict=True):
                if h == 1 and n == 2:
                    if fp[s] == fp[s + 1]:
                        continue
                x, y = _compare(fp[s : s + h].view(np.uint64), fp[s + h : s + n].view(np.uint64), distance)
                if len(x):
                    a.append(x)
                    b.append(y)
            if not a:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["u", "v"])

        def whole():
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.array(batch.column(c)) for c in ("anchor", "cell", "fp", "home")))
            last = held[-1]
            first_of_last = (held[0][0][0], held[0][1][0])
            if (last[0][-1], last[1][-1]) != first_of_last:
                rows = whole()
                cut = int(np.flatnonzero((rows[0] != last[0][-1]) | (rows[1] != last[1][-1]))[-1]) + 1
                done = work(tuple(x[:cut] for x in rows))
                held = [tuple(x[cut:] for x in rows)]
                if done is not None:
                    yield done
        if held:
            done = work(whole())
            if done is not None:
                yield done

    return run


def links(spark: SparkSession, fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (u, v) of a spanning forest per anchor over distinct ``fp`` longs."""
    limit = 2 * (1 + distance // 2)
    if limit > 8:
        raise ValueError("at this distance too many anchors would be visited")
    plain = fps.mapInArrow(_replicas(distance), "anchor long, fp long, home boolean")
    parts = F.ceil(F.col("count") / ANCHOR_ROWS).cast("long").alias("parts")
    crowded = table(spark, plain.groupBy("anchor").count().filter(F.col("count") > ANCHOR_ROWS).select("anchor", parts), "crowded")
    n = F.coalesce("parts", F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("fp"), n)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.when(F.col("home"), mine * n + k).otherwise(k * n + mine))
    dealt = plain.join(crowded, "anchor", "left").select("anchor", F.explode(cells).alias("cell"), "fp", "home")
    dealt = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"))
    return dealt.mapInArrow(_groups(distance), "u long, v long").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): connected components, root being the smallest node.

    Alternating large-star and small-star steps; every round is written to the
    shared folder, and each star hangs on the smallest neighbour, found with a
    map-side aggregate.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        hung = both.join(low, "u")
        if large:
            out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    e = table(spark, edges.filter("u <> v"), "edges")
    before = None
    while True:
        e = table(spark, star(star(e, True), False), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """A row per document: doc_id, fp, component_id.

    component_id is the smallest doc_id that links of at most ``distance`` bits
    lead to, the document itself included.  Documents without words share
    fingerprint zero.  A null doc_id links like any other and never names a
    component unless it has no other member.  Repeated rows stay.
    """
    return _grouped(spark, table(spark, fingerprints(docs, shingle), "fingerprints"), distance).select("doc_id", "fp", "component_id")


def _grouped(spark: SparkSession, made: DataFrame, distance: int) -> DataFrame:
    """made (doc_id, fp, ...) with component_id and root, a fingerprint of the component."""
    least = table(spark, made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(spark, links(spark, least.select("fp"), distance))
    placed = least.join(root, least.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    name = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(name, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return made.join(named, made.fp == named["_fp"]).drop("_fp")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """docs, with all their columns, with one row of each component: that of the
    smallest doc_id (nulls last; of rows that share it, the smallest text hash).

    Of equal rows one is left.  Null texts count as empty, with fingerprint zero; long
    texts count whole; an empty table stays empty.
    """
    name = free_name(docs, "text_hash")
    hashed = docs.withColumn(name, F.xxhash64(F.lit(1), "text"))
    made = table(spark, fingerprints(hashed, shingle, F.col(name)), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(name).alias("h"))
    kept = _grouped(spark, made, distance).groupBy("root").agg(F.min(first).alias("k"), F.count("*").alias("n")).select("k.id", "k.h")
    kept = table(spark, kept, "kept")
    out = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["id"]) & (hashed[name] == kept["h"]), "left_semi")
    again = made.groupBy("doc_id", name).count().filter("count > 1").limit(1).count()
    if again:  # rows that repeat both id and text
        out = out.dropDuplicates(["doc_id", name])
    return out.drop(name)
