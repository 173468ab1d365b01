"""Near copies: SimHash candidates from anchors, verified by word shingles.

Documents are near copies if their sets of 5-word shingles have a Jaccard
similarity of at least 0.8.  Such texts differ in about a seventh of the bits of a
SimHash, far more than a single covering radius can bridge, so the covering is
repeated: a 256-bit fingerprint is read in ``BANDS`` bands of 22 bits, and on each
band the anchors are the words of a perfect covering code, a [15, 11] Hamming
code with seven free bits.  The threshold of a band is 0, so the anchors within
covering radius plus threshold are one, and a fingerprint is replicated to one
anchor a band.

1. At each anchor every text is linked to a leader: the smallest of the texts
   close to it, for long groups the first leader that covers it.  Of all anchors a
   text keeps its smallest leader only, so links are at most one per text however
   large a group of copies is; they are verified on whole sets of shingles.
2. Texts that met a close one are compared again, on all bits and with what is
   known of their groups; those without a close one in another group drop out.  Of
   the others, pairs that lie in two groups and that their sizes and the parities
   of their shingles don't rule out are verified, each text's closest first,
   sixteen times as many in every round, until no close pair is left that crosses
   two groups.

Texts with equal sets of shingles are one node, so copies cost one row.  Anchors
that more than ``simhash.ANCHOR_ROWS`` rows visit are cut into parts, and each pair
of parts is a group of its own.  Nodes are named by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.common import Words, chunks, documents, free_name, mix, segments, table, words

BANDS, CODE, FREE = 96, 15, 7
#: Texts beyond which each doubling adds a free bit, and bands for the same recall.
SPARSE = 1 << 28
#: Words of a shingle of the fingerprint, and of the sets that are verified.
COARSE, SHINGLE = 3, 5
THRESHOLD = 0.8
#: Bits of a set's parities: a shingle flips one, so sets differ in at least as many
#: shingles as their parities do in bits.
PARITY = 512
#: Rows of an anchor up to which all pairs are looked at side by side.
SMALL, MIDDLE = 32, 512
#: Rows that are grouped at a time.
STEP = 50_000
#: Differing bits, of the first 128 and of all 256, beyond which a pair is not looked
#: at: expected at a similarity of 0.8 are 19 (one in 10,000 such pairs differs in
#: more than 34) and 39, of unlike texts 64 and 128.
FAR, FAR_ALL = 34, 64
_F = ("f0", "f1", "f2", "f3")


def _nearest_code_words() -> np.ndarray:
    """Of each 15-bit word the word of the Hamming code within one bit."""
    x = np.arange(1 << CODE, dtype=np.int64)
    s = np.zeros_like(x)
    for bit in range(CODE):
        s ^= np.where(x >> bit & 1, bit + 1, 0)
    return x ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)


_NEAREST = _nearest_code_words()


def shape(rows: int) -> tuple[int, int]:
    """(bands, free bits) for a table of this many texts."""
    extra = max(0, math.ceil(math.log2(max(rows, 1) / SPARSE)))
    return math.ceil(BANDS * 1.18**extra), FREE + extra


@functools.cache
def _band_bits(bands: int, free: int) -> np.ndarray:
    """The bits of each band; as many bands as 256 bits allow share none."""
    r = np.random.Generator(np.random.PCG64(5))
    width = CODE + free
    each = 256 // width
    rows = [r.permutation(256)[: each * width].reshape(each, width) for _ in range(-(-bands // each))]
    return np.concatenate(rows)[:bands]


def _shingles(w: Words, name: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct shingles, sorted by text, then hash.

    A text with fewer words has its whole sequence as its only shingle."""
    length = np.diff(w.first)
    count = np.where(length > 0, np.maximum(length - n + 1, 1), 0)
    own = np.repeat(np.arange(len(length)), count)
    s = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
    e = np.minimum(s + n, w.first[1:][own])
    h = mix(segments(mix(name, n), s, e) + (e - s).astype(np.uint64))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new]


def _bits(h: np.ndarray, own: np.ndarray, n: int, width: int = 1 << 16) -> np.ndarray:
    """The 256-bit SimHash of each text, as four longs: bits set in over half of its hashes."""
    ones = np.zeros((n, 256), np.int64)
    for lo in range(0, len(h), width):
        x, o = h[lo : lo + width], own[lo : lo + width]
        four = np.stack([x, mix(x, 7), mix(x, 8), mix(x, 9)], axis=1).astype("<u8")
        head = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        ones[o[head]] += np.add.reduceat(np.unpackbits(four.view(np.uint8).reshape(-1, 32), axis=1, bitorder="little"), head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.bincount(own, minlength=n)[:, None], axis=1, bitorder="little").view("<i8")


def _keys(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """A name of each text's set of shingles."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h, 3), out=total[1:])
    size = np.bincount(own, minlength=n)
    end = np.cumsum(size)
    return mix(total[end] - total[end - size] + size.astype(np.uint64), 4).view(np.int64)


def sketches(docs: DataFrame, *more) -> DataFrame:
    """doc_id, key, f0 .. f3 of each whole text: its node and its fingerprint.

    more: further columns, which follow."""
    given = documents(docs, *more)
    rest = given.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in chunks(batch, 1 << 20):
                n = part.num_rows
                w = words(simhash._LOWER[data], bounds)
                name = w.names()
                f = _bits(*_shingles(w, name, COARSE), n)
                key = _keys(*_shingles(w, name, SHINGLE), n)
                columns = [part.column("doc_id"), pa.array(key), *(pa.array(f[:, i].copy()) for i in range(4)), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", *_F, *(x.name for x in rest)])

    kinds = [T.StructField(c, T.LongType()) for c in ("doc_id", "key", *_F)]
    return given.mapInArrow(run, T.StructType([*kinds, *rest]))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key, the set of shingle hashes and its parities of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in chunks(batch, 1 << 20):
                w = words(simhash._LOWER[data], bounds)
                h, own = _shingles(w, w.names(), SHINGLE)
                at = np.append(0, np.cumsum(np.bincount(own, minlength=part.num_rows))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                parity = pa.array([x.tobytes() for x in _parities(h, own, part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_keys(h, own, part.num_rows)), sets, parity], names=["key", "shingles", "parity"])

    return documents(docs).mapInArrow(run, "key long, shingles array<long>, parity binary")


def _parities(h: np.ndarray, own: np.ndarray, n: int, width: int = 1 << 12) -> np.ndarray:
    """Of each text, whether the shingles of each of ``PARITY`` classes are odd in number."""
    out = np.zeros((n, PARITY // 8), np.uint8)
    for lo in range(0, n, width):
        a, b = np.searchsorted(own, (lo, min(lo + width, n)))
        odd = np.bincount((own[a:b] - lo) * PARITY + (h[a:b] % np.uint64(PARITY)).astype(np.int64), minlength=min(width, n - lo) * PARITY) & 1
        out[lo : lo + width] = np.packbits(odd.astype(np.uint8).reshape(-1, PARITY), axis=1)
    return out


def anchors(f: np.ndarray, bands: int = BANDS, free: int = FREE) -> np.ndarray:
    """The anchor of each fingerprint (rows of four longs) on each band: bands x fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(f).astype("<i8").view(np.uint8).reshape(-1, 32), axis=1, bitorder="little").T.astype(np.int64)
    out = np.zeros((bands, len(f)), np.int64)
    for band, places in enumerate(_band_bits(bands, free)):
        code, left = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
        for i, p in enumerate(places[:CODE]):
            code |= bits[p] << i
        for i, p in enumerate(places[CODE:]):
            left |= bits[p] << i
        out[band] = (band << CODE | _NEAREST[code]) << free | left
    return out


def _replicas(nodes: DataFrame, rows: int, bits: tuple[str, ...]) -> DataFrame:
    """Each node (key, f0 .. f3, ...) at each of its anchors: anchor, key, these bits, ..."""
    bands, free = shape(rows)
    rest = nodes.schema.fields[5:]
    kept = ["key", *bits, *(x.name for x in rest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = np.stack([np.array(b.column(c)) for c in _F], axis=1)
                own = [b.column(c) for c in kept]
                for anchor in anchors(f, bands, free):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), *own], names=["anchor", *kept])

    kinds = [T.StructField(c, T.LongType()) for c in ("anchor", "key", *bits)]
    return nodes.mapInArrow(run, T.StructType([*kinds, *rest]))


def _dealt(replicas: DataFrame, crowded: DataFrame, pairs: bool) -> DataFrame:
    """replicas, group by group (anchor, cell) in order of keys: crowded anchors are cut
    into parts, each of which is a cell or, for ``pairs``, each pair of which."""
    own = [c for c in replicas.columns if c != "anchor"]
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("key"), parts)
    each = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.least(mine, k) * parts + F.greatest(mine, k))
    cell = F.explode(each) if pairs else mine
    dealt = replicas.join(crowded, "anchor", "left").select("anchor", cell.alias("cell"), *own, F.col("parts").isNotNull().alias("divided"))
    return dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "key")


def _bits_of(b: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([np.array(b.column(c)).view(np.uint64) for c in names], axis=1)


def _apart(f: np.ndarray, i, j) -> np.ndarray:
    """Differing bits of the fingerprints i and j."""
    return np.bitwise_count(f[i] ^ f[j]).sum(axis=-1, dtype=np.int64)


def leaders(f: np.ndarray, far: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """(row, leader) of one group: rows are covered by the first leader at most ``far``
    away, rows that none covers lead.  A leader of none whose neighbours others
    cover is linked to one of these."""
    open_ = np.ones(len(f), bool)
    row, lead = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(f):
        near = np.flatnonzero(_apart(f, at, slice(None)) <= far)
        open_[at] = False
        near = near[near != at]
        mine = near[open_[near]]
        if len(mine):
            row.append(mine)
            lead.append(np.full(len(mine), at))
            open_[mine] = False
        elif len(near):
            row.append(np.array([at]))
            lead.append(near[:1])
        more = np.flatnonzero(open_[at:])
        at = at + int(more[0]) if len(more) else len(f)
    return np.concatenate(row), np.concatenate(lead)


def _whole_groups(batches: Iterator[pa.RecordBatch], columns) -> Iterator[list[np.ndarray]]:
    """Rows sorted by anchor and cell, some whole groups at a time."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(columns(b))
        count += b.num_rows
        last = held[-1][0][-1], held[-1][1][-1]
        if count >= STEP and last != (held[0][0][0], held[0][1][0]):
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero((rows[0] != last[0]) | (rows[1] != last[1]))[-1]) + 1
            held = [[x[cut:] for x in rows]]
            count = len(held[0][0])
            yield [x[:cut] for x in rows]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, cell and key -> (key, low): nodes that met a close one,
    and a smaller one of these, if there is one.  Of divided anchors all nodes."""
    for anchor, cell, key, divided, f in _whole_groups(batches, lambda b: [*(np.array(b.column(c)) for c in ("anchor", "cell", "key", "divided")), _bits_of(b, _F[:2])]):
        at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])))
        size = np.diff(np.append(at, len(anchor)))
        group = np.repeat(np.arange(len(at)), size)
        low = np.full(len(anchor), -1)  # the row of the smallest close node
        met = divided.copy()
        row = np.flatnonzero((size > 1)[group] & (size <= MIDDLE)[group])
        of = group[row]
        for shift in range(1, int(size[group[row]].max()) if len(row) else 0):
            i = np.flatnonzero(of[shift:] == of[:-shift])
            i = i[_apart(f, row[i], row[i + shift]) <= FAR]
            low[row[i + shift]] = row[i]  # a larger shift finds a smaller one
            met[row[i]] = met[row[i + shift]] = True
        for lo, n in zip(at[size > MIDDLE].tolist(), size[size > MIDDLE].tolist(), strict=True):
            one, lead = leaders(f[lo : lo + n])
            low[lo + one] = lo + lead
            met[lo + one] = met[lo + lead] = True
        found = np.flatnonzero(met)
        least = np.minimum(key[low[found]], key[found])
        own = np.where(low[found] < 0, key[found], least)
        yield pa.RecordBatch.from_arrays([pa.array(key[found]), pa.array(own)], names=["key", "low"])
        # the other end of a link whose leader is the larger one
        turned = found[(low[found] >= 0) & (key[low[found]] > key[found])]
        if len(turned):
            yield pa.RecordBatch.from_arrays([pa.array(key[low[turned]]), pa.array(key[turned])], names=["key", "low"])


def crowded_anchors(spark: SparkSession, nodes: DataFrame, rows: int) -> DataFrame:
    """(anchor, parts) of the anchors that more than ``simhash.ANCHOR_ROWS`` nodes visit."""
    count = _replicas(nodes.select("key", *_F), rows, ()).groupBy("anchor").count()
    parts = F.ceil(F.col("count") / simhash.ANCHOR_ROWS).cast("long").alias("parts")
    return table(spark, count.filter(F.col("count") > simhash.ANCHOR_ROWS).select("anchor", parts), "crowded")


def candidates(nodes: DataFrame, rows: int, crowded: DataFrame) -> DataFrame:
    """(key, low) of the nodes (key, f0 .. f3) that met a close one: low is the
    smallest of their leaders, or the node itself if they are all larger."""
    dealt = _dealt(_replicas(nodes, rows, _F[:2]), crowded, False)
    return dealt.mapInArrow(_groups, "key long, low long").groupBy("key").agg(F.min("low").alias("low"))


def _largest(root: np.ndarray) -> np.ndarray:
    """Which rows are of the commonest root."""
    _, member, count = np.unique(root, return_inverse=True, return_counts=True)
    return member == count.argmax()


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and cell -> keys of nodes with a close one of another root."""
    for anchor, cell, key, root, f in _whole_groups(batches, lambda b: [*(np.array(b.column(c)) for c in ("anchor", "cell", "key", "root")), _bits_of(b, _F)]):
        at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])))
        size = np.diff(np.append(at, len(anchor)))
        group = np.repeat(np.arange(len(at)), size)
        met = np.zeros(len(anchor), bool)
        row = np.flatnonzero((size > 1)[group] & (size <= MIDDLE)[group])
        for shift in range(1, int(size[group[row]].max()) if len(row) else 0):
            i = np.flatnonzero((group[row[shift:]] == group[row[:-shift]]) & (root[row[shift:]] != root[row[:-shift]]))
            i = i[_apart(f, row[i], row[i + shift]) <= FAR_ALL]
            met[row[i]] = met[row[i + shift]] = True
        for lo, n in zip(at[size > MIDDLE].tolist(), size[size > MIDDLE].tolist(), strict=True):
            own = slice(lo, lo + n)
            for i in (lo + np.flatnonzero(~_largest(root[own]))).tolist():
                near = lo + np.flatnonzero((root[own] != root[i]) & (_apart(f, i, own) <= FAR_ALL))
                met[near] = True
                met[i] |= bool(len(near))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[met]))], names=["key"])


def _may_be_alike(size_a, size_b, parity_a, parity_b, threshold: float) -> np.ndarray:
    """False only where sizes or parities prove that two sets are not similar enough."""
    odd = np.bitwise_count(parity_a ^ parity_b).sum(axis=-1, dtype=np.int64)
    fits = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-6
    return fits & (odd <= (1 - threshold) / (1 + threshold) * (size_a + size_b) + 1e-6)


def _crossing(threshold: float, most: int):
    """Rows sorted by anchor and cell -> close pairs of different roots that may be
    alike: each row's ``most`` closest; ``more`` if a row has further ones."""

    def columns(b):
        parity = np.frombuffer(b"".join(b.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        return [*(np.array(b.column(c)) for c in ("anchor", "cell", "key", "root", "size")), parity, _bits_of(b, _F)]

    def batch(u, v, more):
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.full(pair.shape[1], more))], names=["u", "v", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, cell, key, root, size, parity, f in _whole_groups(batches, columns):

            def close(i, j, f=f, root=root, size=size, parity=parity):
                """Which of the pairs are given out, and their distances."""
                gap = _apart(f, i, j)
                at = np.flatnonzero((gap <= FAR_ALL) & (root[i] != root[j]))
                if len(at):
                    a = i if np.isscalar(i) else i[at]
                    at = at[_may_be_alike(size[a], size[j[at]], parity[a], parity[j[at]], threshold)]
                return at, gap[at]

            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])))
            n = np.diff(np.append(first, len(anchor)))
            group = np.repeat(np.arange(len(first)), n)
            few = np.flatnonzero(n[group] <= SMALL)
            for shift in range(1, int(n[n <= SMALL].max()) if len(few) else 0):
                at = np.flatnonzero(group[few[shift:]] == group[few[:-shift]])
                i, j = few[at], few[at + shift]
                k, _ = close(i, j)
                if len(k):
                    yield batch(key[i[k]], key[j[k]], False)
            for lo, hi in zip(first[n > SMALL].tolist(), (first + n)[n > SMALL].tolist(), strict=True):
                every = np.arange(lo, hi)
                u, v, held, more = [], [], 0, False
                # pairs within the largest root are none, so its rows are only partners
                for i in (lo + np.flatnonzero(~_largest(root[lo:hi]))).tolist():
                    k, gap = close(i, every)
                    if len(k) > most:
                        k, more = k[np.argpartition(gap, most)[:most]], True
                    if len(k):
                        u.append(np.full(len(k), key[i]))
                        v.append(key[every[k]])
                        held += len(k)
                    if held > 1 << 20:
                        yield batch(np.concatenate(u), np.concatenate(v), more)
                        u, v, held = [], [], 0
                if held:
                    yield batch(np.concatenate(u), np.concatenate(v), more)

    return run


def crossing(spark: SparkSession, nodes: DataFrame, rows: int, crowded: DataFrame, threshold: float, most: int) -> DataFrame:
    """(u, v, more): close pairs of nodes (key, f0 .. f3, root, size, parity) of different roots."""
    met = _dealt(_replicas(nodes.select("key", *_F, "root"), rows, _F), crowded, True).mapInArrow(_meeting, "key long")
    nodes = nodes.join(table(spark, met.distinct(), "crossing"), "key", "left_semi")
    dealt = _dealt(_replicas(nodes, rows, _F), crowded, True)
    return dealt.mapInArrow(_crossing(threshold, most), "u long, v long, more boolean").groupBy("u", "v").agg(F.max("more").alias("more"))


def joined(spark: SparkSession, nodes: DataFrame, links: DataFrame, sets: DataFrame, rows: int, crowded: DataFrame, threshold: float, most: int = 2) -> DataFrame:
    """(key, root) of the nodes (key, f0 .. f3) that met a close one: components of all
    close pairs that meet at an anchor and are similar enough.

    links: (key, low) of these nodes; sets: their shingles.
    """
    tested = links.filter("key <> low").select(F.least("key", "low").alias("u"), F.greatest("key", "low").alias("v"))
    good = table(spark, verified(tested, sets, threshold), "verified")
    root = table(spark, simhash.components(spark, good).withColumnRenamed("node", "key"), "roots")
    signs = sets.select("key", F.size("shingles").cast("long").alias("size"), "parity")
    open_ = table(spark, nodes.join(signs, "key"), "open")
    while True:
        rooted = open_.join(root, "key", "left").select("key", *_F, F.coalesce("root", "key").alias("root"), "size", "parity")
        rooted = table(spark, rooted, "rooted")
        pairs = table(spark, crossing(spark, rooted, rows, crowded, threshold, most), "pairs")
        new = table(spark, verified(pairs.join(tested, ["u", "v"], "left_anti"), sets, threshold), "verified")
        if not new.isEmpty():
            of_u, of_v = (rooted.select(F.col("key").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
            steps = simhash.components(spark, new.join(of_u, "u").join(of_v, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
            root = rooted.select("key", "root").join(steps.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left").select("key", F.coalesce("to", "root").alias("root"))
            root = table(spark, root, "roots")
        if pairs.filter("more").isEmpty():
            return root
        tested = tested.union(pairs.select("u", "v"))
        most *= 16


def verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The edges (u, v) whose sets of shingles are similar enough."""
    a = sets.select(F.col("key").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("key").alias("v"), F.col("shingles").alias("b"))
    both = edges.select("u", "v").join(a, "u").join(b, "v")
    small, large = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    shared = F.when(small >= threshold * large, F.size(F.array_intersect("a", "b"))).otherwise(0)
    return both.filter(shared >= threshold * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of text hashes, and its name."""
    name = free_name(docs, "text_hash")
    return docs.withColumn(name, F.xxhash64(F.lit(1), "text")), name


def _only(docs: DataFrame, wanted: DataFrame, text_hash: str) -> DataFrame:
    """The docs of these ids and text hashes (id, h)."""
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]) & (docs[text_hash] == wanted["h"]), "left_semi")


def _first(text_hash: str):
    """What orders documents: the id (nulls last), then the text hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(text_hash).alias("h"))


def _grouped(spark: SparkSession, docs: DataFrame, text_hash: str, threshold: float) -> DataFrame:
    """doc_id, the text's hash and ``root``, a node of its component, of each document."""
    made = table(spark, sketches(docs, F.col(text_hash)), "sketches")
    nodes = made.groupBy("key").agg(F.min(_first(text_hash)).alias("k"), *(F.min(f).alias(f) for f in _F))
    nodes = table(spark, nodes.select("key", *_F, "k"), "nodes")
    rows, plain = nodes.count(), nodes.select("key", *_F)
    crowded = crowded_anchors(spark, plain, rows)
    links = table(spark, candidates(plain, rows, crowded), "links")
    wanted = nodes.join(links, "key", "left_semi").select("k.id", "k.h")
    texts = _only(docs.select("doc_id", "text", text_hash), wanted, text_hash)
    sets = table(spark, shingle_sets(texts).dropDuplicates(["key"]), "shingles")
    root = joined(spark, plain, links, sets, rows, crowded, threshold)
    return made.select("doc_id", "key", text_hash).join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_copies(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, component_id, the smallest doc_id of its group.

    Groups are components of pairs whose sets of 5-word shingles (A-Z lower-cased;
    fewer words: the whole sequence) have at least ``threshold`` in common.
    Documents without words (null or blank text) are copies of one another.  A
    null doc_id is grouped like any other and names no group.  Repeated rows stay;
    an empty table gives no rows.
    """
    hashed, text_hash = _hashed(docs)
    made = table(spark, _grouped(spark, hashed, text_hash, threshold), "grouped")
    name = made.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return made.join(name, "root").select("doc_id", "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns, with one row of each group: that of the
    smallest doc_id (nulls last; of rows that share it, the smallest text hash).

    Of equal rows one is left.  Null texts count as empty, and texts without words are
    copies of each other; long texts count whole; an empty table stays empty.
    """
    hashed, text_hash = _hashed(docs)
    made = _grouped(spark, hashed, text_hash, threshold)
    kept = made.groupBy("root").agg(F.min(_first(text_hash)).alias("k")).select("k.id", "k.h")
    out = _only(hashed, table(spark, kept, "kept"), text_hash)
    again = made.groupBy("doc_id", text_hash).count().filter("count > 1").limit(1).count()
    if again:  # rows that repeat both id and text
        out = out.dropDuplicates(["doc_id", text_hash])
    return out.drop(text_hash)
