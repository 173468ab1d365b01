"""Substring dedup by recompression.

Texts are rewritten round by round: equal neighbours (runs) and then
neighbouring pairs get one name.  Names are 64-bit fingerprints of what they
stand for, so they are global without a table of names and without a shuffle
per round, and equal substrings get the same symbols except within a bounded
distance of their ends (symbols longer than a round's limit rest, which bounds
that distance to ``reach`` words).  How many rounds the gap between two words
survives is thus a function of ``2 * reach`` words around it.

Each window of ``window`` words is represented by the gap, among those whose
surroundings lie inside the window, that survives longest (ties: smallest name
of the symbols around it).  Equal windows choose the same gap with the same
name, so a window can only repeat in another document if its name is shared:

1. the names, about 0.3 per word, are dealt out by value and those that more
   than one document holds are revealed;
2. only windows with a revealed name are fingerprinted (128 bits) and dealt
   out, which verifies them and finds the smallest document of each;
3. each bucket of documents marks its words.

Buckets send each name once however many of their documents hold it, so a
passage that a third of all documents share makes one row per bucket and not
one per document.  All exchanges carry packed arrays.  The result of a bucket
depends on its documents alone, not on their order, so lost tasks can be rerun.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, bucket_count, documents, flat, mix, segments, words

_BASE_A, _BASE_B = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
BIG = np.iinfo(np.int64).max


def _round(name, size, doc, survived, at, level, limit, pairs):
    """One round: name runs of equal symbols (or pairs) of at most ``limit`` words.

    name, size, doc, at: of each symbol its name, words, document, first word.
    survived: by word, how many rounds the gap before it has outlived.
    """
    active = size <= limit
    join = np.zeros(len(name), bool)  # does this symbol join the one before it?
    near = active[1:] & active[:-1] & (doc[1:] == doc[:-1])
    if pairs:
        coin = (mix(name, level) >> np.uint64(63)).astype(bool)
        join[1:] = near & ~coin[:-1] & coin[1:]
    else:
        join[1:] = near & (name[1:] == name[:-1])
    head = np.flatnonzero(~join)
    survived[at[head]] = level
    count = np.diff(np.append(head, len(name)))
    if pairs:
        new = name[head]
        two = count == 2
        new[two] = mix(new[two] * np.uint64(3) + name[head[two] + 1] * np.uint64(0x9FB21C651E98DF25), level)
    else:
        new = name[head]
        many = count > 1
        new[many] = mix(new[many] + count[many].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), level)
    return new, np.add.reduceat(size, head) if len(head) else size, doc[head], at[head]


def anchors(w: Words, name: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words of all windows, the 64-bit name that represents each)."""
    n = len(name)
    length = np.diff(w.first)
    ok = np.arange(n) + window <= np.repeat(w.first[1:], length)
    where = np.flatnonzero(ok)
    if not len(where):
        return where, np.zeros(0, np.uint64)
    reach = max(1, min(4, (window - 1) // 3))
    survived = np.zeros(n, np.int64)
    s = (name, np.ones(n, np.int64), w.doc, np.arange(n))
    s = _round(*s[:3], survived, s[3], 1, 1, False)
    if reach >= 2:
        s = _round(*s[:3], survived, s[3], 2, 1, True)
    if reach >= 4:
        s = _round(*s[:3], survived, s[3], 3, 2, True)
    # the gap before word g sees the words g - reach .. g + reach - 1
    around = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    g = np.arange(reach, n - reach + 1)
    seen = segments(mix(name, 9), np.arange(n - 2 * reach + 1), np.arange(2 * reach, n + 1)) if n >= 2 * reach else np.zeros(0, np.uint64)
    around[g] = mix(seen)
    rank = (around >> np.uint64(2)) | ((3 - survived).astype(np.uint64) << np.uint64(62))
    best = rank[where + reach].copy()
    chosen = around[where + reach].copy()
    for k in range(reach + 1, window - reach + 1):
        r = rank[where + k]
        better = r < best
        best[better] = r[better]
        chosen[better] = around[where[better] + k]
    return where, chosen


def fingerprints(w: Words, where: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the windows at ``where``: two halves from independent names of the words."""
    return mix(segments(w.names(1), where, where + window, _BASE_A)), mix(segments(w.names(2), where, where + window, _BASE_B))


def _least(keys: list[np.ndarray], doc: np.ndarray):
    """Unique keys (sorted), with the smallest and the largest doc of each; and
    for each input row the index of its key."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(order)) - 1 if len(order) else head
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return [k[order[head]] for k in keys], doc[order[head]], doc[order[last]], index


def _deal(bucket: int, slices: int, parts: list[np.ndarray], key: np.ndarray) -> pa.RecordBatch:
    """Cut sorted arrays by the top bits of ``key`` into a row for each slice."""
    edges = np.array([(i << 64) // slices for i in range(1, slices)], np.uint64)
    at = [0, *np.searchsorted(key, edges), len(key)]
    full = [i for i in range(slices) if at[i + 1] > at[i]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([bucket] * len(full), pa.int32())]
        + [pa.array([p[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()) for p in parts],
        names=["slice", "bucket", *("abcdef"[i] for i in range(len(parts)))],
    )


def _join(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """The arrays packed in a binary column, one after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


class _Bucket:
    """The documents of one bucket, in an order that depends on nothing else."""

    def __init__(self, t: pa.Table):
        self.id = t.column("doc_id")
        data, bounds = flat(t.column("text"))
        self.w = words(data, bounds)
        self.name = self.w.names()
        known = np.array(self.id.is_valid())
        self.doc = np.where(known, np.array(self.id.fill_null(0)), BIG).astype(np.int64)

    def of(self, where: np.ndarray) -> np.ndarray:
        """doc_id (BIG: null) of the document in which these words stand."""
        return self.doc[self.w.doc[where]]


def _names(bucket: int, t: pa.Table, window: int, slices: int):
    b = _Bucket(t)
    where, name = anchors(b.w, b.name, window)
    keep = b.of(where) != BIG
    (key,), _, _, _ = _least([name[keep]], b.of(where)[keep])
    return _deal(bucket, slices, [key], key)


def _reveal(rows: pa.Table) -> pa.Table:
    """Of one slice: to each bucket, which of its names another one also holds."""
    size = [len(x) // 8 for x in rows.column("a").to_pylist()]
    key, owner = _join(rows.column("a"), np.uint64), np.repeat(np.array(rows.column("bucket")), size)
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    shared = same[1:] | same[:-1]
    return _back(k[shared], o[shared])


def _back(key: np.ndarray, owner: np.ndarray, *more: np.ndarray) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    owner, parts = owner[order], [key[order], *(m[order] for m in more)]
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    at = np.append(head, len(owner))
    return pa.Table.from_arrays(
        [pa.array(owner[head], pa.int32())] + [pa.array([p[at[i] : at[i + 1]].tobytes() for i in range(len(head))], pa.binary()) for p in parts],
        names=["bucket", *("abcdef"[i] for i in range(len(parts)))],
    )


def _windows(bucket: int, t: pa.Table, shared: pa.Table, window: int, slices: int):
    """Fingerprints of the windows whose name another document shares."""
    b = _Bucket(t)
    where, name = anchors(b.w, b.name, window)
    keep = b.of(where) != BIG
    where, name = where[keep], name[keep]
    _, low, high, index = _least([name], b.of(where))
    far = np.sort(_join(shared.column("a"), np.uint64))
    hit = (low < high)[index]
    if len(far):
        at = np.minimum(np.searchsorted(far, name), len(far) - 1)
        hit |= far[at] == name
    where = where[hit]
    h1, h2 = fingerprints(b.w, where, window)
    (h1, h2), low, _, _ = _least([h1, h2], b.of(where))
    return _deal(bucket, slices, [h1, h2, low], h1)


def _smallest(rows: pa.Table) -> pa.Table:
    """Of one slice: to each bucket, its windows that start in a smaller document
    elsewhere, with that document."""
    size = [len(x) // 8 for x in rows.column("a").to_pylist()]
    owner = np.repeat(np.array(rows.column("bucket")), size)
    h1, h2, low = _join(rows.column("a"), np.uint64), _join(rows.column("b"), np.uint64), _join(rows.column("c"), np.int64)
    (_, _), least, _, index = _least([h1, h2], low)
    far = least[index] < low
    return _back(h1[far], owner[far], h2[far], least[index][far])


def _mark(t: pa.Table, far: pa.Table, window: int) -> pa.Table:
    """The kept text of each document of a bucket."""
    b = _Bucket(t)
    w, n = b.w, len(b.name)
    length = np.diff(w.first)
    where = np.flatnonzero(np.arange(n) + window <= np.repeat(w.first[1:], length))
    where = where[b.of(where) != BIG]
    h1, h2 = fingerprints(b.w, where, window)
    f1, f2, fdoc = (_join(far.column(c), k) for c, k in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))
    _, low, _, index = _least([np.concatenate([h1, f1]), np.concatenate([h2, f2])], np.concatenate([b.of(where), fdoc]))
    gone = where[low[index[: len(where)]] < b.of(where)]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + window, -1)
    out = np.cumsum(step[:n]) > 0
    byte = np.zeros(len(w.data) + 1, np.int8)
    byte[w.start[~out]] += 1
    byte[w.end[~out]] -= 1
    inside = np.cumsum(byte[:-1], dtype=np.int8).astype(bool)
    plain = w.data.copy()
    after = w.end[~out]
    after = after[after < w.bounds[1:][w.doc[~out]]]  # the byte after a word, unless the document ends there
    inside[after] = True
    plain[after] = 0x20
    edge = np.zeros(n + 1, bool)
    edge[w.first[:-1][length > 0]] = True
    begins = np.flatnonzero(out & (np.append(False, ~out[:-1])[:n] | edge[:n]))
    ends = np.flatnonzero(out & (np.append(~out[1:], True)[:n] | edge[1:] | (np.arange(n) == n - 1))) + 1
    span_doc = w.doc[begins] if n else begins
    lost = np.bincount(w.doc[out], minlength=len(length)) if n else np.zeros(len(length), int)
    base = w.first[span_doc] if len(span_doc) else span_doc
    texts, own = [], np.searchsorted(span_doc, np.arange(len(length) + 1))
    spans = list(zip((begins - base).tolist(), (ends - base).tolist(), strict=True))
    for i in range(len(length)):
        lo, hi = w.bounds[i], w.bounds[i + 1]
        kept = plain[lo:hi][inside[lo:hi]].tobytes()
        texts.append((kept[:-1] if kept.endswith(b" ") else kept).decode("utf-8"))
    return pa.table(
        {
            "doc_id": t.column("doc_id"),
            "n_words": pa.array(length, pa.int64()),
            "n_removed": pa.array(lost, pa.int64()),
            "kept_text": pa.array(texts, pa.string()),
            "removed_spans": pa.array([[{"start": s, "end": e} for s, e in spans[own[i] : own[i + 1]]] for i in range(len(length))], _SPANS),
        }
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _per_slice(fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[pa.Table]] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            kinds = np.array(t.column("slice"))
            for k in np.unique(kinds):
                rows.setdefault(int(k), []).append(t.filter(pa.array(kinds == k)))
        for parts in rows.values():
            yield from fn(pa.concat_tables(parts)).to_batches()

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove words covered by windows that also start in a smaller document.

    docs: ``doc_id``, ``text`` (further columns are ignored).  Words are maximal
    runs of bytes other than 0x20 and 0x09-0x0D, compared unchanged.

    Returns a row for each input row: doc_id, n_words, n_removed, kept_text (the
    kept words joined by one space) and removed_spans (word ranges).

    Null or empty text: no words, empty kept_text.  Null doc_id: the document is
    neither searched nor cut.  Rows that repeat a doc_id do not count as smaller
    than each other, so they stay whole.  Texts shorter than a window stay whole.
    An empty table gives an empty result.
    """
    if window < 3:
        raise ValueError("a window has at least 3 words")
    n = bucket_count(spark, docs)
    slices = n
    of = documents(docs).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    of = of.repartition(n, "bucket")
    by_bucket = of.groupBy("bucket")
    packed = "slice int, bucket int, a binary"

    def names(key, t):
        return pa.Table.from_batches([_names(key[0].as_py(), t, window, slices)])

    def verify(key, t, flags):
        if not t.num_rows:
            return pa.Table.from_batches([], pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]))
        return pa.Table.from_batches([_windows(key[0].as_py(), t, flags, window, slices)])

    def mark(key, t, flags):
        return _mark(t, flags, window)

    revealed = by_bucket.applyInArrow(names, packed).repartition(n, "slice").mapInArrow(_per_slice(_reveal), "bucket int, a binary")
    checked = by_bucket.cogroup(revealed.groupBy("bucket")).applyInArrow(verify, packed + ", b binary, c binary")
    smaller = checked.repartition(n, "slice").mapInArrow(_per_slice(_smallest), "bucket int, a binary, b binary, c binary")
    return by_bucket.cogroup(smaller.groupBy("bucket")).applyInArrow(
        mark, "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,end:long>>"
    )
