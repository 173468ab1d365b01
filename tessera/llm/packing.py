"""Best-fit packing of tokenised documents into sequences of equal capacity.

Bulk-synchronous best fit.  Lengths and gaps are whole numbers up to the
capacity, so documents and gaps in sorted order fall into runs of equal length,
at most ``capacity`` of each.  One sweep takes the longest run of documents not
yet placed and finds its successor, the run of the smallest gaps that are large
enough; both runs are matched in the order of their ranks, which resolves
conflicts (the i-th document of the run gets the i-th gap), the gaps shrink and
move to the run of their new size, and sweeps go on until no run is left.
Documents without a successor open new sequences.

The sweeps need only how many documents each run holds (``capacity`` numbers,
whatever the input).  They yield runs of (length, first rank) -> (first
sequence, offset), a few thousand at most.  Ranks within a length, the only
thing that needs the documents themselves, are computed in salted groups whose
sizes are summed first, so a length that a third of all documents share is dealt
over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bucket_count, chunks, documents, free_name, table, worker_env
from tessera.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n ids: only the first may be short."""
    if n <= capacity:
        return [0]
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those longer than ``capacity``.

    Returns doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32 (unsigned, of the little-endian unsigned 32-bit ids) and,
    if asked for, ids.  Null text counts as empty: the document is ``end_id``
    alone.  Null and repeated doc_ids are kept, row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_env()
        enc = encoder(vocabulary)
        for batch in batches:
            for part, data, bounds in chunks(batch):
                ids, at = enc.encode(data, bounds)
                whose, number, start, length, crc, out = [], [], [], [], [], []
                ends = at[1:] + np.arange(1, len(at))  # with an end id after each text
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4", copy=False)
                begin = np.append(0, ends[:-1])
                for i, (lo, hi) in enumerate(zip(begin.tolist(), ends.tolist(), strict=True)):
                    starts = _cut(hi - lo, capacity)
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], hi - lo], strict=True)):
                        whose.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[lo + s : lo + e]))
                        if with_ids:
                            out.append(ids[lo + s : lo + e].astype(np.int64))
                columns = [part.column("doc_id").take(pa.array(whose, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents(docs).mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def sweeps(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) of matched runs."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    placed, opened = [], 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            gaps.setdefault(gap, []).append((first, many))

    for length in sorted(count, reverse=True):
        rank, left = 0, count[length]
        while left:
            gap = min((g for g in gaps if g >= length), default=0)
            if not gap:
                break
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            n = min(left, many)
            placed.append((length, rank, n, first, capacity - gap))
            leave(gap, first + n, many - n)
            leave(gap - length, first, n)
            rank, left = rank + n, left - n
        per = capacity // length
        full, rest = divmod(left, per)
        for k in range(per):
            if full:
                placed.append((length, rank, full, opened, k * length))
                rank += full
        leave(capacity - per * length, opened, full)
        opened += full
        if rest:
            for k in range(rest):
                placed.append((length, rank, 1, opened, k * length))
                rank += 1
            leave(capacity - rest * length, opened, 1)
            opened += 1
    return placed


def pack(spark: SparkSession, made: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 .. ``capacity`` ids.

    made: a DataFrame with ``length`` and the columns of ``pieces``, cheap to
    read twice and the same each time (a written table).  Rows that are equal in
    all of these are interchangeable.  Empty input gives an empty result.
    """
    made = made.drop("sequence_id", "offset")
    n = bucket_count(spark, made)
    salt, base, rank, size_, row = (free_name(made, x) for x in ("_salt", "_base", "_rank", "_n", "_r"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in made.columns]
    salted = made.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    size = salted.groupBy("length", salt).agg(F.count("*").alias(size_))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = size.select("length", salt, F.coalesce(F.sum(size_).over(before), F.lit(0)).alias(base))
    # at most `capacity` rows, however large the input
    count = {r[0]: r[1] for r in made.groupBy("length").agg(F.count("*")).collect()}
    if any(not 0 < k <= capacity for k in count):
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    ordered = sorted(count)
    offset = dict(zip(ordered, np.cumsum([0, *(count[k] for k in ordered)]).tolist(), strict=False))
    runs = sorted((offset[k] + rank, m, first, at) for k, rank, m, first, at in sweeps(count, capacity))
    lead, first, place = (np.array([r[i] for r in runs], np.int64) for i in (0, 2, 3))
    own = np.zeros(capacity + 1, np.int64)
    own[ordered] = [offset[k] for k in ordered]
    schema = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place_in_all = own[np.array(b.column("length"))] + np.array(b.column(rank))
            run = np.searchsorted(lead, place_in_all, side="right") - 1
            arrays = [*b.columns[:-1], pa.array(first[run] + place_in_all - lead[run], pa.int64()), pa.array(place[run], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    within = Window.partitionBy("length", salt).orderBy(*order)
    ranked = salted.withColumn(row, F.row_number().over(within)).join(starts, ["length", salt]).withColumn(rank, F.col(base) + F.col(row) - 1)
    return ranked.select(*made.columns, F.col(rank).cast("long")).mapInArrow(assign, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack: a row per piece with its place."""
    return pack(spark, table(spark, pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
