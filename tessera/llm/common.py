"""Shared pieces of the text operators: paths, sizes, and byte-level words.

The numpy helpers work on the flat byte buffer of an Arrow string column, so a
batch of documents is split into words and fingerprinted without a Python loop
over words.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import written

#: Input bytes (as Catalyst estimates them) that one bucket of documents holds.
BUCKET_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, unless it names a number itself.

    A batch stands in the memory of the JVM and of a Python worker at once; texts
    of some kilobytes make Spark's 10,000 rows a large part of a small executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it."""
    return written(df, name, **{"compression": "zstd", **options})


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size; for file scans the files' size.

    Some inputs (rows from the driver, joins) have no useful estimate; these are
    measured.
    """
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess <= 1 << 50:
        return guess
    size = F.lit(16)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


def bucket_count(spark: SparkSession, df: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """Buckets that grow with the data, so that one bucket always fits a task."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-estimated_bytes(df) // bytes_each)
    return int(max(shuffle, min(wanted, 1_000_000)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(df: DataFrame, *more: str) -> DataFrame:
    """(doc_id long, text string, ...): only these columns go any further."""
    kinds = dict(df.dtypes)
    text = F.col("text") if kinds["text"] == "string" else F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


# --------------------------------------------------------------------------
# Flat words
# --------------------------------------------------------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes beyond which a word is named by a digest.
LONG = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        m = 1 << max(12, (n - 1).bit_length())
        got = np.full(m, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
        if m > 1 << 23:  # an unusually long text: do not keep tables that large
            _powers.pop(base)
    return got[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial fingerprints, modulo 2**64, of values[start:end].

    For short ranges of mixed names only: in ranges of 1,024 values and more that
    follow a Thue-Morse word, such polynomials collide whatever the base."""
    inverse = _BASE_INV if base == _BASE else pow(base, -1, 1 << 64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts]


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of the bytes start..end - 1; names of another ``salt`` are independent of it.

    Bytes are mixed eight at a time, so strings of equal length and at most eight
    bytes never share a name; the few over ``LONG`` bytes are digested with BLAKE2b.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    out = mix(size.astype(np.uint64), salt)
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        beyond = np.maximum(8 - (size[at] - k), 0).astype(np.uint64) * np.uint64(8)
        piece = eight[start[at] + k] << beyond
        out[at] = mix(out[at] ^ piece * np.uint64(0x9FB21C651E98DF25), salt + 1)
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


@dataclass
class Words:
    """The words of some documents, in order.

    ``data``: all bytes; ``bounds``: byte offsets of the documents; ``start``,
    ``end``: byte offsets of each word; ``doc``: its document; ``first``: for
    each document, the index of its first word (and, last, the number of words).
    """

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def names(self, salt: int = 0) -> np.ndarray:
        """A 64-bit name of each word, the same wherever the word occurs."""
        return names(self.data, self.start, self.end, salt)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Split on the bytes 0x20 and 0x09-0x0D; no word crosses two documents."""
    white = _WHITE[data]
    n = len(data)
    before = np.ones(n + 1, bool)  # is what stands before this byte white or another document?
    before[1:n] = white[:-1]
    before[bounds] = True
    start = np.flatnonzero(before[:n] & ~white)
    after = np.ones(n + 1, bool)  # is this byte white, or of another document?
    after[:n] = white
    after[bounds] = True
    end = np.flatnonzero(after[1:] & ~white) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, doc, first)


def chunks(batch: pa.RecordBatch | pa.Table, size: int = 2 << 20, column: str = "text"):
    """Slices of ``batch`` of about ``size`` bytes of text (one long text may exceed it)."""
    data, bounds = flat(batch.column(column))
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def worker_env() -> None:
    """One thread per Python worker: Spark already runs one worker per core."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
