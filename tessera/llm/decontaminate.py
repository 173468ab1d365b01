"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if at least ``threshold`` of its distinct
shingles occur there.  Items are partitioned by their number of shingles m; an
item's sketch is the k smallest of its shingle hashes, k = m - ceil(threshold *
m) + 1 being its partition's.  An item whose sketch a document misses altogether
lacks more shingles than it may, so sketches lose no item however long the
document is.  Documents are scanned once; whole documents are searched for sketch
values with one binary search over all their shingle hashes.  Each hit is
verified: the item's exact set of shingles is counted in the document, with
128-bit fingerprints.

Items are searched in blocks of bounded size, so what is broadcast is bounded
whatever the size of the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, chunks, documents, flat, mix, segments, words

#: Bytes of item text that one scan of the documents looks for.
BLOCK_BYTES = 16 << 20

_A, _B = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _plain(text: str = "text"):
    """Lower case, with anything but letters, marks and digits taken as a gap."""
    return F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}]+", " ")


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two independent 64-bit halves, text) of each shingle; texts with fewer words have one."""
    length = np.diff(w.first)
    count = np.where(length > 0, np.maximum(length - n + 1, 1), 0)
    own = np.repeat(np.arange(len(length)), count)
    s = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
    e = np.minimum(s + n, w.first[1:][own])
    size = (e - s).astype(np.uint64)
    return mix(segments(w.names(1), s, e, _A) + size), mix(segments(w.names(2), s, e, _B) + size), own


class Sketches:
    """Items of one block: sketches by size, and the shingles to verify."""

    def __init__(self, ids: list[int], texts: list[str], n: int, threshold: float):
        data, bounds = flat(pa.array(texts, pa.string()))
        h1, h2, own = _shingles(words(data, bounds), n)
        order = np.lexsort((h2, h1, own))
        h1, h2, own = h1[order], h2[order], own[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (own[1:] != own[:-1]))[: len(own)]
        h1, h2, own = h1[new], h2[new], own[new]
        self.size = np.bincount(own, minlength=len(ids))
        self.need = np.array([max(1, math.ceil(threshold * m - 1e-9)) for m in self.size.tolist()], np.int64)
        within = np.arange(len(own)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        sketch = within < (self.size - self.need + 1)[own]
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.unnamed = np.array([i is None for i in ids], bool)
        self.key, self.item = h1[sketch], own[sketch]
        by = np.argsort(self.key, kind="stable")
        self.key, self.item = self.key[by], self.item[by]
        whole = np.lexsort((own, h2, h1))
        self.h1, self.h2, self.own = h1[whole], h2[whole], own[whole]

    def find(self, w: Words, n: int):
        """(text, item, shared shingles) of contained items."""
        none = np.zeros(0, np.int64)
        if not len(self.key) or not len(w.start):
            return none, none, none
        h1, h2, own = _shingles(w, n)
        at = np.minimum(np.searchsorted(self.key, h1), len(self.key) - 1)
        hit = np.unique(own[self.key[at] == h1])
        if not len(hit):
            return none, none, none
        chosen = np.zeros(int(own[-1]) + 1, bool)
        chosen[hit] = True
        use = chosen[own]
        h1, h2, own = h1[use], h2[use], own[use]
        # every shingle of an item that a document with a hit holds, once
        lo, hi = np.searchsorted(self.h1, h1), np.searchsorted(self.h1, h1, side="right")
        row = np.repeat(np.arange(len(h1)), hi - lo)
        k = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        same = self.h2[k] == h2[row]
        doc, k = own[row[same]], k[same]
        pair = np.unique(np.stack([doc, k]), axis=1)
        got, count = np.unique(np.stack([pair[0], self.own[pair[1]]]), axis=1, return_counts=True)
        enough = count >= self.need[got[1]]
        return got[0][enough], got[1][enough], count[enough]


FOUND = "doc_id long, item_id long, shared long, shingles long, containment double"


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in lists of about ``BLOCK_BYTES`` of text."""
    test = items.select(F.col("item_id").cast("long").alias("item_id"), _plain().alias("text")).filter("text rlike '[^ ]'")
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = test.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a bounded block
        yield [(r["item_id"], r["text"]) for r in rows]


def _sketches(spark: SparkSession, items: list[tuple[int, str]], n: int, threshold: float):
    return spark.sparkContext.broadcast(Sketches([i for i, _ in items], [t for _, t in items], n, threshold))


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a test item contained in it.

    docs: doc_id, text; items: item_id, text.  Case and punctuation do not count.
    Items of fewer than n words are one shingle; items and documents without
    words (null, blank) match nothing.  Items with a null item_id take part.
    Rows that repeat an id are searched each on their own; an empty table on either
    side gives no rows; long documents are searched whole.  Returns doc_id,
    item_id, shared and all distinct shingles of the item, containment.
    """
    plain = documents(docs).select("doc_id", _plain().alias("text"))

    def scan(sketches):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sketches.value
            for batch in batches:
                for part, data, bounds in chunks(batch):
                    doc, item, shared = s.find(words(data, bounds), n)
                    size = s.size[item]
                    ids = pa.array(s.ids[item], mask=s.unnamed[item])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(doc, pa.int64())), ids, pa.array(shared, pa.int64()), pa.array(size, pa.int64()), pa.array(shared / np.maximum(size, 1))],
                        names=["doc_id", "item_id", "shared", "shingles", "containment"],
                    )

        return run

    out = None
    for block in _blocks(items):
        found = plain.mapInArrow(scan(_sketches(spark, block, n, threshold)), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs, with all their columns, without those that contain a test item.

    Documents are dropped where they are scanned: nothing is shuffled.  Null and blank
    texts stay, and null or blank items match nothing; rows that repeat are kept or go
    alike; without items all stay, and an empty table stays empty.
    """
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"

    def scan(sketches):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sketches.value
            for batch in batches:
                for part, data, bounds in chunks(batch, column="_plain"):
                    keep = np.ones(part.num_rows, bool)
                    keep[s.find(words(data, bounds), n)[0]] = False
                    yield part.filter(pa.array(keep)).drop_columns("_plain")

        return run

    for block in _blocks(items):
        named = named.withColumn("_plain", _plain(text)).mapInArrow(scan(_sketches(spark, block, n, threshold)), named.schema)
    return named.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
