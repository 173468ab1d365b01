"""Token counts of documents in flat, unindexed token files.

A token file is a stream of ids in which an end-of-document id follows each
document; nothing says where documents begin.  Files are read in blocks that cut
documents anywhere.  Each block is searched for the end id with one vectorised
comparison; what spans blocks is stitched with a prefix scan over one small row
per block (ids, ends, place of the last end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, documents, table, worker_env
from tessera.llm.tokens import encoder

BLOCK = 1 << 18
BLOCKS = "file string, block long, ids binary, doc_ids array<long>"


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int, block: int = BLOCK, id_bytes: int = 2) -> DataFrame:
    """Flat token streams, one per task, cut into blocks of ``block`` ids of ``id_bytes``
    (2 or 4) bytes each.

    doc_ids names, in order, the documents whose end lies in a block; it holds
    no places.  Null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_env()
        enc = encoder(vocabulary)
        context = TaskContext.get()
        file = f"part-{context.partitionId() if context else 0:06d}"
        number, held, ends, names = 0, np.zeros(0, f"<u{id_bytes}"), np.zeros(0, np.int64), []

        def out(ids, who):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([who], pa.list_(pa.int64()))], names=["file", "block", "ids", "doc_ids"])

        for batch in batches:
            for part, data, bounds in chunks(batch):
                ids, at = enc.encode(data, bounds)
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                if len(ids) and int(ids.max()) >= 1 << 8 * id_bytes:
                    raise ValueError(f"ids do not fit {id_bytes} bytes")
                ends = np.append(ends, len(held) + at[1:] + np.arange(len(at) - 1))
                names += part.column("doc_id").to_pylist()
                held = np.append(held, ids.astype(f"<u{id_bytes}"))
                while len(held) >= block:
                    k = int(np.searchsorted(ends, block))
                    yield out(held[:block], names[:k])
                    number, held, ends, names = number + 1, held[block:], ends[k:] - block, names[k:]
        if len(held):
            yield out(held, names)

    return documents(docs).mapInArrow(run, BLOCKS)


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK, id_bytes: int = 2) -> DataFrame:
    """Blocks of raw little-endian token files (files of under 2 GB)."""
    step = id_bytes * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for k in range(0, len(content), step):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k // step], pa.int64()), pa.array([content[k : k + step]], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "ids", "doc_ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def _search(end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, ends, last, first, more = [], [], [], [], []
            for raw in b.column("ids").to_pylist():
                ids = np.frombuffer(raw or b"", f"<u{id_bytes}")
                at = np.flatnonzero(ids == end_id)
                size.append(len(ids))
                ends.append(len(at))
                last.append(int(at[-1]) if len(at) else None)
                first.append(int(at[0]) if len(at) else None)
                more.append(np.diff(at) - 1)
            arrays = [b.column("file"), b.column("block"), pa.array(size, pa.int64()), pa.array(ends, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(more, pa.list_(pa.int64())), b.column("doc_ids")]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "size", "ends", "first", "last", "more", "doc_ids"])

    return run


def count_tokens(blocks: DataFrame, end_id: int, id_bytes: int = 2) -> DataFrame:
    """Documents of token files and how many ids each has.

    blocks: file, block (from 0, in order), ids (packed, ``id_bytes`` each), doc_ids (null if
    unknown).  Returns file, ordinal (from 0 in its file), doc_id (null if
    unknown), n_tokens (without the end id), closed (false for ids after the last
    end).  Two ends in a row are an empty document.  Empty files have no rows.
    """
    found = blocks.select("file", "block", "ids", "doc_ids").mapInArrow(
        _search(end_id, id_bytes), "file string, block long, size long, ends long, first long, last long, more array<long>, doc_ids array<long>"
    )
    # the scan's rows are a few numbers per block, whatever the documents are
    up_to = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = found.select("file", "block", "size", "ends", "last").withColumns({"_at": F.coalesce(F.sum("size").over(up_to), F.lit(0)), "_before": F.coalesce(F.sum("ends").over(up_to), F.lit(0))})
    begin = begin.withColumn("_end", F.coalesce(F.max(F.col("_at") + F.col("last")).over(up_to), F.lit(-1)))
    begin = begin.withColumn("_final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    carried = begin.select("file", "block", "_at", "_before", "_end", "_final")
    all_ = found.join(carried, ["file", "block"])
    n = F.concat(F.array(F.col("_at") + F.col("first") - F.col("_end") - 1), F.col("more"))
    inside = all_.filter("ends > 0").select("file", "_before", "doc_ids", F.posexplode(n).alias("_k", "n_tokens"))
    inside = inside.select("file", (F.col("_before") + F.col("_k")).alias("ordinal"), F.get("doc_ids", F.col("_k")).alias("doc_id"), "n_tokens", F.lit(True).alias("closed"))
    since = F.col("_at") + F.col("size") - 1 - F.coalesce(F.col("_at") + F.col("last"), F.col("_end"))
    rest = begin.filter("_final").select("file", (F.col("_before") + F.col("ends")).alias("ordinal"), F.lit(None).cast("long").alias("doc_id"), since.alias("n_tokens"), F.lit(False).alias("closed"))
    return inside.unionByName(rest.filter("n_tokens > 0"))


def count_document_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 50256) -> DataFrame:
    """(file, ordinal, doc_id, n_tokens, closed): the ids of each whole text, counted in
    token streams that are written first.

    Null and empty texts have none; repeated rows are counted each; a null doc_id
    stays null; very long texts span blocks; an empty table gives no rows.  Further
    columns are ignored.
    """
    return count_tokens(table(spark, token_blocks(docs, vocabulary, end_id), "tokens"), end_id)
