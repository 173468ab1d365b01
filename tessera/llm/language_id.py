"""Language identification by multinomial naive Bayes over hashed character n-grams.

N-grams are taken over the characters of the lower-cased text, hashed into a fixed
number of buckets and counted per language in one pass.  The matrix of log
probabilities (buckets x languages, of a checked size) is broadcast; each batch
of documents is scored as one sparse product in numpy: rows of the matrix are
gathered by bucket and summed per document, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import chunks, documents, flat

BUCKETS, SIZES = 1 << 15, (1, 2, 3, 4)
#: The matrix may have this many numbers: 1,000 languages at 32,768 buckets.
MOST = BUCKETS * 1000
#: Labelled rows that are learnt from: about this many of each language.
SAMPLE = 20_000
UNKNOWN = "und"
#: n-grams after which a score no longer rises.
TEMPER = 40


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of each character as one number, text); white space counts as one space."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(data)))
    x = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        x[more] = x[more] << np.uint32(8) | data[start[more] + k]
    x[x <= 0x20] = 0x20
    return x, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))


def grams(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each n-gram of characters, size by size."""
    x, own = characters(data, bounds)
    n = len(x)
    h = np.zeros(n, np.uint32)
    for size in range(1, max(SIZES) + 1):
        if n < size:
            return
        h = h[: n - size + 1] * np.uint32(0x9E3779B1) + x[size - 1 :] + np.uint32(1)
        if size in SIZES:
            whole = own[size - 1 :] == own[: n - size + 1]
            mixed = (h ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            bucket = (mixed >> np.uint32(16)).astype(np.int64) % buckets
            yield bucket[whole], own[: n - size + 1][whole]


def lowered(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about 1 MB of text (one long text may exceed it): rows, lower-cased bytes, bounds.

    Texts are lower-cased slice by slice, so a second copy of a batch never exists.
    """
    for part, _, _ in chunks(batch, 1 << 20, column):
        data, bounds = flat(pc.utf8_lower(part.column(column)))
        yield part, data, bounds


def _fit(languages: list[str]):
    place = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for part, data, bounds in lowered(batch, "text"):
                of = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                for bucket, own in grams(data, bounds):
                    np.add.at(count, (of[own], bucket), 1)
        lang, bucket = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(count[lang, bucket])], names=["lang", "bucket", "n"])

    return run


class Model:
    """languages, and the matrix of log probabilities: buckets x languages."""

    def __init__(self, languages: list[str], count: np.ndarray, rows: np.ndarray):
        self.languages = languages
        total = count.sum(axis=1, keepdims=True)
        self.log = np.ascontiguousarray(np.log((count + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32))
        self.prior = np.log((rows + 1.0) / (rows.sum() + len(rows)))

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each language, n-grams) of each text."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        seen = np.zeros(len(bounds) - 1)
        for bucket, own in grams(data, bounds):
            if len(bucket):
                head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                for j in range(len(self.languages)):
                    out[own[head], j] += np.add.reduceat(self.log[bucket, j], head, dtype=np.float64)
                seen[own[head]] += np.diff(np.append(head, len(own)))
        return out, seen


def train(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on about ``sample`` rows of each lang (all, if there are fewer).

    Rows are chosen by a hash, so the choice is the same each time.
    Returns None if there is nothing to learn from.
    """
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    count = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST // BUCKETS + 1).collect()
    if not count:
        return None
    if len(count) > MOST // BUCKETS:
        raise ValueError(f"more than {MOST // BUCKETS} languages")
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in count}
    if min(share.values()) < 1:
        most = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 30))))])
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) < most[F.col("lang")])
    languages = [r["lang"] for r in count]
    # rows of the result: the cells of the matrix that are not zero, at most
    cells = rows.select("text", "lang").mapInArrow(_fit(languages), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((len(languages), BUCKETS))
    matrix[np.array(cells.column("lang"), dtype=int), np.array(cells.column("bucket"), dtype=int)] = np.array(cells.column("n"))
    return Model(languages, matrix, np.array([r["n"] for r in count], float))


def _judge(spark: SparkSession, docs: DataFrame, model: Model | None, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and lang_pred, score.  docs has a column
    ``_letter``, too: whether the text holds one."""
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name in keep]
    names = [*(f.name for f in kept), "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, bounds in lowered(batch, text):
                letter = np.array(part.column("_letter").fill_null(False))
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if m is not None and part.num_rows:
                    total, seen = m.score(data, bounds)
                    best = (total + m.prior).argmax(axis=1)
                    each = total * (np.minimum(seen, TEMPER) / np.maximum(seen, 1))[:, None] + m.prior
                    share = np.exp(each - each.max(axis=1, keepdims=True))
                    score = np.where(letter, share[np.arange(len(best)), best] / share.sum(axis=1), 0.0)
                    lang = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                own = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score)], names=names)

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _letter(text: Column) -> Column:
    return text.rlike(r"\p{L}").alias("_letter")


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each document.

    score is the posterior after at most ``TEMPER`` n-grams' worth of evidence,
    so it does not saturate with length.  Null text, text without a letter, or no
    model: ``und``, score 0.  Repeated rows are judged each; long texts are read
    whole; an empty table gives no rows.
    """
    plain = documents(docs)
    return _judge(spark, plain.select("*", _letter(F.col("text"))), model, "text", ["doc_id"])


def fold(doc_id: str | Column = "doc_id", of: int = 4) -> Column:
    """crc32 of the doc_id, as text, modulo ``of``."""
    return F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "utf-8")) % of


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without those in no known language (``und``): null text, or no letter.

    The model is learnt from the documents' own text and lang; without any lang
    the same documents go.  All columns are kept as they are, whatever their names; rows
    that repeat are kept or go alike; an empty table stays empty.
    """
    model = train(spark, docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    text = f"c{docs.columns.index('text')}"
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = _judge(spark, plain.select("*", _letter(F.col(text))), model, text, plain.columns).filter(F.col("lang_pred") != UNKNOWN)
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
