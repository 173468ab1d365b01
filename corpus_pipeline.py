"""Five text operators chained over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Between stages the rows are written to the
shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, near_copies, packing, pii
from tessera.llm.common import bounded_batches, table
from tessera.llm.queries import PII_KEY
from tessera.llm.tokens import default_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null text, and text without a letter."""
    bounded_batches(spark)
    return language_id.keep_known(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (80 % of 5-word shingles) the smallest id stays."""
    return near_copies.drop_near_copies(spark, docs, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(spark, docs, items, n=5, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become keyed pseudonyms."""
    return pii.replace_personal_data(docs, PII_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of at most 1,024 ids with a place in a sequence."""
    return packing.pack_documents(spark, docs, default_vocabulary(), capacity=1024, end_id=2)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: Tokenisers and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that every stage kept, with their places.

    Null texts go in the first stage, as do texts without a letter, empty ones included;
    rows that repeat an id count each, and of equal texts that of the smallest id stays
    (null ids last).  Further columns are kept up to packing.  Long texts are handled
    whole.  Without documents there are no rows; without ``benchmark`` items, or with
    null or blank ones only, none is dropped for them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(spark, docs, f"stage{i}")
    return docs
