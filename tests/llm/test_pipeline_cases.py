"""The whole pipeline on small awkward tables."""

import random

import pytest

import corpus_pipeline
from tessera.llm import language_id, near_copies
from tessera.llm.common import free_name

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _salt int, _rank string, key long, root long, parts int"
ITEMS = "item_id long, text string, key string"


def run(spark, tmp_path, docs, items):
    rows = [(i, x, lang, "s", len(x or ""), 1, "r", 2, 3, 4) for i, x, lang in docs]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x, "k") for i, x in items], ITEMS).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    items = [(1, prose(1, 20)), (None, prose(2, 20)), (3, None), (4, ""), (1, prose(1, 20))]
    docs = [(i, prose(100 + i), "en" if i % 2 else None) for i in range(12)]
    docs += [(20, None, "en"), (21, "", None), (22, "123 456 !", "en"), (None, prose(300), "en"), (23, "w" * 200_000, "en")]
    docs += [(30, docs[3][1], "en"), (31, docs[3][1] + " end", "en"), (4, docs[4][1], None), (4, docs[4][1], None)]  # copies, near copies, repeated rows
    docs += [(40, f"{prose(400)} {items[0][1]} {prose(401)}", "en"), (41, f"{prose(402)} {items[1][1]}", None)]  # test items inside
    got = run(spark, tmp_path, docs, items)
    assert {r.doc_id for r in got} == {*range(12), None, 23}
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


@pytest.mark.parametrize("items", [[], [(1, "some words of a test item here")]])
def test_empty_documents(spark, tmp_path, items):
    assert run(spark, tmp_path, [], items) == []


def test_no_benchmark(spark, tmp_path):
    got = run(spark, tmp_path, [(1, prose(1), "en"), (2, prose(2), "en")], [])
    assert {r.doc_id for r in got} == {1, 2}


def test_stages_keep_further_columns(spark):
    rows = [(1, prose(1), "en", "s", 1, 1, "r", 2, 3, 4), (2, prose(1), "en", "s", 1, 1, "r", 2, 3, 4), (3, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert [tuple(r) for r in near_copies.drop_near_copies(spark, df.filter("doc_id < 3"), threshold=0.8).collect()] == [rows[0]]
    assert sorted(tuple(r) for r in language_id.keep_known(spark, df).collect()) == rows[:2]
    assert free_name(df, "_salt") == "__salt"
