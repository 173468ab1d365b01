"""The ``opN_<name>`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, language_id, packing, pii, quality, ranked_search, secret_scan, simhash, spelling, substring_dedup, token_counts, topk_search
from tessera.llm.common import bounded_batches
from tessera.llm.tokens import default_vocabulary


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(spark, read(spark, sf_dir, "documents"), window=13)
    kept = F.sha2(F.encode("kept_text", "utf-8"), 256)
    return out.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, read(spark, sf_dir, "documents"), default_vocabulary(), capacity=1024, end_id=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language_id.fold("doc_id", 4) == 2
    model = language_id.train(spark, docs.filter(~held_out))
    return language_id.predict(spark, docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Key of the pseudonyms in the query; a real run passes a secret one.
PII_KEY = "example-key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(read(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, read(spark, sf_dir, "documents"), distance=3, shingle=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_document_tokens(spark, read(spark, sf_dir, "documents"), default_vocabulary(), end_id=50256)
    return out.select("doc_id", "n_tokens")


def op7_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.usable(read(spark, sf_dir, "embeddings"), scale=256.0)
    return topk_search.search(spark, vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = language_id.fold("doc_id", 5) == 0
    out = quality.classify(spark, read(spark, sf_dir, "documents"), labels, learn=~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(read(spark, sf_dir, "conversations"))
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = chat.read_back(chat.format_conversations(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "utf-8"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spark, read(spark, sf_dir, "documents"), least=3, letters=5, factor=2, damage=97)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(spark, read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < len(secret_scan.BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long").alias(f"n_{secret_scan.BASE[i].kind}")

    counts = map(count, range(len(secret_scan.BASE)))
    return found.select("doc_id", *counts, F.sha2(F.encode(secret_scan.listed(base), "utf-8"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_topk_search": op7_exact_topk_search,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (
  SELECT k, min(doc_id) AS d FROM g GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j
  FROM g JOIN f USING (k) WHERE f.d < g.doc_id
), t AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.j) AS k, count(*) AS n
  FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.j = gone.j GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

ORACLES["op7_exact_topk_search"] = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

ORACLES["op8_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id AS id, regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), '[^ ]+') AS ws FROM documents
), b AS (
  SELECT item_id AS id, regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), '[^ ]+') AS ws FROM benchmark
), ds AS (
  SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + 4), ' ') AS k
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)
), bs AS (
  SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + 4), ' ') AS k
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM b WHERE len(ws) > 0)
), m AS (
  SELECT id, count(*) AS m FROM bs GROUP BY id
), p AS (
  SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS shared FROM ds JOIN bs USING (k) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(m AS BIGINT) AS shingles,
       CAST(shared AS DOUBLE) / CAST(m AS DOUBLE) AS containment
FROM p JOIN m ON p.item_id = m.id WHERE shared >= 0.8 * m - 1e-9
"""

ORACLES["op10_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, 10 + 2 + 8
    + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g'))
    + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

ORACLES["op11_spelling_variants"] = r"""
WITH r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), d AS (
  SELECT doc_id, low, count(*) AS n FROM r WHERE length(low) >= 5 GROUP BY ALL
), x AS (
  SELECT low, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || low)) AS bytes FROM d
), y AS (
  -- CRC-32 bit by bit: a byte is added, then eight shifts follow it (-1)
  SELECT low, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(bytes), 2),
    lambda i: [CAST(('0x' || substr(bytes, i, 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM x
), v AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word, sum(n) AS n FROM y GROUP BY word
), w AS (
  SELECT word, CAST(n AS BIGINT) AS n FROM v WHERE n >= 3 AND length(word) >= 5
), g AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS other FROM g a JOIN g b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT g.word, w.word FROM g JOIN w ON g.rest = w.word
  UNION SELECT w.word, g.word FROM g JOIN w ON g.rest = w.word
), f AS (
  SELECT p.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(o.word, (-o.n, o.word)) AS form FROM p JOIN w o ON p.other = o.word GROUP BY p.word
), l AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word
), c AS (
  WITH RECURSIVE c AS (SELECT word, word AS last, form AS next FROM l UNION ALL SELECT c.word, l.word, l.form FROM c JOIN l ON c.next = l.word)
  SELECT word, last FROM c WHERE next IS NULL
)
SELECT l.word, l.form, c.last AS root, l.n, l.n_near, l.form_n FROM l JOIN c ON l.word = c.word
"""


def _secrets_sql() -> str:
    """Matches of every rule and what stands between them, as running lengths."""
    parts = []
    for i, rule in enumerate(secret_scan.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT row, {i} AS rule, '{rule.kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {rule.group})) AS v,
  unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS b, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i, {rule.least} AS least FROM d""")
    found = " UNION ALL\n".join(parts)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), f AS (
  {found}
), e AS (
  SELECT *, CAST(sum(length(b) + length(m)) OVER (PARTITION BY row, rule ORDER BY i) AS BIGINT) AS stop FROM f
), s AS (
  SELECT row, rule, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM e WHERE length(v) >= least
), g AS (
  SELECT row, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans FROM s GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row = g.row
"""


ORACLES["op12_secret_scan"] = _secrets_sql()

ORACLES["op13_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0
), tf AS (
  SELECT row, doc_id, any_value(n) AS n, t, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY row, doc_id, t
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY t
), q AS (
  SELECT item_id, t, count(*) AS uses FROM i GROUP BY ALL
), s AS (
  SELECT item_id, row, doc_id, CAST(sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t), c GROUP BY item_id, row, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
