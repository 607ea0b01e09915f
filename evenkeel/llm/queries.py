"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import (
    bpe, dac, decontaminate, exact_dedup, hard_negatives, html_extract, language, ngram_join, pii, prefix_trie, quality,
    secrets, sharding,
)
from evenkeel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and test item that it contains; other documents have none."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, folder, "documents"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.expr("crc32(string(doc_id)) % 3 = 1"), F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"), reread=True)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(table(spark, folder, "documents"))


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents"))


def op9_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        vocabulary = file.read()
    return dac.documents(spark, dac.write(table(spark, folder, "documents"), vocabulary, end=2))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.expr("crc32(string(doc_id)) % 5 = 0"), F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.fit(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return language.identify(docs, model, ["doc_id", "held_out"])


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_nodes(table(spark, folder, "conversations"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.text_shards(table(spark, folder, "documents"), 40)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined(table(spark, folder, "embeddings"))


for _query in (
    op1_decontamination, op2_html_extraction, op3_secrets, op4_byte_bpe, op5_quality, op6_exact_dedup, op7_pii,
    op8_ngram_join, op9_token_ids, op10_language, op11_prefix_trie, op12_sharding, op13_hard_negatives,
):
    QUERIES[_query.__name__] = _query

ORACLES["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""

ORACLES["op11_prefix_trie"] = r"""
WITH t AS (
    SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS whole, coalesce(text, '') AS txt,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
heads AS (
    SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda sum, byte: list_reduce([xor(sum, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))
    )) % 4 AS h FROM ids),
rebuilt AS (
    SELECT heads.c, t.pos, t.whole, t.txt FROM heads JOIN t ON t.c = heads.base AND t.pos < h
    UNION ALL SELECT heads.c, t.pos + 10, t.whole, t.txt FROM heads JOIN t ON t.c = heads.c AND t.pos >= h),
steps AS (
    SELECT c, txt, row_number() OVER w AS depth, string_agg(sha256(whole), '') OVER w AS prefix
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY pos)),
lengths AS (SELECT c, max(depth) AS n FROM steps GROUP BY c),
members AS (SELECT c, depth, prefix, txt FROM steps UNION ALL SELECT c, 0, '', '' FROM ids),
nodes AS (
    SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * len(regexp_extract_all(any_value(txt), '[^ \t-\r]+')) AS saved,
        coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE depth = coalesce(n, 0)), '') AS ends
    FROM members m LEFT JOIN lengths USING (c) GROUP BY prefix, depth),
kids AS (SELECT left(prefix, (64 * (depth - 1))::BIGINT) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
tree AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
below AS (
    SELECT a.prefix, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
    FROM tree a JOIN tree b ON starts_with(b.prefix, a.prefix) GROUP BY a.prefix)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM tree v JOIN below USING (prefix) LEFT JOIN tree p ON v.depth > 0 AND p.prefix = left(v.prefix, (64 * (v.depth - 1))::BIGINT)"""

ORACLES["op13_hard_negatives"] = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id),
positives AS (
    SELECT a, b, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
negatives AS (
    SELECT p.a AS anchor_id, p.b AS positive_id, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank
    FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT * FROM negatives WHERE rank <= 10"""
