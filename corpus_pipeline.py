"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame, which
is written as Parquet and read again as the next one's `docs`. All but the last return the columns
of `documents`. The rows of `docs` must come straight from files, as they do here.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from evenkeel.llm.common import importable, table
from evenkeel.session import staged

# A classifier, bitmaps exchanged between tasks, components of a graph and a recursive query: not SQL over the tables.
ORACLE_SQL = None

SHINGLE_WORDS = 5
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    importable(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = "quality_score"
    while score in docs.columns:
        score += "_"
    return quality.with_score(docs, model, into=score).where(f"{score} >= 0.5").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    importable(spark)
    return exact_dedup.drop_duplicates(docs, reread=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Unlike op8, which has its own numbers, this links documents by 5-word shingles from 80 % on.
    """
    importable(spark)
    return ngram_join.one_of_each(docs, n=SHINGLE_WORDS, percent=NEAR_PERCENT)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    importable(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["doc_id"], with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
