"""A filter of hashes, bounded whatever the input, that leaves rows where they are that are not looked for.

It is a Bloom filter in blocks: the first hash chooses one of 2 ** BLOCK_BITS rows of four 64-bit words, and the second
one bit in each word. At most 2 ** BLOCK_BITS rows of 40 bytes are broadcast. With 10^7 hashes in it four of
10,000 other rows pass, with 10^8 a third, with 10^9 nearly all, so what passes is compared exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.columns import quoted
from evenkeel.session import staged

BLOCK_BITS = 20
WORDS = 4


def _block(first: str) -> Column:
    return F.expr(f"shiftrightunsigned({quoted(first)}, {64 - BLOCK_BITS})")


def _bit(second: str, word: int) -> str:
    """The place of a hash's bit in a word."""
    return f"CAST(shiftrightunsigned({quoted(second)}, {6 * word}) & 63 AS INT)"


def hash_filter(hashes: DataFrame, first: str, second: str) -> DataFrame:
    """The filter of the pairs of hashes in two columns, written out: `_block` and its words."""
    bits = [F.expr(f"shiftleft(1L, {_bit(second, w)})").alias(f"_word{w}") for w in range(WORDS)]
    words = hashes.select(_block(first).alias("_block"), *bits).groupBy("_block")
    return staged(words.agg(*[F.bit_or(f"_word{w}").alias(f"_word{w}") for w in range(WORDS)]), "hash-filter", few_files=True)


def passing(rows: DataFrame, first: str, second: str, words: DataFrame) -> DataFrame:
    """The rows whose two hashes may be in the filter: all that it was made of, and a share of others."""
    found = rows.withColumn("_block", _block(first)).join(F.broadcast(words), "_block")
    every = " AND ".join(f"getbit(_word{w}, {_bit(second, w)}) = 1" for w in range(WORDS))
    return found.where(every).select(*[F.col(quoted(c)) for c in rows.columns])
