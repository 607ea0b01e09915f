"""Small tables for the operators, with everything that documents may hold."""

from __future__ import annotations

import random

CLASHES = "key string, sender int, pos string, block string, gram string, root string, host string, score string, ids string"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, partitions: int = 3):
    """Texts as documents 0, 1, ... with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or "")) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    df = spark.createDataFrame([tuple(r) + (None,) * 9 for r in rows], f"{SCHEMA}, {CLASHES}")
    return df.repartition(partitions) if rows else df


def edge_texts() -> list:
    """Null, empty and white-space texts, repeated rows, a long text and characters of all widths."""
    return [
        None, "", " ", "\n\t", "a", "a", "é", "日本 語 \U0001f600 text", prose(1, 30), prose(1, 30), prose(1, 30) + " ",
        prose(2, 20_000), "x" * 30_000, "1" * 5_000, (4, "a", "en", "s", 1), (None, "a", None, None, None),
        (2**60 + 1, prose(3, 9), None, "s", 3), (2**60 + 2, prose(3, 9), None, "s", 3),
    ]
