"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); the root is the smallest node of its component.

    Every round takes the smallest root among a node and its neighbours, then the root of that
    root, so paths shrink by more than half. Each round is written to the shared folder. A node
    with very many edges is combined per task before it is shuffled. Null ends and loops are ignored.
    """
    plain = edges.select("a", "b").where("a <> b")
    both = staged(plain.union(plain.select("b", "a")).distinct(), "cc-edges")
    roots = staged(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")),
        "cc-roots",
    )
    while True:
        nearby = (
            both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
            .withColumnRenamed("a", "node")
        )
        hooked = roots.join(nearby, "node").select("node", "root", F.least("root", "near").alias("next"))
        above = roots.select(F.col("node").alias("next"), F.col("root").alias("over"))
        # a root is a node of the same component, so it has a row of its own
        jumped = hooked.join(above, "next").select("node", "root", F.least("next", "over").alias("next"))
        done = staged(jumped, "cc-roots")
        changed = done.where("next <> root").limit(1).count()
        roots = done.select("node", F.col("next").alias("root"))
        if not changed:
            return roots
