"""The rows that bring a target in line with its source, and applying them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.columns import quoted, ref, same_keys
from evenkeel.operators.row_diff import DIFFERENT, MATCH, ONLY_SOURCE, key_states
from evenkeel.session import staged
from evenkeel.sources.versions import Versions


def change_set(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT, UPDATE and DELETE rows: `op`, the key, and the new values (NULL for DELETE).

    The changed keys are written out first, when this is called, so that the source rows are picked by broadcast
    when the keys are few and by a shuffle join when they are many.
    """
    kind = F.col("difference_type")
    op = F.when(kind == ONLY_SOURCE, "INSERT").when(kind == DIFFERENT, "UPDATE").otherwise("DELETE")
    changed = staged(
        key_states(source, target, keys).where(kind != MATCH).select(op.alias("op"), *[ref(k) for k in keys]),
        "changed-keys",
        few_files=True,
    )
    values = [c for c in source.columns if c not in keys]
    written = changed.where("op <> 'DELETE'").alias("c")
    rows = source.alias("s").join(
        written, [F.col(f"s.{quoted(k)}").eqNullSafe(F.col(f"c.{quoted(k)}")) for k in keys], "inner"
    )
    upserts = rows.select("c.op", *[F.col(f"s.{quoted(c)}") for c in [*keys, *values]])
    deletes = changed.where("op = 'DELETE'").select(
        "op",
        *[ref(k).cast(source.schema[k].dataType).alias(k) for k in keys],
        *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in values],
    )
    return upserts.unionByName(deletes)


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: how many rows each operation touches."""
    return changes.agg(
        *[F.count_if(F.col("op") == op).alias(f"{op.lower()}s") for op in ("INSERT", "UPDATE", "DELETE")]
    )


def apply_change_set(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The target after the change set. Columns that only the target has keep their values in
    updated rows and are NULL in inserted ones. Write it to a new path, never over the one
    being read. The change set is written out when this is called."""
    changes = staged(changes, "changes")
    kept = target.join(changes.select(*[ref(k) for k in keys]), same_keys(target, changes, keys), "left_anti")
    written = changes.where("op <> 'DELETE'").drop("op")
    own = [c for c in target.columns if c not in written.columns]
    if own:
        before = target.select(*[ref(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[ref(c) for c in own])
        same = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
        written = written.join(before, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])
    return kept.unionByName(written, allowMissingColumns=True)


def merge_statement(source_table: str, target_table: str, keys: list[str], columns: list[str]) -> str:
    """`MERGE INTO` for catalogs whose tables support it; parquet tables use `apply_change_set`."""

    def name(table: str) -> str:
        return ".".join(quoted(part) for part in table.split("."))

    on = " AND ".join(f"t.{quoted(k)} <=> s.{quoted(k)}" for k in keys)
    return (
        f"MERGE INTO {name(target_table)} t USING {name(source_table)} s ON {on}\n"
        f"WHEN MATCHED THEN UPDATE SET {', '.join(f't.{quoted(c)} = s.{quoted(c)}' for c in columns)}\n"
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(quoted(c) for c in columns)}) "
        f"VALUES ({', '.join(f's.{quoted(c)}' for c in columns)})\n"
        "WHEN NOT MATCHED BY SOURCE THEN DELETE"
    )


def apply_to_files(table: Versions, changes: DataFrame, keys: list[str]) -> int:
    """Apply a change set to a versioned table; the number of the new version, or of the latest without changes.

    Only files that hold a changed key are rewritten, and inserted rows become new files; all other files
    keep their names and are not read beyond their key columns. If another writer changes one of these
    files meanwhile, `Conflict` is raised and the table is as that writer left it.
    """
    base = table.latest()
    changes = staged(changes, "changes")
    if not changes.limit(1).count():
        return base
    rows = table.placed(base)
    present = changes.where("op <> 'INSERT'").select(*[ref(k) for k in keys])
    held = rows.join(present, same_keys(rows, present, keys), "left_semi").select("_file").distinct()
    touched = [r["_file"] for r in held.collect()]  # names of files
    return table.replace(
        lambda old: apply_change_set(old, changes, keys).select(*[ref(c) for c in rows.columns if c != "_file"]), touched, operation="apply changes"
    )
