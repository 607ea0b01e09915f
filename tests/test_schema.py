import pytest
from pyspark.sql import types as T

from evenkeel.operators.keys import candidate_keys, key_check
from evenkeel.operators.schema_diff import (
    column_presence,
    one_sided_sample,
    schema_diff,
    schema_diff_database,
    schema_gap,
    schema_sync_plan,
)
from evenkeel.sources import inventory as inv
from tests.conftest import rows

INT, LONG = T.IntegerType(), T.LongType()


def schema(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SOURCE = schema(("id", INT, False), ("name", T.VarcharType(100), True), ("email", T.VarcharType(255), True))
MISSING = schema(("id", INT, False), ("name", T.VarcharType(100), True))
EXTRA = schema(*[(f.name, f.dataType, f.nullable) for f in SOURCE], ("phone", T.VarcharType(20), True))
CHANGED = schema(("id", LONG, False), ("name", T.VarcharType(50), True), ("email", T.VarcharType(255), False))


def diff(spark, source, target):
    return schema_diff(inv.declared_columns(spark, source, "users"), inv.declared_columns(spark, target, "users"))


def test_identical(spark):
    assert diff(spark, SOURCE, SOURCE).count() == 0


def test_missing_extra_changed(spark):
    columns = ["column_name", "difference_type", "source_value", "target_value", "severity"]
    assert rows(diff(spark, SOURCE, MISSING), *columns) == [("email", "schema_only_source", "varchar(255)", None, "error")]
    assert rows(diff(spark, SOURCE, EXTRA), *columns) == [("phone", "schema_only_target", None, "varchar(20)", "error")]
    assert rows(diff(spark, SOURCE, CHANGED), *columns) == [
        ("email", "schema_different", "varchar(255)", "varchar(255)", "warning"),
        ("id", "schema_different", "int", "bigint", "warning"),
        ("name", "schema_different", "varchar(100)", "varchar(50)", "warning"),
    ]


def test_names_match_case_sensitively(spark):
    kinds = rows(diff(spark, schema(("Id", INT, False)), schema(("id", INT, False))), "column_name", "difference_type")
    assert kinds == [("Id", "schema_only_source"), ("id", "schema_only_target")]


@pytest.mark.parametrize("record, expected", [
    (("varchar", 100, None, None), "varchar(100)"), (("nvarchar", -1, None, None), "nvarchar(MAX)"),
    (("decimal", None, 18, 2), "decimal(18,2)"), (("float", None, 53, None), "float(53)"), (("int", None, None, None), "int"),
])
def test_full_type(spark, record, expected):
    name, length, precision, scale = record
    df = spark.createDataFrame([("t", "c", name, length, precision, scale, True, 1)], inv.COLUMN_INVENTORY)
    assert df.select(inv.full_type().alias("v")).first().v == expected


def test_declared_types(spark):
    df = inv.declared_columns(spark, schema(("a", T.DecimalType(18, 2), False), ("b", T.CharType(3), True)), "t")
    assert rows(df.select("column_name", inv.full_type().alias("t"), "is_nullable")) == [("a", "decimal(18,2)", False), ("b", "char(3)", True)]


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "x", None)], "a INT, b STRING, c STRING")
    found = inv.column_profile(df, "t")
    assert rows(found, "column_name", "max_length", "is_nullable") == [("a", None, False), ("b", 3, False), ("c", None, True)]


def test_database_diff(spark):
    source = inv.declared_columns(spark, SOURCE, "users").union(inv.declared_columns(spark, SOURCE, "old"))
    target = inv.declared_columns(spark, MISSING, "users").union(inv.declared_columns(spark, SOURCE, "new"))
    columns = ["table_name", "difference_type", "column_name", "description"]
    assert rows(schema_diff_database(source, target), *columns) == [
        ("new", "schema_only_target", None, "Table exists only in target database"),
        ("old", "schema_only_source", None, "Table exists only in source database"),
        ("users", "schema_only_source", "email", "Column exists only in source"),
    ]
    assert rows(schema_diff_database(source, target, ["old"]), "table_name") == [("old",)]


def test_sync_plan(spark):
    source = inv.declared_columns(spark, SOURCE, "users").union(inv.declared_columns(spark, SOURCE, "old"))
    target = inv.declared_columns(spark, schema(("id", LONG, False), ("name", T.VarcharType(100), True), ("x`y", INT, True)), "users")
    plan = schema_sync_plan(schema_diff_database(source, target), "dbo.users")
    assert rows(plan, "action", "statement") == [
        ("add_column", "ALTER TABLE `dbo`.`users` ADD COLUMN `email` varchar(255)"),
        ("alter_column", "ALTER TABLE `dbo`.`users` ALTER COLUMN `id` TYPE int"),
        ("create_table", "-- Table missing in target: old"),
        ("drop_column", "-- ALTER TABLE `dbo`.`users` DROP COLUMN `x``y`"),
    ]


def test_gap_and_presence(spark):
    assert schema_gap(SOURCE, CHANGED) == ["id", "name"]
    presence = column_presence(inv.declared_columns(spark, SOURCE, "u"), inv.declared_columns(spark, EXTRA, "u"))
    assert rows(presence, "column_name", "full_type") == [("phone", "varchar(20)")]


def test_one_sided_sample(spark):
    df = spark.createDataFrame([(i, str(i), i) for i in range(20, 0, -1)], "id INT, extra STRING, more INT")
    assert [tuple(r) for r in one_sided_sample(df, df.select("id"), ["id"], 2).collect()] == [("1", 1), ("2", 2)]
    with pytest.raises(ValueError):
        one_sided_sample(df, df, ["id"])


def test_table_choice(spark):
    tables = spark.createDataFrame([("dim_a", 10), ("DIM_b", 0), ("fact_x", 99), ("x_link", 5)], "table_name STRING, row_count BIGINT")
    assert rows(inv.eligible_tables(tables, "dim", exclude_empty=True), "table_name") == [("dim_a",)]
    assert rows(inv.eligible_tables(tables, min_rows=5, max_rows=10), "table_name") == [("dim_a",), ("x_link",)]
    assert rows(inv.select_tables(tables, preset="dim_*"), "table_name") == [("DIM_b",), ("dim_a",)]
    assert rows(inv.select_tables(tables, "X$"), "table_name") == [("fact_x",)]
    assert inv.select_tables(tables, preset="All").count() == 4
    flagged = inv.with_restricted_flag(tables).where("is_restricted")
    assert rows(flagged, "table_name") == [("fact_x",), ("x_link",)]
    assert inv.check_selection(["fact_x"]) == ["fact_x"]
    with pytest.raises(ValueError):
        inv.check_selection(["fact_x", "dim_a"])


def test_profile_of_missing_things(spark, folder):
    with pytest.raises(Exception):
        inv.table_inventory(spark, {"gone": f"{folder}/gone.parquet"})
    with pytest.raises(ValueError):
        inv.table_profile(spark.range(3).toDF("a"), "t", ["b"])


def test_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 3)], "a INT, b INT")
    row = key_check(df, ["a", "b"]).first()
    assert (row.row_count, row.distinct_keys, row.duplicate_keys, row.null_key_rows, row.is_unique) == (4, 3, 1, 2, False)
    assert rows(candidate_keys(df.limit(3), [["b"], ["a", "b"]]), "key_columns", "is_candidate") == [("a, b", False), ("b", True)]
    empty = key_check(df.limit(0), ["a"]).first()
    assert (empty.row_count, empty.is_unique) == (0, True)


def test_equal_definitions_with_different_data_do_not_differ(spark):
    short, long = (spark.createDataFrame([(v,)], "v STRING") for v in ("abc", "abcdef"))
    assert schema_diff(inv.declared_columns(spark, short, "t"), inv.declared_columns(spark, long, "t")).count() == 0


def test_every_statement_of_the_sync_plan_parses(spark):
    source = "a STRING, b DECIMAL(12,3), c ARRAY<STRUCT<x: INT>>, `d d` TIMESTAMP_NTZ, e VARCHAR(20), f BIGINT"
    target = "a INT, b DECIMAL(10,2), g STRING, e VARCHAR(10), f BIGINT"
    inventories = [inv.declared_columns(spark, T._parse_datatype_string(s), "dbo.t") for s in (source, target)]
    plan = schema_sync_plan(schema_diff(*inventories), "dbo.t").collect()
    assert {r.action for r in plan} == {"add_column", "alter_column", "drop_column"}
    parser = spark._jsparkSession.sessionState().sqlParser()
    for r in plan:
        parser.parsePlan(r.statement.removeprefix("-- "))
