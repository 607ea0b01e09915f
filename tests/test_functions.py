import pytest
from pyspark.sql import functions as F

from evenkeel.functions import text as X
from evenkeel.functions.predicates import ColumnFilter, apply_filters
from evenkeel.functions.ranking import top_per_group, with_rank
from evenkeel.operators.comparable import comparable_columns, kept_columns, normalised
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("value, expected", [
    (0, "0.00 B"), (512, "512.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1048576, "1.00 MB"),
    (1073741824, "1.00 GB"), (1099511627776, "1.00 TB"), (2.0**50, "1.00 PB"), (2.0**61, "2048.00 PB"),
])
def test_format_bytes(spark, value, expected):
    assert one(spark, X.format_bytes(F.lit(value))) == expected


@pytest.mark.parametrize("value, expected", [(0, "0"), (999, "999"), (1000, "1,000"), (1234567, "1,234,567"), (-1234, "-1,234")])
def test_format_number(spark, value, expected):
    assert one(spark, X.format_number(F.lit(value))) == expected


@pytest.mark.parametrize("value, total, expected", [(75, 100, "75.0%"), (0, 0, "0.0%"), (1, 3, "33.3%"), (1, 400, "0.2%")])
def test_format_percentage(spark, value, total, expected):
    assert one(spark, X.format_percentage(F.lit(value), F.lit(total))) == expected


@pytest.mark.parametrize("seconds, expected", [
    (30.5, "30.5s"), (59.96, "60.0s"), (60, "1m 0s"), (125, "2m 5s"), (7325, "2h 2m"), (86399, "23h 59m"), (90000, "1d 1h"),
])
def test_format_duration(spark, seconds, expected):
    assert one(spark, X.format_duration(F.lit(seconds))) == expected


def test_names_and_truncation(spark):
    assert one(spark, X.format_table_name("dbo", "Users")) == "[dbo].[Users]"
    assert one(spark, X.truncate(F.lit("This is a very long string"), 15)) == "This is a ve..."
    assert one(spark, X.truncate(F.lit("short"), 15)) == "short"
    assert one(spark, X.truncate(F.lit("abcdefgh"), 5, "..")) == "abc.."
    assert one(spark, X.shortened(F.lit("abcdefgh"), 5)) == "abcde..."
    assert one(spark, X.source_name(F.lit(""), F.lit(None).cast("string"))) == "Unknown (Unknown)"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Anna"), (2, "bob"), (3, None), (4, "annabel")], "id INT, name STRING")


@pytest.mark.parametrize("condition, expected", [
    (ColumnFilter("id", "eq", 2), [2]), (ColumnFilter("name", "ne", "bob"), [1, 4]), (ColumnFilter("id", "gt", 2), [3, 4]),
    (ColumnFilter("id", "gte", 2), [2, 3, 4]), (ColumnFilter("id", "lt", 2), [1]), (ColumnFilter("id", "lte", 2), [1, 2]),
    (ColumnFilter("id", "in", [1, 4]), [1, 4]), (ColumnFilter("id", "in", 1), [1]), (ColumnFilter("id", "not_in", [1, 4]), [2, 3]),
    (ColumnFilter("name", "like", "ann%"), [1, 4]), (ColumnFilter("name", "like", "ann"), []),
    (ColumnFilter("name", "not_like", "ann%"), [2]), (ColumnFilter("name", "is_null"), [3]),
    (ColumnFilter("name", "is_not_null"), [1, 2, 4]), (ColumnFilter("id", "between", 2, 3), [2, 3]),
    (ColumnFilter("name", "regex", "b|A"), [1, 2]), (ColumnFilter("gone", "eq", 1), [1, 2, 3, 4]),
])
def test_filters(people, condition, expected):
    assert [r.id for r in apply_filters(people, [condition], ["id"]).collect()] == expected


def test_filter_errors_and_limits(people):
    with pytest.raises(ValueError):
        apply_filters(people, [ColumnFilter("id", "near", 1)])
    assert [r.id for r in apply_filters(people, [], row_limit=2).collect()] == [1, 2]
    assert [r.id for r in apply_filters(people, [], ["name"], 1).collect()] == [3]


def test_filters_reach_the_scan(spark, folder, capsys):
    df = apply_filters(spark.read.parquet(f"{folder}/lineitem.parquet"), [ColumnFilter("l_quantity", "gt", 40)])
    df.select("l_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_column_choice(spark):
    assert kept_columns(["a", "b", "c", "d"], include=["a", "b", "c"], exclude=["b"], globally_excluded=["a"]) == ["c"]
    df = spark.createDataFrame([], "id INT, last_update_count INT, created_by STRING, at TIMESTAMP, day DATE, v STRING")
    assert comparable_columns(df) == ["id", "day", "v"]
    assert "created_by" in comparable_columns(df, ["date"])


def test_normalised(spark):
    df = spark.createDataFrame([(1, " Ab ", "2024-01-02 03:04:05")], "id INT, v STRING, at STRING").selectExpr("id", "v", "CAST(at AS TIMESTAMP) AS at")
    assert rows(normalised(df, True, True, "dd.MM.yyyy")) == [(1, "ab", "02.01.2024")]
    assert rows(normalised(df, True, True, columns=["id"]).select("v")) == [(" Ab ",)]


def test_rank_over_many_partitions(spark):
    df = spark.range(0, 5000, numPartitions=11).select("id", (F.col("id") * 7919 % 997).alias("score"))
    ranked = with_rank(df, [F.col("score").desc(), F.col("id")])
    expected = {r[0]: i for i, r in enumerate(sorted(((r.id, r.score) for r in df.collect()), key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r["rank"] for r in ranked.collect()} == expected


def test_top_per_group_with_a_hot_group(spark):
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    df = spark.range(0, 9000, numPartitions=9).select(group.alias("g"), F.col("id"), (F.col("id") * 31 % 1009).alias("v"))
    got = {}
    for r in top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 7).collect():
        got.setdefault(r.g, {})[r["rank"]] = r.id
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    assert got == {g: {i: x[1] for i, x in enumerate(sorted(v)[:7], 1)} for g, v in groups.items()}
