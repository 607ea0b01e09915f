"""Tables of SQL Server, PostgreSQL and MySQL through Spark's JDBC source.

The dialect decides the URL, the driver and how names are quoted. Catalog queries are plain
DataFrame reads of `information_schema`; Spark pushes projection and predicate to the server.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.inventory import COLUMN_INVENTORY


class Dialect(NamedTuple):
    url: str
    driver: str
    quote_open: str
    quote_close: str
    schema_is_database: bool = False


# fixed values: URL pattern, driver class and identifier quotes per database
DIALECTS = {
    "sqlserver": Dialect(
        "jdbc:sqlserver://{host};databaseName={database};trustServerCertificate=true",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver", "[", "]",
    ),
    "postgresql": Dialect("jdbc:postgresql://{host}/{database}", "org.postgresql.Driver", '"', '"'),
    "mysql": Dialect("jdbc:mysql://{host}/{database}", "com.mysql.cj.jdbc.Driver", "`", "`", True),
}


class Connection(NamedTuple):
    db_type: str
    host: str
    database: str
    user: str | None = None
    password: str | None = None
    integrated_security: bool = False

    @property
    def dialect(self) -> Dialect:
        if self.db_type not in DIALECTS:
            raise ValueError(f"unsupported database type: {self.db_type}")
        return DIALECTS[self.db_type]


def options(connection: Connection, **extra) -> dict[str, str]:
    """Options of the JDBC reader for one connection."""
    dialect = connection.dialect
    url = dialect.url.format(host=connection.host, database=connection.database)
    result = {"driver": dialect.driver, "fetchsize": "10000"}
    if connection.integrated_security:
        if connection.db_type != "sqlserver":
            raise ValueError("integrated security is a SQL Server feature")
        url += ";integratedSecurity=true"
    else:
        result.update({k: v for k, v in (("user", connection.user), ("password", connection.password)) if v is not None})
    return {"url": url, **result, **{k: str(v) for k, v in extra.items()}}


def quoted_table(connection: Connection, schema: str, table: str) -> str:
    """The table's full name; MySQL has no schema below the database."""
    dialect = connection.dialect
    closing = dialect.quote_close

    def name(part: str) -> str:
        return dialect.quote_open + part.replace(closing, closing * 2) + closing

    return name(table) if dialect.schema_is_database else f"{name(schema)}.{name(table)}"


def table_options(
    connection: Connection,
    schema: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    num_partitions: int | None = None,
    in_one_task: bool = False,
) -> dict[str, str]:
    """Options for one table, read in parallel ranges of `partition_column`.

    Spark reads a table without ranges in a single task, whatever its size; `in_one_task` says
    that this is meant. Rows outside the bounds, and NULLs, belong to the outer ranges.
    """
    extra = {"dbtable": quoted_table(connection, schema, table)}
    if not in_one_task:
        if partition_column is None or bounds is None or not num_partitions:
            raise ValueError("a parallel read needs a partition column, its bounds and the number of ranges")
        extra.update(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=num_partitions
        )
    return options(connection, **extra)


def bounds_options(connection: Connection, schema: str, table: str, column: str) -> dict[str, str]:
    """Options for the one-row query of a column's bounds, `low` and `high`, which the server computes."""
    name = connection.dialect.quote_open + column.replace(connection.dialect.quote_close, connection.dialect.quote_close * 2)
    name += connection.dialect.quote_close
    source = quoted_table(connection, schema, table)
    return options(connection, query=f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {source}")


def row_count_options(connection: Connection, schema: str, table: str) -> dict[str, str]:
    """Options for a count that the server computes."""
    return options(connection, query=f"SELECT COUNT(*) AS row_count FROM {quoted_table(connection, schema, table)}")


def read(spark: SparkSession, jdbc_options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options).load()


def _catalog_schema(connection: Connection, schema: str) -> str:
    return connection.database if connection.dialect.schema_is_database else schema


def _lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def tables(spark: SparkSession, connection: Connection, schema: str) -> DataFrame:
    """Base tables of a schema by name."""
    catalog = _lower_names(read(spark, options(connection, dbtable="information_schema.tables")))
    wanted = (F.col("table_schema") == _catalog_schema(connection, schema)) & (F.col("table_type") == "BASE TABLE")
    return catalog.where(wanted).select("table_name")


def catalog_columns(catalog: DataFrame, schema: str) -> DataFrame:
    """Rows of `information_schema.columns` as a column inventory."""
    length = F.col("character_maximum_length")
    sources = {
        "table_name": F.col("table_name"),
        "column_name": F.col("column_name"),
        "data_type": F.col("data_type"),
        "max_length": F.when(length > 2147483647, F.lit(-1)).otherwise(length),
        "numeric_precision": F.col("numeric_precision"),
        "numeric_scale": F.col("numeric_scale"),
        "is_nullable": F.col("is_nullable") == "YES",
        "ordinal_position": F.col("ordinal_position"),
    }
    return catalog.where(F.col("table_schema") == schema).select(
        *[sources[f.name].cast(f.dataType).alias(f.name) for f in COLUMN_INVENTORY.fields]
    )


def columns(spark: SparkSession, connection: Connection, schema: str) -> DataFrame:
    """Column inventory of all tables of a schema."""
    catalog = _lower_names(read(spark, options(connection, dbtable="information_schema.columns")))
    return catalog_columns(catalog, _catalog_schema(connection, schema))
