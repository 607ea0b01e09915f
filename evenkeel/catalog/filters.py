"""Scans, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.functions import predicates as P
from evenkeel.functions.predicates import ColumnFilter, apply_filters
from evenkeel.operators.comparable import project
from evenkeel.sources.fixtures import ctes, view
from evenkeel.sources.tables import scan


@query(
    "scan_select",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def _(spark, folder):
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    order = [F.col("o_totalprice").desc(), "o_orderkey"]
    return scan(view(spark, folder, "orders"), columns, "o_totalprice > 300000", order, 100)


@query("scan_full", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_quantity >= 45")
def _(spark, folder):
    lineitem = view(spark, folder, "lineitem")
    return scan(lineitem, ["l_orderkey", "l_shipdate", "l_quantity"], "l_quantity >= 45")


# name -> (table, filter, SQL condition)
SINGLE_FILTERS = {
    "filter_eq": ("orders", ColumnFilter("o_orderstatus", "eq", "F"), "o_orderstatus = 'F'"),
    "filter_ne": ("orders_t", ColumnFilter("o_totalprice", "ne", 1013.7), "o_totalprice <> 1013.7"),
    "filter_gt": ("lineitem", ColumnFilter("l_quantity", "gt", 40), "l_quantity > 40"),
    "filter_gte": ("lineitem", ColumnFilter("l_discount", "gte", 0.05), "l_discount >= 0.05"),
    "filter_lt": ("events", ColumnFilter("value", "lt", 5.0), "value < 5.0"),
    "filter_lte": ("part", ColumnFilter("p_size", "lte", 10), "p_size <= 10"),
    "filter_in": ("events", ColumnFilter("event_type", "in", ["click", "error"]), "event_type IN ('click', 'error')"),
    "filter_not_in": ("events", ColumnFilter("event_type", "not_in", "view"), "event_type NOT IN ('view')"),
    "filter_like": ("documents", ColumnFilter("text", "like", "%the%"), "text ILIKE '%the%'"),
    "filter_not_like": ("pages", ColumnFilter("url", "not_like", "%1%"), "url NOT ILIKE '%1%'"),
    "filter_is_null": ("orders_t", ColumnFilter("o_totalprice", "is_null"), "o_totalprice IS NULL"),
    "filter_is_not_null": ("orders_t", ColumnFilter("o_totalprice", "is_not_null"), "o_totalprice IS NOT NULL"),
    "filter_between": ("orders", ColumnFilter("o_custkey", "between", 100, 200), "o_custkey BETWEEN 100 AND 200"),
    "filter_regex": ("orders", ColumnFilter("o_orderpriority", "regex", "[1-3]-"), "regexp_matches(o_orderpriority, '^(?:[1-3]-)')"),
    "filter_date_range": (
        "orders",
        P.date_range("o_orderdate", "1996-01-01", "1996-12-31"),
        "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'",
    ),
}


def _register_filter(name, table_name, condition, sql):
    prefix = ctes(table_name) + "\n" if table_name.endswith("_t") else ""

    @query(name, f"{prefix}SELECT * FROM {table_name} WHERE {sql}")
    def _(spark, folder):
        return apply_filters(view(spark, folder, table_name), [condition])


for _name, (_table, _condition, _sql) in SINGLE_FILTERS.items():
    _register_filter(_name, _table, _condition, _sql)


@query(
    "filter_conjunction",
    """SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 AND l_shipdate IS NOT NULL
AND l_linestatus ILIKE 'f' AND l_linenumber IN (1, 2, 3)""",
)
def _(spark, folder):
    filters = [
        P.exact("l_returnflag", "R"),
        ColumnFilter("l_quantity", "gt", 10),
        P.non_null("l_shipdate"),
        P.pattern("l_linestatus", "f"),
        P.in_list("l_linenumber", [1, 2, 3]),
        ColumnFilter("no_such_column", "eq", 1),
    ]
    return apply_filters(view(spark, folder, "lineitem"), filters)


@query(
    "filter_limit_order",
    "SELECT * FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 50",
)
def _(spark, folder):
    return apply_filters(view(spark, folder, "events"), [P.exact("event_type", "purchase")], ["event_id"], 50)


@query("project_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, folder):
    return project(
        view(spark, folder, "orders"),
        include=["o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"],
        exclude=["o_totalprice"],
        globally_excluded=["o_custkey"],
    )
