"""Row, cell and set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.operators.comparable import comparable_columns, normalised
from evenkeel.operators.copartitioned import bucketed_cells, bucketed_counts, save_bucketed
from evenkeel.operators.keys import candidate_keys, column_sets, key_check, minimal_keys
from evenkeel.operators.row_diff import cell_diff, drill_down, row_diff_counts, row_diff_rows
from evenkeel.operators.set_diff import common_rows, except_rows, multiset_diff
from evenkeel.sources.fixtures import TABLES, ctes, view

ORDER_KEY = ["o_orderkey"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

JOINED = """joined AS (
  SELECT s.o_orderkey AS sk, t.o_orderkey AS tk,
    s.o_custkey IS NOT DISTINCT FROM t.o_custkey AND s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus
    AND s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND s.o_orderdate IS NOT DISTINCT FROM t.o_orderdate
    AND s.o_orderpriority IS NOT DISTINCT FROM t.o_orderpriority AS same
  FROM orders s FULL OUTER JOIN orders_t t ON s.o_orderkey = t.o_orderkey)"""

COUNTS = """SELECT count(sk) AS source_row_count, count(tk) AS target_row_count,
  count(*) FILTER (sk IS NOT NULL AND tk IS NOT NULL AND same) AS matching_rows,
  count(*) FILTER (sk IS NOT NULL AND tk IS NOT NULL AND NOT same) AS different_rows,
  count(*) FILTER (tk IS NULL) AS source_only_rows,
  count(*) FILTER (sk IS NULL) AS target_only_rows FROM joined"""


@query("row_diff_counts", ctes("orders_t", more=JOINED) + COUNTS)
def _(spark, folder):
    return row_diff_counts(view(spark, folder, "orders"), view(spark, folder, "orders_t"), ORDER_KEY)


@query(
    "row_diff_rows",
    ctes("orders_t", more=JOINED)
    + """SELECT coalesce(sk, tk) AS o_orderkey,
  CASE WHEN tk IS NULL THEN 'data_only_source' WHEN sk IS NULL THEN 'data_only_target' ELSE 'data_different' END AS difference_type,
  concat('o_orderkey=', coalesce(sk, tk)) AS key_display
FROM joined WHERE sk IS NULL OR tk IS NULL OR NOT same""",
)
def _(spark, folder):
    return row_diff_rows(view(spark, folder, "orders"), view(spark, folder, "orders_t"), ORDER_KEY)


def _cells_sql(columns: list[str], source: str = "orders", target: str = "orders_t", key: str = "o_orderkey") -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT s.{key}, concat('{key}=', s.{key}) AS key_display, '{c}' AS column_name,
  CAST(s.{c} AS VARCHAR) AS source_value, CAST(t.{c} AS VARCHAR) AS target_value
FROM {source} s JOIN {target} t ON s.{key} = t.{key} WHERE s.{c} IS DISTINCT FROM t.{c}"""
        for c in columns
    )


@query("cell_diff", ctes("orders_t") + _cells_sql(ORDER_COLUMNS[1:]))
def _(spark, folder):
    return cell_diff(view(spark, folder, "orders"), view(spark, folder, "orders_t"), ORDER_KEY)


@query(
    "drill_down",
    ctes("orders_t") + _cells_sql(["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
)
def _(spark, folder):
    return drill_down(view(spark, folder, "orders"), view(spark, folder, "orders_t"))


COMPARED = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("except_source", ctes("orders_t") + f"SELECT {COMPARED} FROM orders EXCEPT SELECT {COMPARED} FROM orders_t")
def _(spark, folder):
    source, target = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    return except_rows(source, target, comparable_columns(source))


@query("except_source_by_hash", ctes("orders_t") + f"SELECT {COMPARED} FROM orders EXCEPT SELECT {COMPARED} FROM orders_t")
def _(spark, folder):
    source, target = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    return except_rows(source, target, comparable_columns(source), by_hash=True)


@query("except_target", ctes("orders_t") + f"SELECT {COMPARED} FROM orders_t EXCEPT SELECT {COMPARED} FROM orders")
def _(spark, folder):
    source, target = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    return except_rows(target, source, comparable_columns(source))


@query(
    "multiset_diff",
    ctes(
        "lineitem_t",
        more="""gone AS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem_t),
added AS (SELECT * FROM lineitem_t EXCEPT ALL SELECT * FROM lineitem)""",
    )
    + """SELECT *, 'data_only_source' AS difference_type, count(*) AS copies FROM gone GROUP BY ALL
UNION ALL SELECT *, 'data_only_target', count(*) FROM added GROUP BY ALL""",
)
def _(spark, folder):
    return multiset_diff(view(spark, folder, "lineitem"), view(spark, folder, "lineitem_t"))


@query(
    "multiset_diff_by_hash",
    ctes(
        "lineitem_t",
        more="""gone AS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem_t),
added AS (SELECT * FROM lineitem_t EXCEPT ALL SELECT * FROM lineitem)""",
    )
    + """SELECT *, 'data_only_source' AS difference_type, count(*) AS copies FROM gone GROUP BY ALL
UNION ALL SELECT *, 'data_only_target', count(*) FROM added GROUP BY ALL""",
)
def _(spark, folder):
    return multiset_diff(view(spark, folder, "lineitem"), view(spark, folder, "lineitem_t"), by_hash=True)


@query(
    "multiset_counts",
    ctes(
        "lineitem_t",
        more="""gone AS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem_t),
added AS (SELECT * FROM lineitem_t EXCEPT ALL SELECT * FROM lineitem)""",
    )
    + """SELECT (SELECT count(*) FROM lineitem) AS source_row_count, (SELECT count(*) FROM lineitem_t) AS target_row_count,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM gone) AS matching_rows, CAST(0 AS BIGINT) AS different_rows,
  (SELECT count(*) FROM gone) AS source_only_rows, (SELECT count(*) FROM added) AS target_only_rows""",
)
def _(spark, folder):
    return row_diff_counts(
        view(spark, folder, "lineitem"),
        view(spark, folder, "lineitem_t"),
        ["l_orderkey", "l_linenumber"],
        on_duplicate="multiset",
    )


@query("row_intersection", ctes("orders_t") + "SELECT * FROM orders INTERSECT SELECT * FROM orders_t")
def _(spark, folder):
    return common_rows(view(spark, folder, "orders"), view(spark, folder, "orders_t"))


@query(
    "key_check",
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys,
  coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0)::BIGINT AS null_key_rows,
  count(*) FILTER (n > 1) = 0 AS is_unique FROM g""",
)
def _(spark, folder):
    return key_check(view(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "candidate_keys",
    """SELECT 'conv_id' AS key_columns, count(*) AS row_count, count(DISTINCT conv_id) AS distinct_keys,
  count(DISTINCT conv_id) = count(*) AS is_candidate FROM conversations
UNION ALL SELECT 'conv_id, turn', count(*), count(DISTINCT (conv_id, turn)), count(DISTINCT (conv_id, turn)) = count(*) FROM conversations
UNION ALL SELECT 'conv_id, role', count(*), count(DISTINCT (conv_id, role)), count(DISTINCT (conv_id, role)) = count(*) FROM conversations""",
)
def _(spark, folder):
    return candidate_keys(
        view(spark, folder, "conversations"), [["conv_id"], ["conv_id", "turn"], ["conv_id", "role"]]
    )


@query(
    "diff_normalised",
    """WITH joined AS (SELECT s.o_orderkey AS sk, t.o_orderkey AS tk,
    s.o_custkey = t.o_custkey AND lower(s.o_orderstatus) = t.o_orderstatus AND s.o_totalprice = t.o_totalprice
    AND s.o_orderdate = t.o_orderdate AND lower(s.o_orderpriority) = trim(t.o_orderpriority) AS same
  FROM orders s FULL OUTER JOIN (SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice,
    o_orderdate, concat('  ', lower(o_orderpriority), ' ') AS o_orderpriority FROM orders) t USING (o_orderkey))
"""
    + COUNTS,
)
def _(spark, folder):
    def side(name):
        return normalised(
            view(spark, folder, name), ignore_case=True, ignore_whitespace=True, date_format="yyyy-MM-dd"
        )

    return row_diff_counts(side("orders"), side("orders_padded"), ORDER_KEY)


@query(
    "comparable_columns",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def _(spark, folder):
    orders = view(spark, folder, "orders")
    return orders.select(*[F.col(c) for c in comparable_columns(orders)])


LINE_COLUMNS = [c.strip().split(" ")[0] for c in TABLES["lineitem"].split(",")]
LINE_SETS = column_sets(LINE_COLUMNS, 3)


def _distinct_sql(columns: tuple[str, ...]) -> str:
    """Whether a column set is unique; the columns of lineitem hold no NULL."""
    return f"SELECT '{', '.join(columns)}' AS key_columns, {len(columns)} AS width, [{', '.join(repr(c) for c in columns)}] AS s FROM (SELECT count(*) AS n FROM lineitem) JOIN (SELECT count(*) AS d FROM (SELECT DISTINCT {', '.join(columns)} FROM lineitem)) ON n = d"


@query(
    "minimal_keys",
    "WITH unique_sets AS ("
    + "\nUNION ALL ".join(_distinct_sql(s) for s in LINE_SETS)
    + ") SELECT key_columns, width FROM unique_sets a WHERE NOT EXISTS (SELECT 1 FROM unique_sets b WHERE b.width < a.width AND list_has_all(a.s, b.s))",
)
def _(spark, folder):
    """All minimal keys of up to three columns of a table without a declared key."""
    return minimal_keys(view(spark, folder, "lineitem"), 3)


def _bucketed(spark, folder):
    return [save_bucketed(view(spark, folder, name), ORDER_KEY, 16) for name in ("orders", "orders_t")]


@query("bucketed_counts", ctes("orders_t", more=JOINED) + COUNTS)
def _(spark, folder):
    return bucketed_counts(*_bucketed(spark, folder), ORDER_KEY)


@query("bucketed_cells", ctes("orders_t") + _cells_sql(ORDER_COLUMNS[1:]))
def _(spark, folder):
    return bucketed_cells(*_bucketed(spark, folder), ORDER_KEY)
