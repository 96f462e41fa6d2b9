"""Queries that compare two versions of a table over all of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep import Pipeline, Step, changed_cells, changed_columns
from tableprep.operators.preview import column_diffs
from workload.registry import register
from workload.step_queries import STEPS
from workload.tables import dirty_orders, flat, read, sql

# Changes: the priority of the row with the largest key, and the status of the orders of the last day.
EDITED = """later AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
      CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority,
      CASE WHEN o_orderdate = (SELECT max(o_orderdate) FROM orders) THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders)"""
COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"]


def versions(spark, folder, *edits):
    before = read(spark, folder, "orders").select(*COLUMNS)
    last = before.agg(F.max("o_orderkey").alias("key"), F.max("o_orderdate").alias("day")).first()
    changes = {
        "o_orderpriority": F.when(F.col("o_orderkey") == last["key"], F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")),
        "o_orderstatus": F.when(F.col("o_orderdate") != F.lit(last["day"]), F.col("o_orderstatus")),
    }
    return before, before.withColumns({n: changes[n] for n in edits})


def _columns(spark, folder):
    # The other version is in another order, and over other partitions.
    before, after = versions(spark, folder, "o_orderpriority")
    found = changed_columns(before, after.repartition(7, "o_custkey"), ["o_orderkey"])
    return found.select("column_name", "status", "before_rows", "after_rows", "before_present", "after_present")


_SIDE = "SELECT '{c}' AS column_name, CASE WHEN count(CASE WHEN o.{c} IS DISTINCT FROM l.{c} THEN 1 END) > 0 THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS before_rows, count(*) AS after_rows, count(o.{c}) AS before_present, count(l.{c}) AS after_present FROM orders o JOIN {later} l USING (o_orderkey)"
_LATER = "(SELECT * REPLACE (CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority) FROM orders)"
register("changed_columns", _columns, " UNION ALL ".join(_SIDE.format(c=c, later=_LATER) for c in COLUMNS))


def _cells(spark, folder):
    found = changed_cells(*versions(spark, folder, "o_orderpriority", "o_orderstatus"), ["o_orderkey"])
    return found.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "column_name", "value", "n_before", "n_after")


_PAIRS = "SELECT o_orderkey::BIGINT AS o_orderkey, '{c}' AS column_name, {side}.{c} AS value, {b}::BIGINT AS n_before, {a}::BIGINT AS n_after FROM orders JOIN later USING (o_orderkey) WHERE orders.{c} IS DISTINCT FROM later.{c}"
register(
    "changed_cells", _cells,
    f"WITH {EDITED} " + " UNION ALL ".join(
        _PAIRS.format(c=c, side=side, b=b, a=1 - b) for c in ("o_orderpriority", "o_orderstatus") for side, b in (("orders", 1), ("later", 0))),
)


def _whole(spark, folder):
    df = dirty_orders(spark, folder)
    fitted = Pipeline([STEPS[0], Step("drop_columns", ["o_custkey"], order_index=1)]).fit(df)
    return flat(column_diffs(df, fitted, compared_rows=None).select("column_name", "status", F.col("changed_sample_count").alias("changed_count")))


register(
    "column_diffs_all_rows", _whole,
    f"""WITH {sql('dirty_orders')}, facts AS (SELECT count(CASE WHEN o_orderpriority IN ('unknown', ' ? ') THEN 1 END) AS n FROM dirty_orders)
    SELECT 'o_orderpriority' AS column_name, 'changed' AS status, n AS changed_count FROM facts
    UNION ALL SELECT 'o_custkey', 'removed', NULL
    UNION ALL SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_totalprice']), 'unchanged', 0""",
)
