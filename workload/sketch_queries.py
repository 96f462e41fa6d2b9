"""Queries over mergeable profiles and profiles of growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprep.functions.columns import col
from tableprep.operators import sketches
from tableprep.operators.profile import profile_table
from tableprep.plans.scratch import scratch_path
from workload.registry import register
from workload.tables import dirty_orders, flat, sql

NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _bounds_kept(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per number column: whether its estimates are within the stated bounds of the exact values."""
    rows = [r.asDict() for r in profiles.filter(F.col("column_name").isin(NUMBERS)).collect()]
    aggs = []
    for r in rows:
        c, n = col(r["column_name"]), F.count(col(r["column_name"]))
        exact = F.count_distinct(c)
        kept = [F.abs(F.lit(r["unique_count"]) - exact) <= sketches.UNIQUE_ERROR * exact]
        for name, share in QUARTILES.items():
            below, upto = (F.coalesce(F.sum(w.cast("int")), F.lit(0)) / n for w in (c < r[name], c <= r[name]))
            kept.append((below <= share + sketches.RANK_ERROR) & (upto >= share - sketches.RANK_ERROR))
        aggs.append(F.struct(F.lit(r["column_name"]).alias("column_name"), kept[0].alias("unique_within"), (kept[1] & kept[2] & kept[3]).alias("quartiles_within")))
    return df.agg(F.array(*aggs).alias("kept")).select(F.inline("kept"))


def sketch_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The one-pass profile of the dirty orders, and whether the states of two halves add up to it."""
    df = dirty_orders(spark, folder)
    profiles = profile_table(df, exact=False)
    halves = [sketches.column_states(df.filter(F.col("o_orderkey") % 2 == i)) for i in (0, 1)]
    merged = sketches.profile_of_states(sketches.merge_states(halves[0].unionByName(halves[1])))
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-9 * F.abs(F.col(f"a.{c}")) + 1e-12
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    equal = near("mean") & near("std") & near("skewness") & same("row_count") & same("missing_count") & same("min") & same("max") & same("inferred_type")
    pairs = profiles.alias("a").join(merged.alias("b"), "column_name").select("column_name", equal.alias("halves_equal"))
    found = profiles.join(_bounds_kept(df, profiles), "column_name").join(pairs, "column_name")
    return flat(found.select("column_name", "row_count", "missing_count", "mean", "std", "min", "max", "unique_within", "quartiles_within", "halves_equal"))


_SIDE = "SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing_count"
register(
    "sketch_profile", sketch_profile,
    f"WITH {sql('dirty_orders')} " + " UNION ALL ".join(
        _SIDE.format(c=c) + f""", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        TRUE AS unique_within, TRUE AS quartiles_within, TRUE AS halves_equal FROM dirty_orders""" for c in NUMBERS),
)


def incremental_profile(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of orders grows by a half; the second profile reads the new files alone and equals that of the whole."""
    df, rows, store = dirty_orders(spark, folder).drop("__tp_row"), scratch_path(spark, "growing"), scratch_path(spark, "states")
    merged = None
    for run in (0, 1):
        df.filter(F.col("o_orderkey") % 2 == run).write.mode("append").parquet(rows)
        merged = sketches.append_states(spark, spark.read.parquet(rows), store, f"run{run}")
    again = sketches.append_states(spark, spark.read.parquet(rows), store, "run2")
    states = spark.read.parquet(store)
    files = states.select(F.explode("files").alias("file"))
    once = files.agg(F.count("*") == F.count_distinct("file")).first()[0] and states.select("run_id").distinct().count() == 2
    read = states.groupBy("column_name").agg(F.max(F.when(F.col("run_id") == "run1", F.col("row_count"))).alias("rows_of_second_run"))
    whole = sketches.profile_of_states(merged)
    found = whole.join(read, "column_name").join(_bounds_kept(df, whole), "column_name", "left")
    same = again.agg(F.sum("row_count")).first()[0] == merged.agg(F.sum("row_count")).first()[0]
    return flat(found.select(
        "column_name", "row_count", "rows_of_second_run", "missing_count", "mean", "min", "max", F.coalesce("unique_within", F.lit(True)).alias("unique_within"),
        F.coalesce("quartiles_within", F.lit(True)).alias("quartiles_within"), F.lit(bool(once and same)).alias("files_read_once"),
    ))


register(
    "incremental_profile", incremental_profile,
    f"WITH {sql('dirty_orders')} " + " UNION ALL ".join(
        _SIDE.format(c=c) + f""", count(*) FILTER (o_orderkey % 2 = 1) AS rows_of_second_run, {f'round(avg({c}), 6)' if c in NUMBERS else 'NULL::DOUBLE'} AS mean,
        {f'min({c})::DOUBLE' if c in NUMBERS else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if c in NUMBERS else 'NULL::DOUBLE'} AS max,
        TRUE AS unique_within, TRUE AS quartiles_within, TRUE AS files_read_once FROM dirty_orders"""
        for c in [*NUMBERS, "o_orderstatus", "o_orderdate", "o_orderpriority"]),
)
