"""Result tables of runs: store, list, latest per key, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def store_results(results: DataFrame, run_id: str, path: str) -> None:
    """Append one run's rows to a result table partitioned by run."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def list_results(spark: SparkSession, path: str, run_id: str, *order_by: str) -> DataFrame:
    """Rows of one run in stored order; only that run's partition is read."""
    return spark.read.parquet(path).filter(F.col("run_id") == run_id).orderBy(*order_by)


def latest_per_key(df: DataFrame, keys: list[str], created_at: str, tie_break: str | None = None) -> DataFrame:
    """Newest record of each key; groups are pruned to one row per task before the shuffle."""
    order = [F.desc(created_at)] + ([F.desc(tie_break)] if tie_break else [])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__tp_rank", rank).filter(F.col("__tp_rank") == 1).drop("__tp_rank")


def newest_first(df: DataFrame, created_at: str, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.desc(created_at))
    return ordered.limit(limit) if limit else ordered


def run_history(tables: dict[str, DataFrame], created_at: dict[str, str], identity: dict[str, str], recent: int = 5) -> DataFrame:
    """Record count of each kind and its most recent records."""
    parts = []
    for kind, df in tables.items():
        count = df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(kind).alias("kind"), F.lit("count").alias("entry"), F.lit(0).cast("bigint").alias("rank"),
            F.col("value").cast("string").alias("value"),
        )
        newest = df.orderBy(F.desc(created_at[kind]), F.desc(identity[kind])).limit(recent)
        place = F.row_number().over(Window.orderBy(F.desc(created_at[kind]), F.desc(identity[kind])))
        shown = newest.select(
            F.lit(kind).alias("kind"), F.lit("recent").alias("entry"), place.cast("bigint").alias("rank"),
            F.col(identity[kind]).cast("string").alias("value"),
        )
        parts += [count, shown]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
