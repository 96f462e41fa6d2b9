"""The value-frequency table: one shuffle that feeds every category statistic."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import col, families
from tableprep.functions.text import as_text

_STORED_AS = {"long": "bigint", "double": "double", "time": "timestamp_ntz", "text": "string"}


def value_frequencies(
    df: DataFrame,
    columns: list[str],
    *,
    digest: Iterable[str] = (),
    carry: Iterable[str] = (),
    aggregates: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows ``(column_name, value, n)`` for the non-missing values of ``columns``.

    Columns are grouped in their own storage type and turned into text only
    after aggregation, so the cast runs once per distinct value. The count is
    pre-aggregated before the shuffle, so a hot value costs one row per task.
    Columns in ``digest`` are keyed by SHA-256 instead of their text: enough to
    count distinct long texts without shuffling them.
    """
    digest, carry = set(digest), list(carry)
    aggregates = aggregates or {"n": F.count(F.lit(1))}
    kinds = families(df)
    groups: dict[str, dict[str, Column]] = {}
    for name in columns:
        kind = kinds[name] if kinds[name] in _STORED_AS else "text"
        if name in digest:
            kind, stored = "text", F.sha2(as_text(col(name), kinds[name]), 256)
        elif kind == "text":
            stored = as_text(col(name), kinds[name])
        else:
            stored = col(name).cast(_STORED_AS[kind])
        groups.setdefault(kind, {})[name] = stored

    tables = []
    for kind, exprs in groups.items():
        if len(exprs) == 1:
            (name, stored), = exprs.items()
            tall = df.select(*carry, F.lit(name).alias("column_name"), stored.alias("value"))
        else:
            flat = df.select(*carry, *[stored.alias(name) for name, stored in exprs.items()])
            tall = flat.unpivot([F.col(c) for c in carry], [col(n) for n in exprs], "column_name", "value")
        counted = tall.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
            *[agg.alias(alias) for alias, agg in aggregates.items()]
        )
        tables.append(counted.withColumn("value", as_text(F.col("value"), kind)))
    return reduce(DataFrame.unionByName, tables)


def most_frequent() -> Column:
    """Struct whose minimum is the most frequent value, ties to the smallest value."""
    return F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value"))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column, pruned inside each task before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
