"""Category maps learned on one table and looked up on another, whatever their size."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tableprep.functions.columns import HIDDEN_PREFIX, ROW_ORDER, col, families, visible
from tableprep.plans.scratch import materialize, scratch_path

INLINE_VALUES = 1_000
LITERAL_VALUES = 64
LONGEST = 256


@dataclass
class CategoryMap:
    """``value -> code``: a plain dict up to a thousand values, else a stored table of (value, code)."""

    inline: dict[str, Any] | None = None
    table: DataFrame | None = None

    @classmethod
    def learn(cls, rows: DataFrame, size: int, label: str) -> CategoryMap:
        """From rows ``(value, code, n)``."""
        if size <= INLINE_VALUES:
            found = rows.orderBy(F.desc("n"), "value").collect()
            return cls(inline={r["value"]: r["code"] for r in found})
        return cls(table=materialize(rows.select("value", "code"), label))

    @classmethod
    def of_entries(cls, entries: list[list[Any]], code_type: str, spark: SparkSession) -> CategoryMap:
        if len(entries) <= INLINE_VALUES:
            return cls(inline=dict(entries))
        schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("code", _sql_type(code_type))])
        return cls(table=spark.createDataFrame([tuple(e) for e in entries], schema))

    def entries(self) -> list[list[Any]]:
        """[value, code] pairs on the driver, for a config that holds its maps itself."""
        if self.inline is not None:
            return [[value, code] for value, code in self.inline.items()]
        return [[r["value"], r["code"]] for r in self.table.orderBy("value").collect()]

    def as_table(self, code_type: str) -> DataFrame:
        """(value, code) rows."""
        if self.table is not None:
            return self.table.select("value", F.col("code").cast(code_type).alias("code"))
        schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("code", _sql_type(code_type))])
        return SparkSession.active().createDataFrame(list(self.inline.items()), schema)


def lookup(df: DataFrame, wanted: dict[str, tuple[Column, CategoryMap]], code_type: str) -> tuple[DataFrame, dict[str, Column]]:
    """Frame with helper columns, and for each name the looked-up code (null where the value is unknown or missing).

    ``wanted`` gives each name the text of its cells and its map. Stored maps are looked up for all names at once, see
    :func:`settle`.
    """
    out, codes, stored = df, {}, {}
    for name, (text, mapping) in wanted.items():
        if mapping.table is not None:
            stored[name] = (text, mapping)
        elif not mapping.inline:
            codes[name] = F.lit(None).cast(code_type)
        elif len(mapping.inline) <= LITERAL_VALUES:
            literal = F.create_map(*[F.lit(x) for pair in mapping.inline.items() for x in pair])
            codes[name] = F.try_element_at(literal, text).cast(code_type)
        else:
            # A map can be applied several times in one plan, so helper names carry the column.
            key, code = _helper("key", name), _helper("head", name)
            schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(code, _sql_type(code_type))])
            head = df.sparkSession.createDataFrame(list(mapping.inline.items()), schema)
            out = out.withColumn(key, text).join(F.broadcast(head), key, "left")
            codes[name] = col(code)
    if not stored:
        return out, codes
    done, rest = settle(out, stored, code_type)
    # The row-order key, where there is one, tells equal rows apart; the rest is left to adaptive skew splitting.
    kinds = families(df)
    told_by = [ROW_ORDER] if kinds.get(ROW_ORDER, "other") != "other" else [n for n in visible(df) if kinds[n] != "other"]
    spread = F.concat(F.lit("__tp_cold_"), F.xxhash64(*map(col, told_by)).cast("string"))
    for name, (_, mapping) in stored.items():
        key, found, head, tail, cold = (_helper(part, name) for part in ("key", "found", "head", "tail", "cold"))
        # Cells that are settled in a row that is not are spread over keys that match nothing.
        settled = col(key).isNull() | col(found).isNotNull()
        codes_of = mapping.as_table(code_type).select(F.col("value").alias(cold), F.col("code").alias(tail))
        rest = rest.withColumn(cold, F.when(settled, spread).otherwise(col(key))).join(codes_of, cold, "left").drop(cold)
        done = done.withColumn(tail, F.lit(None).cast(code_type))
        codes[name] = F.when(settled, col(head)).otherwise(col(tail))
    return done.unionByName(rest), codes


def settle(df: DataFrame, stored: dict[str, tuple[Column, CategoryMap]], code_type: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose every cell is missing or one of this table's most frequent values, and the rest.

    The frequent values are found by one pass of sketches over ``df``. Their codes, or the fact that they have none, are
    broadcast: at most INLINE_VALUES rows a column. Only the second frame needs an equi-join with the stored maps,
    so neither known nor unseen frequent values cross the network. Values of more than LONGEST characters count as rare.
    """
    keyed = df.withColumns({_helper("key", n): text for n, (text, _) in stored.items()})
    short = {n: F.when(F.char_length(col(_helper("key", n))) <= LONGEST, col(_helper("key", n))) for n in stored}
    tops = keyed.agg(*[
        F.transform(F.call_function("approx_top_k", short[n], F.lit(INLINE_VALUES + 1)), lambda t: t["item"]).alias(n) for n in stored
    ])
    tops = materialize(tops, "frequent")  # one row
    heads = []
    for i, (name, (_, mapping)) in enumerate(stored.items()):
        frequent = tops.select(F.explode(col(name)).alias("value")).filter("value IS NOT NULL")
        known = mapping.as_table(code_type).join(F.broadcast(frequent), "value")
        heads.append(frequent.join(F.broadcast(known), "value", "left").select(F.lit(i).alias("place"), "value", "code"))
    found = materialize(reduce(DataFrame.unionByName, heads), "heads")
    settled = F.lit(True)
    for i, name in enumerate(stored):
        key, mark, head = (_helper(part, name) for part in ("key", "found", "head"))
        codes = found.filter(F.col("place") == i).select(F.col("value").alias(key), F.col("code").alias(head), F.lit(True).alias(mark))
        keyed = keyed.join(F.broadcast(codes), key, "left")
        settled &= col(key).isNull() | col(mark).isNotNull()
    return keyed.filter(settled), keyed.filter(~settled)


def _helper(part: str, name: str) -> str:
    return f"{HIDDEN_PREFIX}{part}_{name}"


def drop_helpers(df: DataFrame, before: DataFrame) -> DataFrame:
    """Back to the columns of ``before`` plus new visible ones."""
    keep = set(before.columns)
    return df.select(*[col(n) for n in df.columns if n in keep or not n.startswith("__tp_")])


def _sql_type(name: str) -> T.DataType:
    return {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[name]


def sorted_codes(values: DataFrame) -> DataFrame:
    """``(value, n)`` plus ``code``: the position of each value in text order.

    Values are range-partitioned, sorted in place and numbered from per-partition offsets, so no task holds them all.
    """
    spark = values.sparkSession
    ranged = values.repartitionByRange("value").sortWithinPartitions("value")
    placed = ranged.withColumn("part", F.spark_partition_id()).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    path = scratch_path(spark, "codes")
    placed.write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    offset = F.coalesce(
        F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # One row per partition: bounded by the number of partitions, not by the data.
    offsets = F.broadcast(sizes.select("part", offset.alias("offset")))
    return stored.join(offsets, "part").select("value", "n", (F.col("offset") + F.col("place")).cast("bigint").alias("code"))
