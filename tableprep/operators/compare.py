"""Two versions of one table: which columns, and then which cells, differ, without joining the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import PrepError, col, families, nan_to_null, require_columns, visible
from tableprep.functions.text import as_text

# A hash is added up in three parts of 22 bits at most, whose sums stay exact for 2^41 rows.
PART_BITS, PARTS = 22, 3
BUCKETS = 4_096


def _cell(df: DataFrame, name: str, numeric: bool) -> Column:
    """Text form of a cell; ``numeric``: the sides differ in type, so that cells equal as numbers are equal."""
    kind = families(df)[name]
    # Adding zero makes -0.0 equal to 0.0.
    text = as_text(col(name) + F.lit(0.0) if kind == "double" else col(name), kind)
    return F.coalesce((text.try_cast("double") + F.lit(0.0)).cast("string"), text) if numeric else text


def _mixed(before: DataFrame, after: DataFrame) -> set[str]:
    return {n for n in visible(before) if n in after.columns and before.schema[n].dataType != after.schema[n].dataType}


def _key(df: DataFrame, key: list[str], mixed: set[str]) -> list[Column]:
    require_columns(df, key)
    # Hashes skip nulls, so each part of the key says whether it is there.
    return [part for n in key for part in (col(n).isNull(), _cell(df, n, n in mixed))]


def _states(df: DataFrame, key: list[str], columns: list[str], mixed: set[str]) -> list[Column]:
    """For each column the sums of the hashes of (key, value): equal for equal contents, in whatever order."""
    keys, out, mask = _key(df, key, mixed), [], (1 << PART_BITS) - 1
    for i, name in enumerate(columns):
        hashed = F.xxhash64(*keys, _cell(df, name, name in mixed))
        parts = [F.sum(F.shiftrightunsigned(hashed, PART_BITS * p).bitwiseAND(F.lit(mask))) for p in range(PARTS)]
        out.append(F.array(*parts).alias(f"s{i}"))
    return out


def column_fingerprints(df: DataFrame, key: list[str], columns: list[str] | None = None, mixed: set[str] = frozenset()) -> DataFrame:
    """(column_name, rows, present, fingerprint) of each column from one aggregate; no row is shuffled.

    The fingerprint is the sum of 64-bit hashes of key and value over all rows. It depends neither on row order nor on
    partitions, and two tables whose contents differ share it with a chance of about 2^-64. An empty table has null
    fingerprints; NaN is missing; rows with equal keys, or none, each count.
    """
    df = nan_to_null(df)
    names = visible(df) if columns is None else columns
    require_columns(df, names)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, rows bigint, present bigint, fingerprint array<bigint>")
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(n)).alias(f"p{i}") for i, n in enumerate(names)], *_states(df, key, names, mixed))
    cells = [
        F.struct(F.lit(n).alias("column_name"), F.col("rows"), F.col(f"p{i}").alias("present"), F.col(f"s{i}").alias("fingerprint"))
        for i, n in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*cells)))


def changed_columns(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Whether each column's contents are added, removed, changed or unchanged, over all rows of both tables.

    A row belongs to its ``key``; a row that only one side has changes every column. Where types differ, values that are
    equal as texts or as numbers are equal.
    """
    mixed, sides = _mixed(before, after), []
    for df, side in ((before, "before"), (after, "after")):
        marks = column_fingerprints(df, key, mixed=mixed)
        kinds = F.create_map(*[F.lit(x) for n in visible(df) for x in (n, df.schema[n].dataType.simpleString())])
        sides.append(marks.select(
            "column_name", F.col("rows").alias(f"{side}_rows"), F.col("present").alias(f"{side}_present"),
            kinds[F.col("column_name")].alias(f"{side}_dtype"), F.col("fingerprint").alias(f"{side}_mark"),
        ))
    same = F.col("before_mark").eqNullSafe(F.col("after_mark"))
    status = (
        F.when(F.col("after_dtype").isNull(), "removed").when(F.col("before_dtype").isNull(), "added").when(same, "unchanged").otherwise("changed")
    )
    return sides[0].join(sides[1], "column_name", "full").withColumn("status", status).select(
        "column_name", "status", "before_rows", "after_rows", "before_present", "after_present", "before_dtype", "after_dtype",
    )


def changed_cells(before: DataFrame, after: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The cells that differ: key, column_name, value (as text), and how many rows of each side hold it under that key.

    Fingerprints of ``buckets`` ranges of key hashes find where the tables differ. Only rows of those ranges, and only
    columns that differ somewhere, reach the grouping, so its shuffle follows the amount of change; at most
    ``buckets`` numbers reach the driver and its filter. Values are grouped, not joined: repeated keys, or rows without a
    key, cost one row for each distinct cell. Columns that one side lacks are left out (see :func:`changed_columns`).
    """
    if buckets < 1:
        raise PrepError("buckets must be at least 1")
    if set(key) & {"column_name", "value", "n_before", "n_after"}:
        raise PrepError("Rename key columns that share a name with a column of the result")
    before, after = nan_to_null(before), nan_to_null(after)
    mixed = _mixed(before, after)
    names = [n for n in visible(before) if n in after.columns and n not in key]
    spark = before.sparkSession
    shown = [_cell(before, n, n in mixed).alias(n) for n in key]
    if not names:
        return before.limit(0).select(*shown, F.lit("").alias("column_name"), F.lit("").alias("value"), *[F.lit(0).cast("bigint").alias(n) for n in ("n_before", "n_after")])
    bucket = lambda df: F.pmod(F.xxhash64(*_key(df, key, mixed)), F.lit(buckets)).cast("int")
    marks = [
        df.groupBy(bucket(df).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *_states(df, key, names, mixed)).select(
            "bucket", "n", *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(len(names))])
        for df, side in ((before, "b"), (after, "a"))
    ]
    both = marks[0].withColumnRenamed("n", "bn").join(marks[1].withColumnRenamed("n", "an"), "bucket", "full")
    other = [~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}")) for i in range(len(names))]
    found = both.select("bucket", F.array(*other).alias("other")).filter("exists(other, x -> x)").agg(
        F.collect_list("bucket"), *[F.coalesce(F.max(F.get("other", F.lit(i))), F.lit(False)) for i in range(len(names))]).first()
    moved = [n for i, n in enumerate(names) if found[1 + i]]
    chosen = spark.createDataFrame([(b,) for b in found[0]], "__tp_chosen int")
    parts = []
    for df, one, none in ((before, 1, 0), (after, 0, 1)):
        cells = [F.struct(F.lit(n).alias("column_name"), _cell(df, n, n in mixed).alias("value")) for n in moved]
        cells = F.array(*cells) if cells else F.lit(None).cast("array<struct<column_name:string,value:string>>")
        kept = df.withColumn("__tp_bucket", bucket(df)).join(F.broadcast(chosen), F.col("__tp_bucket") == F.col("__tp_chosen"), "left_semi")
        rows = kept.select(*[_cell(df, n, n in mixed).alias(f"k{i}") for i, n in enumerate(key)], F.inline(cells))
        parts.append(rows.withColumns({"b": F.lit(one), "a": F.lit(none)}))
    keys = [f"k{i}" for i in range(len(key))]
    counted = parts[0].unionByName(parts[1]).groupBy(*keys, "column_name", "value").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return counted.filter("n_before <> n_after").select(*[F.col(k).alias(n) for k, n in zip(keys, key)], "column_name", "value", "n_before", "n_after")
