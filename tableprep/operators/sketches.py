"""Mergeable profiles: one row of states for each column, added up over files, tables and runs.

Counts, ranges, lengths and central power sums are exact and add up exactly; distinct counts, quantiles and top values
are sketches. States can be stored, and only new files need to be read when a table grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tableprep.functions.columns import PrepError, col, count_if, families, nan_to_null, visible
from tableprep.functions.rules import BOOLEAN_TEXTS, MISSING_TOKENS
from tableprep.functions.text import is_one_of, iso_time, strip, text_of, to_number, to_time, word_count

# Sketch sizes. Distinct counts have a standard error of 1.04 / sqrt(2^UNIQUE_BITS), 1.6 %; UNIQUE_ERROR is three of them.
# A quantile's true rank is within RANK_ERROR of the asked one; the sketch of RANK_SIZE keeps 0.004 with 99 % confidence.
UNIQUE_BITS, UNIQUE_ERROR = 12, 0.05
RANK_SIZE, RANK_ERROR = 1024, 0.01
# Ranks at which a column's quantiles are read to tell how many values lie outside a range.
GRID = 400
# Values that a column's top list follows; counts are at most rows / TOP_ITEMS * 4 too high. Longer texts are not listed.
TOP_ITEMS, TOP_LENGTH = 1000, 256

ADDED = ["row_count", "present", "numbers", "zeros", "negatives", "dates", "booleans", "placeholders", "total_length", "blanks", "total_words"]
LEAST, MOST = ["least", "least_length", "least_date"], ["most", "most_length", "most_date", "leading_zero"]
POWERS = ["mean", "squares", "cubes"]


def _states_of(df: DataFrame, name: str) -> dict[str, Column]:
    """Aggregates of one column; what its storage lacks is a typed null."""
    c, kind = col(name), families(df)[name]
    x = to_number(c, kind)
    n, squares = F.count(x), F.var_pop(x) * F.count(x)
    text, other = kind == "text", kind == "other"
    none = lambda type_: F.lit(None).cast(type_)
    number = lambda e: F.lit(0).cast("bigint") if kind in ("time", "other") else e
    length = F.char_length(c) if text else none("int")
    time = to_time(c, df.schema[name].dataType) if kind in ("text", "time") else none("timestamp_ntz")
    tidy = strip(c) if text else none("string")
    key = c + F.lit(0.0) if kind == "double" else F.to_json(F.struct(c)) if other else c
    shown = text_of(df, name)
    return {
        "row_count": F.count(F.lit(1)), "present": F.count(c), "numbers": number(n), "zeros": number(count_if(x == 0)), "negatives": number(count_if(x < 0)),
        "dates": F.count(time), "booleans": count_if((F.octet_length(tidy) <= 5) & F.lower(tidy).isin(BOOLEAN_TEXTS)) if text else F.lit(0).cast("bigint"),
        "placeholders": count_if(is_one_of(tidy, MISSING_TOKENS)) if text else F.lit(0).cast("bigint"),
        "total_length": F.coalesce(F.sum(length.cast("bigint")), F.lit(0).cast("bigint")), "blanks": count_if(tidy == "") if text else F.lit(0).cast("bigint"),
        "total_words": F.coalesce(F.sum(word_count(c).cast("bigint")), F.lit(0).cast("bigint")) if text else F.lit(0).cast("bigint"),
        "least": F.min(x), "least_length": F.min(length), "least_date": F.min(time), "most": F.max(x), "most_length": F.max(length), "most_date": F.max(time),
        "leading_zero": F.coalesce(F.max(c.startswith("0") & c.rlike(r"^0\d+")), F.lit(False)) if text else F.lit(False),
        "mean": F.avg(x), "squares": squares, "cubes": F.when(squares > 0, F.skewness(x) * F.sqrt(squares * squares * squares / n)).when(n > 0, 0.0),
        "unique_sketch": F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(key)), UNIQUE_BITS),
        "rank_sketch": F.kll_sketch_agg_double(x, RANK_SIZE) if kind not in ("time", "other") else none("binary"),
        "top_sketch": F.call_function("approx_top_k_accumulate", F.when(F.char_length(shown) <= TOP_LENGTH, shown), F.lit(TOP_ITEMS)),
    }


def column_states(df: DataFrame) -> DataFrame:
    """One row of states for each visible column, all from one aggregate over the table, without a shuffle of its rows."""
    df = nan_to_null(df)
    columns = visible(df)
    if not columns:
        raise PrepError("The table has no columns")
    specs = {n: _states_of(df, n) for n in columns}
    found = df.agg(*[agg.alias(f"s{i}_{key}") for i, spec in enumerate(specs.values()) for key, agg in spec.items()])
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("ordinal"), F.lit(n).alias("column_name"), F.lit(families(df)[n]).alias("storage"),
            *[F.col(f"s{i}_{key}").alias(key) for key in specs[n]],
        )
        for i, n in enumerate(columns)
    ]
    return found.select(F.inline(F.array(*rows)))


def merge_states(states: DataFrame) -> DataFrame:
    """One row for each column from the states of any number of parts: the same states as of all parts' rows together.

    Power sums are moved to the common mean before they are added. Columns are matched by name; a column whose storage
    differs between parts has one row for each storage.
    """
    keys = ["column_name", "storage"]
    part = Window.partitionBy(*keys)
    mean = F.sum(F.col("mean") * F.col("numbers")).over(part) / F.nullif(F.sum("numbers").over(part), F.lit(0))
    common = states.withColumn("__mean", mean).withColumn("__gap", F.col("mean") - F.col("__mean"))
    gap, n = F.col("__gap"), F.col("numbers")
    added = [F.sum(c).alias(c) for c in ADDED]
    return common.groupBy(*keys).agg(
        F.min("ordinal").alias("ordinal"), *added, *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST],
        F.max("__mean").alias("mean"), F.sum(F.col("squares") + n * gap * gap).alias("squares"),
        F.sum(F.col("cubes") + 3 * gap * F.col("squares") + n * gap * gap * gap).alias("cubes"),
        F.hll_union_agg("unique_sketch").alias("unique_sketch"), F.kll_merge_agg_double("rank_sketch", RANK_SIZE).alias("rank_sketch"),
        F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(TOP_ITEMS)).alias("top_sketch"),
    )


def state_records(merged: DataFrame) -> list[dict[str, Any]]:
    """What the states say of each column, in column order: one small record a column."""
    quartiles = [F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("rank_sketch", F.lit(q))).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    grid = F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("rank_sketch", ranks))
    outside = F.size(F.filter("grid", lambda v: (v < F.col("q1") - reach) | (v > F.col("q3") + reach)))
    # The sketch lists missing cells as a value of their own.
    top = F.filter(F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(TOP_ITEMS)), lambda t: t["item"].isNotNull())
    shown = merged.select(
        "*", *quartiles, grid.alias("grid"), F.hll_sketch_estimate("unique_sketch").alias("unique"),
        F.transform(top, lambda t: F.struct(t["item"].alias("value"), t["count"].alias("count"))).alias("top"),
    )
    shown = shown.withColumns({"outliers": outside / (GRID + 1), "first_date": iso_time("least_date"), "last_date": iso_time("most_date")}).drop("grid")
    return [r.asDict(recursive=True) for r in shown.drop("unique_sketch", "rank_sketch", "top_sketch").orderBy("ordinal", "storage").collect()]


def profile_of_states(
    merged: DataFrame, role: str = "single", target: str | None = None, problem_type: str = "unknown", overrides: dict[str, str] | None = None
) -> DataFrame:
    """Profiles in the columns of ``profile_table`` from merged states.

    Counts, rates, ranges, means, deviations, skewness, lengths and dates are exact. ``unique_count`` is within
    ``UNIQUE_ERROR`` of itself, quartiles within ``RANK_ERROR`` of their rank, outlier counts within twice that share of
    the rows; top, dominant and class values are those of the largest estimated counts, ties to the smaller value. Rare
    values and samples are not known. A text date counts if any of the fixed shapes reads it.
    """
    from tableprep.operators.profile import PROFILE_SCHEMA, TOP_VALUES, corrected_skewness, infer_type, profiles_frame

    overrides, records = overrides or {}, []
    for s in state_records(merged):
        name, rows, present, n, unique = s["column_name"], s["row_count"], s["present"], s["numbers"], min(s["unique"] or 0, s["present"])
        kind = overrides.get(name) or infer_type(s["storage"], {**s, "rows": rows}, unique, name == target)
        top = sorted(s["top"] or [], key=lambda t: (-t["count"], t["value"]))
        flags = {"contains_missing_values": rows > present, "constant_or_empty": unique <= 1, "user_type_override": name in overrides}
        r: dict[str, Any] = dict.fromkeys(PROFILE_SCHEMA.names) | {
            "dataset_role": role, "ordinal": s["ordinal"], "column_name": name, "storage": s["storage"], "inferred_type": kind, "row_count": rows,
            "missing_count": rows - present, "missing_rate": (rows - present) / max(rows, 1), "unique_count": unique, "cardinality_ratio": unique / max(rows, 1),
            "warnings": [w for w, on in flags.items() if on], "sample_values": [], "is_target": name == target,
            "placeholder_count": s["placeholders"], "has_leading_zero": s["leading_zero"], "count": present,
        }
        if name == target and problem_type == "classification":
            first, last = (top[0], top[-1]) if top else ({"value": None, "count": 0},) * 2
            r |= {"majority_class": first["value"], "majority_class_rate": first["count"] / max(present, 1)}
            r |= {"minority_class": last["value"], "minority_class_rate": last["count"] / max(present, 1)}
        elif kind == "numeric":
            r |= {"count": n} if not n else {
                "count": n, "mean": s["mean"], "std": math.sqrt(s["squares"] / (n - 1)) if n > 1 else 0.0, "min": s["least"], "max": s["most"],
                "median": s["median"], "q1": s["q1"], "q3": s["q3"], "iqr": s["q3"] - s["q1"], "zero_count": s["zeros"], "negative_count": s["negatives"],
                "skewness": corrected_skewness(s["squares"], s["cubes"], n), "outlier_count_iqr": round(s["outliers"] * n), "outlier_rate_iqr": s["outliers"],
            }
        elif kind in ("categorical", "boolean"):
            r |= {
                "top_values": top[:TOP_VALUES], "dominant_value": top[0]["value"] if top else None, "dominant_value_rate": (top[0]["count"] if top else 0) / max(present, 1),
                "possible_id_column": r["cardinality_ratio"] > 0.9,
            }
        elif kind == "datetime":
            r |= {"parse_success_rate": s["dates"] / max(present, 1), "min_date": s["first_date"], "max_date": s["last_date"], "invalid_date_count": present - s["dates"]}
        elif kind == "text":
            r |= {
                "average_length": s["total_length"] / max(present, 1), "min_length": s["least_length"] or 0, "max_length": s["most_length"] or 0,
                "empty_string_count": s["blanks"], "average_word_count": s["total_words"] / max(present, 1),
            }
        records.append(r)
    return profiles_frame(merged.sparkSession, records)


def append_states(
    spark: SparkSession, source: DataFrame, store: str, run_id: str, read: Callable[[list[str]], DataFrame] | None = None
) -> DataFrame:
    """States of the files of ``source`` that ``store`` does not know yet, added to it under ``run_id``; all states merged.

    ``source`` is a scan of a folder whose files are added to, never changed; ``read`` reads a list of them (by default
    Parquet files of the source's schema). Only new files are read, once. States and the names of their files are written
    together, so a run that fails leaves nothing behind and can be repeated.
    """
    known = set()
    old = _stored_states(spark, store)
    if old is not None:
        known = {r["file"] for r in old.filter("files is not null").select(F.explode("files").alias("file")).distinct().collect()}
    new = sorted(set(source.inputFiles()) - known)
    if new:
        rows = read(new) if read else spark.read.schema(source.schema).parquet(*new)
        # The names stand beside the first column's states.
        files = F.when(F.col("ordinal") == 0, F.array(*map(F.lit, new)))
        states = column_states(rows).withColumns({"files": files.cast("array<string>"), "run_id": F.lit(run_id)})
        states.coalesce(1).write.mode("append").parquet(store)
    elif old is None:
        raise PrepError("The table has no files")
    return merge_states(_stored_states(spark, store))


def _stored_states(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    return spark.read.parquet(store) if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None
