"""Column profiles: one record per column, from a few passes over the whole table.

Pass 1 is one aggregate without a shuffle (counts, moments, lengths, and parse
rates of long texts). Pass 2 is the value-frequency shuffle for distinct and top
values; parse rates and date ranges of short texts come from it, so that each
different text is parsed once. Only then are types known, so exact quantiles,
outliers and word counts are computed for the columns that need them. What
reaches the driver between passes is one small record per column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableprep.functions.columns import col, count_if, families, head_in_order, nan_to_null, order_keys, visible
from tableprep.functions.rules import BOOLEAN_TEXTS, MISSING_TOKENS
from tableprep.functions.text import (
    date_forms, is_one_of, iso_time, strip, text_of, to_number, to_time, word_count,
)
from tableprep.plans.freq import most_frequent, top_values, value_frequencies
from tableprep.plans.jobs import side_by_side
from tableprep.plans.quantiles import exact_quantiles

SAMPLE_VALUES = 5
TOP_VALUES = 10
HEAD_ROWS = 200
LONG_TEXT = 40
COLUMNS_PER_JOB = 20

_VALUE_COUNTS = pa.list_(pa.struct([("value", pa.string()), ("count", pa.int64())]))
PROFILE_SCHEMA = pa.schema(
    [
        ("dataset_role", pa.string()),
        ("ordinal", pa.int64()),
        ("column_name", pa.string()),
        ("storage", pa.string()),
        ("inferred_type", pa.string()),
        ("row_count", pa.int64()),
        ("missing_count", pa.int64()),
        ("missing_rate", pa.float64()),
        ("unique_count", pa.int64()),
        ("cardinality_ratio", pa.float64()),
        ("warnings", pa.list_(pa.string())),
        ("sample_values", pa.list_(pa.string())),
        ("is_target", pa.bool_()),
        ("placeholder_count", pa.int64()),
        ("has_leading_zero", pa.bool_()),
        ("count", pa.int64()),
        ("mean", pa.float64()),
        ("std", pa.float64()),
        ("min", pa.float64()),
        ("max", pa.float64()),
        ("median", pa.float64()),
        ("q1", pa.float64()),
        ("q3", pa.float64()),
        ("iqr", pa.float64()),
        ("zero_count", pa.int64()),
        ("negative_count", pa.int64()),
        ("skewness", pa.float64()),
        ("outlier_count_iqr", pa.int64()),
        ("outlier_rate_iqr", pa.float64()),
        ("top_values", _VALUE_COUNTS),
        ("rare_value_count", pa.int64()),
        ("rare_value_rate", pa.float64()),
        ("dominant_value", pa.string()),
        ("dominant_value_rate", pa.float64()),
        ("possible_id_column", pa.bool_()),
        ("parse_success_rate", pa.float64()),
        ("min_date", pa.string()),
        ("max_date", pa.string()),
        ("invalid_date_count", pa.int64()),
        ("average_length", pa.float64()),
        ("min_length", pa.int64()),
        ("max_length", pa.int64()),
        ("empty_string_count", pa.int64()),
        ("average_word_count", pa.float64()),
        ("majority_class", pa.string()),
        ("majority_class_rate", pa.float64()),
        ("minority_class", pa.string()),
        ("minority_class_rate", pa.float64()),
    ]
)


def column_aggregates(df: DataFrame, specs: dict[str, dict[str, Column]]) -> dict[str, dict[str, Any]]:
    """Run scalar aggregates for many columns, a bounded number of columns per job."""
    names = [n for n in specs if specs[n]]
    out: dict[str, dict[str, Any]] = {n: {} for n in specs}
    for i in range(0, len(names), COLUMNS_PER_JOB):
        part = names[i : i + COLUMNS_PER_JOB]
        aggs = [agg.alias(f"a{j}_{key}") for j, n in enumerate(part) for key, agg in specs[n].items()]
        row = df.agg(*aggs).first()
        for j, n in enumerate(part):
            out[n] = {key: row[f"a{j}_{key}"] for key in specs[n]}
    return out


# --- sample values and date formats -------------------------------------------------------------


def sample_values(df: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    """First five non-missing values of each column in row order, as text."""
    columns = columns or visible(df)
    shown = [text_of(df, n).alias(f"v{i}") for i, n in enumerate(columns)]
    head = head_in_order(df, HEAD_ROWS).select(*shown).collect()
    out = {name: [r[i] for r in head if r[i] is not None][:SAMPLE_VALUES] for i, name in enumerate(columns)}
    sparse = [i for i, name in enumerate(columns) if len(out[name]) < SAMPLE_VALUES] if len(head) == HEAD_ROWS else []
    if sparse:
        # One job for all columns that the first rows did not fill; each task passes on five values of a column.
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text_of(df, columns[i]).alias("v")) for i in sparse]))
        tall = df.select(F.struct(*order_keys(df)).alias("place"), cells.alias("cell")).filter("cell.v is not null")
        rank = F.row_number().over(Window.partitionBy("cell.i").orderBy("place"))
        found = tall.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_VALUES).select("cell.i", "cell.v", "rank").collect()
        for i in sparse:
            out[columns[i]] = [r["v"] for r in sorted((r for r in found if r["i"] == i), key=lambda r: r["rank"])]
    return out


def date_shapes(df: DataFrame, samples: dict[str, list[str]], values: DataFrame | None = None) -> dict[str, int | str | None]:
    """Date shape of each text column, fixed by its first non-missing value, else by the pattern of its values."""
    kinds = families(df)
    return date_forms(df, {n: values for n, values in samples.items() if kinds[n] == "text"}, values)


# --- pass 1: everything that needs no shuffle ---------------------------------------------------


def _first_pass(df: DataFrame, columns: list[str], wordy: list[str], shapes: dict[str, int | str | None]) -> dict[str, dict[str, Any]]:
    kinds = families(df)
    specs: dict[str, dict[str, Column]] = {}
    for name in columns:
        c, kind = col(name), kinds[name]
        spec = {"rows": F.count(F.lit(1)), "present": F.count(c)}
        if kind in ("long", "double", "decimal", "bool"):
            spec |= _range(to_number(c, kind))
        elif kind == "text":
            spec["total_length"] = F.sum(F.char_length(c).cast("bigint"))
            if name in wordy:
                spec |= _text_rates(c, to_time(c, df.schema[name].dataType, shapes.get(name)), count_if)
        specs[name] = spec
    return column_aggregates(df, specs)


def _text_rates(c: Column, time: Column, count: Callable[[Column], Column]) -> dict[str, Column]:
    tidy = strip(c)
    return {
        "numbers": count(to_number(c, "text").isNotNull()),
        "dates": count(time.isNotNull()),
        "booleans": count((F.octet_length(tidy) <= 5) & F.lower(tidy).isin(BOOLEAN_TEXTS)),
        "placeholders": count(_is_placeholder(tidy)),
        "leading_zero": F.coalesce(F.max(c.startswith("0") & c.rlike(r"^0\d+")), F.lit(False)),
    }


def _is_placeholder(tidy: Column) -> Column:
    return is_one_of(tidy, MISSING_TOKENS)


def _late_text_rates(df: DataFrame, samples: dict[str, list[str]], columns: list[str]) -> dict[str, dict[str, Any]]:
    """Parse rates, and date shapes, of long texts that began with short ones."""
    if not columns:
        return {}
    shapes = date_shapes(df, {n: samples[n] for n in columns})
    found = column_aggregates(df, {n: _text_rates(col(n), to_time(col(n), df.schema[n].dataType, shapes[n]), count_if) for n in columns})
    return {n: {**rates, "shape": shapes[n]} for n, rates in found.items()}


def _grouped_text_rates(
    df: DataFrame, freq: DataFrame | None, samples: dict[str, list[str]], columns: list[str]
) -> dict[str, dict[str, Any]]:
    """Parse rates and date ranges of text columns from their value counts: each different text is parsed once."""
    if not columns:
        return {}
    shapes = date_shapes(df, {n: samples[n] for n in columns}, freq)
    name, value, n = F.col("column_name"), F.col("value"), F.col("n")
    out: dict[str, dict[str, Any]] = {}
    for i in range(0, len(columns), COLUMNS_PER_JOB):
        part = columns[i : i + COLUMNS_PER_JOB]
        time = F.when(F.lit(False), F.lit(None).cast("timestamp_ntz"))
        for shape in dict.fromkeys(shapes[c] for c in part):
            time = time.when(name.isin([c for c in part if shapes[c] == shape]), to_time(value, T.StringType(), shape))
        rates = _text_rates(value, time, lambda holds: F.sum(F.when(holds, n).otherwise(0)))
        rates |= {"least": iso_time(F.min(time)), "most": iso_time(F.max(time))}
        found = freq.filter(name.isin(part)).groupBy("column_name").agg(*[agg.alias(key) for key, agg in rates.items()])
        out |= {r["column_name"]: {key: r[key] for key in rates} for r in found.collect()}
    return out


def _range(x: Column) -> dict[str, Column]:
    return {
        "numbers": F.count(x),
        "mean": F.avg(x),
        "min": F.min(x),
        "max": F.max(x),
        "zeros": count_if(x == 0),
        "negatives": count_if(x < 0),
    }


def _spread(x: Column, mean: float) -> dict[str, Column]:
    """Central power sums around a known mean: plain sums that stay in generated code."""
    gap = x - F.lit(mean)
    return {"squares": F.sum(gap * gap), "cubes": F.sum(gap * gap * gap)}


def corrected_skewness(squares: float, cubes: float, n: int) -> float:
    """Sample (bias-corrected) skewness from central power sums; 0 where undefined."""
    if n <= 2 or not squares > 0:
        return 0.0
    value = n * math.sqrt(n - 1) / (n - 2) * cubes / squares**1.5
    return 0.0 if math.isnan(value) else value


# --- pass 2: distinct and top values ------------------------------------------------------------


def _ranked_values(freq: DataFrame | None, columns: list[str], present: dict[str, int]) -> dict[str, dict[str, Any]]:
    """Distinct count and top, rare, dominant and scarcest values of category-like columns, from their value counts."""
    if not columns:
        return {}
    limits = [x for n in columns for x in (F.lit(n), F.lit(max(1, math.floor(present[n] * 0.01))))]
    rare = F.col("n") <= F.create_map(*limits)[F.col("column_name")]
    whole = freq.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique"),
        count_if(rare).alias("rare"),
        F.min(most_frequent()).alias("first"),
        F.max(most_frequent()).alias("last"),
    )
    top = top_values(freq, TOP_VALUES).groupBy("column_name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top")
    )
    return {
        r["column_name"]: {
            "unique": r["unique"],
            "rare": r["rare"],
            "dominant": (r["first"]["value"], -r["first"]["neg_n"]),
            "scarcest": (r["last"]["value"], -r["last"]["neg_n"]),
            "top": [{"value": t["value"], "count": t["n"]} for t in r["top"]],
        }
        for r in whole.join(top, "column_name").collect()
    }


def _distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, Any]]:
    """Distinct count only; texts are counted by digest."""
    if not columns:
        return {}
    texts = [n for n in columns if families(df)[n] == "text"]
    distinct = value_frequencies(df, columns, digest=texts).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique"))
    return {r["column_name"]: {"unique": r["unique"]} for r in distinct.collect()}


# --- types --------------------------------------------------------------------------------------


def infer_type(storage: str, first: dict[str, Any], unique: int, is_target: bool) -> str:
    """Semantic type of a column from its statistics; the first rule that holds decides."""
    rows, present = max(first["rows"], 1), first["present"]
    if storage == "bool":
        return "boolean"
    if storage in ("long", "double", "decimal"):
        few = unique <= min(10, max(2, int(rows * 0.05)))
        return "categorical" if few and not is_target else "numeric"
    if storage == "time":
        return "datetime"
    if storage == "other":
        return "unknown"
    if unique and unique <= 4 and first["booleans"] == present:
        return "boolean"
    if present and first["numbers"] / present >= 0.90:
        return "numeric"
    if present and first["dates"] / present >= 0.85:
        return "datetime"
    mean_length = (first["total_length"] or 0) / present if present else 0.0
    if mean_length >= 40 or (mean_length >= 20 and unique / rows > 0.5):
        return "text"
    return "unknown" if first["rows"] == 0 else "categorical"


# --- the profile --------------------------------------------------------------------------------


def profile_records(
    df: DataFrame,
    role: str = "single",
    target: str | None = None,
    problem_type: str = "unknown",
    overrides: dict[str, str] | None = None,
) -> list[dict[str, Any]]:
    """Profile of every visible column as plain records (one per column)."""
    df, overrides = nan_to_null(df), overrides or {}
    columns, kinds = visible(df), families(df)
    samples = sample_values(df)
    # Texts that begin with long ones are parsed row by row at once, others once for each different text.
    wordy = [n for n in columns if kinds[n] == "text" and samples[n] and sum(map(len, samples[n])) >= LONG_TEXT * len(samples[n])]
    shapes = date_shapes(df, {n: samples[n] for n in wordy})
    numbers = [n for n in columns if kinds[n] in ("long", "double", "decimal")]
    by_class = target if problem_type == "classification" else None
    asked = {n for n in columns if overrides.get(n) in ("categorical", "boolean") or n == by_class}
    plain = [n for n in columns if n not in asked and (n in numbers or kinds[n] == "time")]
    first, values = side_by_side(
        df.sparkSession, lambda: _first_pass(df, columns, wordy, shapes), lambda: _distinct_counts(df, plain)
    )
    present = {n: first[n]["present"] for n in columns}

    def inferred(name: str) -> str:
        return overrides.get(name) or infer_type(kinds[name], first[name], values.get(name, {}).get("unique", 0), name == target)

    # Texts of 40 characters on average are free text whatever their distinct count.
    long_text = [
        n for n in columns
        if kinds[n] == "text" and n not in asked and (first[n]["total_length"] or 0) >= LONG_TEXT * max(present[n], 1)
    ]
    few = [n for n in plain if n in numbers and inferred(n) == "categorical"]
    ranked = [
        n for n in columns
        if present[n] and n not in long_text and (n in asked or n in few or kinds[n] in ("text", "bool"))
    ]
    measured = [n for n in plain if n in numbers and n not in few and inferred(n) == "numeric"]
    short = [n for n in ranked if kinds[n] == "text"]
    others = [n for n in ranked if n not in short]
    texts = value_frequencies(df, short).persist(StorageLevel.DISK_ONLY) if short else None
    freq = value_frequencies(df, others) if others else None
    if short:
        freq = texts.unionByName(freq) if others else texts
    try:
        more, counted, quartiles, told, late = side_by_side(
            df.sparkSession,
            lambda: _ranked_values(freq, ranked, present),
            lambda: _distinct_counts(df, [n for n in long_text if present[n]]),
            lambda: _quartiles(df, measured, first, values),
            lambda: _grouped_text_rates(df, texts, samples, [n for n in short if n not in wordy]),
            lambda: _late_text_rates(df, samples, [n for n in long_text if n not in wordy]),
        )
    finally:
        if short:
            texts.unpersist()
    values = values | more | counted
    shapes |= {n: rates.pop("shape") for n, rates in late.items()}
    nothing = {"numbers": 0, "dates": 0, "booleans": 0, "placeholders": 0, "leading_zero": False, "least": None, "most": None}
    for n in columns:
        if kinds[n] == "text" and n not in wordy:
            first[n] |= late.get(n) or told.get(n) or nothing

    records = []
    for ordinal, name in enumerate(columns):
        stats, unique = first[name], values.get(name, {}).get("unique", 0)
        rows = stats["rows"]
        missing = rows - present[name]
        warnings = []
        if missing:
            warnings.append("contains_missing_values")
        if unique <= 1:
            warnings.append("constant_or_empty")
        if name in overrides:
            warnings.append("user_type_override")
        records.append(
            {
                "dataset_role": role,
                "ordinal": ordinal,
                "column_name": name,
                "storage": kinds[name],
                "inferred_type": inferred(name),
                "row_count": rows,
                "missing_count": missing,
                "missing_rate": missing / max(rows, 1),
                "unique_count": unique,
                "cardinality_ratio": unique / max(rows, 1),
                "warnings": warnings,
                "sample_values": samples[name],
                "is_target": name == target,
                "placeholder_count": stats.get("placeholders", 0),
                "has_leading_zero": bool(stats.get("leading_zero", False)),
            }
        )
    _add_summaries(df, records, first, values, quartiles, shapes, problem_type)
    return records


def _quartiles(df: DataFrame, columns: list[str], first: dict[str, Any], values: dict[str, Any]) -> dict[str, list]:
    kinds = families(df)
    counts = {n: first[n].get("numbers", 0) for n in columns}
    wanted = {n: (to_number(col(n), kinds[n]), [0.25, 0.5, 0.75]) for n in columns if counts[n]}
    uniques = {n: values[n]["unique"] for n in wanted if n in values}
    return exact_quantiles(df, wanted, counts=counts, uniques=uniques)


def _summary_kind(record: dict[str, Any], problem_type: str) -> str:
    if record["is_target"] and problem_type == "classification":
        return "class"
    kind = record["inferred_type"]
    return "categorical" if kind == "boolean" else kind


def _add_summaries(df, records, first, values, quartiles, shapes, problem_type) -> None:
    """Fill the type-dependent part of each record; one more pass for what types asked for."""
    kinds = families(df)
    wanted = {r["column_name"]: _summary_kind(r, problem_type) for r in records}
    numbers = {n: to_number(col(n), kinds[n]) for n, kind in wanted.items() if kind == "numeric"}
    counts = {n: first[n].get("numbers", 0) for n in numbers}
    quartiles = quartiles | _quartiles(df, [n for n in numbers if n not in quartiles], first, values)
    means = {n: first[n].get("mean") for n in numbers}
    parsed = {n: {"mean": F.avg(x)} for n, x in numbers.items() if counts[n] and kinds[n] == "text"}
    means |= {n: found["mean"] for n, found in column_aggregates(df, parsed).items()}

    specs: dict[str, dict[str, Column]] = {}
    for name, kind in wanted.items():
        c, spec = col(name), {}
        if kind == "numeric" and counts[name]:
            low, _, high = quartiles[name]
            reach = 1.5 * (high - low)
            spec["outliers"] = count_if((numbers[name] < low - reach) | (numbers[name] > high + reach))
            if kinds[name] == "text":
                spec |= _range(numbers[name])
            spec |= _spread(numbers[name], means[name])
        elif kind == "datetime" and "least" not in first[name]:
            time = to_time(c, df.schema[name].dataType, shapes.get(name))
            spec = {"parsed": F.count(time), "least": iso_time(F.min(time)), "most": iso_time(F.max(time))}
        elif kind == "text":
            text = text_of(df, name)
            spec = {
                "mean_length": F.avg(F.char_length(text)),
                "least": F.min(F.char_length(text)),
                "most": F.max(F.char_length(text)),
                "blank": count_if(strip(text) == ""),
                "words": F.avg(word_count(text)),
            }
        specs[name] = spec
    second = column_aggregates(df, specs)

    for r in records:
        name, kind = r["column_name"], wanted[r["column_name"]]
        present, extra = first[name]["present"], second[name]
        if kind == "numeric":
            r.update(_numeric_summary({**first[name], **extra}, counts[name], quartiles.get(name)))
        elif kind == "categorical":
            r.update(_categorical_summary(values.get(name), present, r["cardinality_ratio"]))
        elif kind == "class":
            r.update(_class_summary(values.get(name), present))
        elif kind == "datetime":
            extra = extra or {"parsed": first[name]["dates"], "least": first[name]["least"], "most": first[name]["most"]}
            r.update(
                count=present,
                parse_success_rate=extra["parsed"] / max(present, 1),
                min_date=extra["least"],
                max_date=extra["most"],
                invalid_date_count=present - extra["parsed"],
            )
        elif kind == "text":
            r.update(
                count=present,
                average_length=extra["mean_length"] or 0.0,
                min_length=extra["least"] or 0,
                max_length=extra["most"] or 0,
                empty_string_count=extra["blank"],
                average_word_count=extra["words"] or 0.0,
            )


def _numeric_summary(stats: dict[str, Any], n: int, quartiles: list[float] | None) -> dict[str, Any]:
    if not n:
        return {"count": 0}
    q1, median, q3 = quartiles
    return {
        "count": n,
        "mean": stats["mean"],
        "std": math.sqrt(stats["squares"] / (n - 1)) if n > 1 else 0.0,
        "min": stats["min"],
        "max": stats["max"],
        "median": median,
        "q1": q1,
        "q3": q3,
        "iqr": q3 - q1,
        "zero_count": stats["zeros"],
        "negative_count": stats["negatives"],
        "skewness": corrected_skewness(stats["squares"], stats["cubes"], n),
        "outlier_count_iqr": stats["outliers"],
        "outlier_rate_iqr": stats["outliers"] / n,
    }


def _categorical_summary(values, present: int, ratio: float) -> dict[str, Any]:
    unique = values["unique"] if values else 0
    dominant, dominant_count = values["dominant"] if values else (None, 0)
    return {
        "count": present,
        "top_values": values["top"] if values else [],
        "rare_value_count": values["rare"] if values else 0,
        "rare_value_rate": values["rare"] / unique if unique else 0.0,
        "dominant_value": dominant,
        "dominant_value_rate": dominant_count / max(present, 1),
        "possible_id_column": ratio > 0.9,
    }


def _class_summary(values, present: int) -> dict[str, Any]:
    if not present:
        return {"count": 0, "majority_class_rate": 0.0, "minority_class_rate": 0.0}
    (majority, most), (minority, least) = values["dominant"], values["scarcest"]
    return {
        "count": present,
        "majority_class": majority,
        "majority_class_rate": most / present,
        "minority_class": minority,
        "minority_class_rate": least / present,
    }


def profiles_frame(spark, records: list[dict[str, Any]]) -> DataFrame:
    """Profile records as a local table the rule operators work on."""
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=PROFILE_SCHEMA))


def profile_table(
    df: DataFrame,
    role: str = "single",
    target: str | None = None,
    problem_type: str = "unknown",
    overrides: dict[str, str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """One row per column: type, missing and distinct counts, warnings and a summary by type.

    Without ``exact`` all columns come from one pass; distinct counts, quantiles and top values are then estimates within
    the bounds that ``sketches.profile_of_states`` states.
    """
    if not exact:
        from tableprep.operators.sketches import column_states, merge_states, profile_of_states

        return profile_of_states(merge_states(column_states(df)), role, target, problem_type, overrides)
    return profiles_frame(df.sparkSession, profile_records(df, role, target, problem_type, overrides))


# --- single statistics as tables ----------------------------------------------------------------


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and rate per column, from one aggregate."""
    df = nan_to_null(df)
    columns = visible(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(n)).alias(f"p{i}") for i, n in enumerate(columns)])
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("ordinal"),
            F.lit(n).alias("column_name"),
            (F.col("rows") - F.col(f"p{i}")).alias("missing_count"),
            ((F.col("rows") - F.col(f"p{i}")) / F.greatest("rows", F.lit(1))).alias("missing_rate"),
        )
        for i, n in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def placeholder_profile(df: DataFrame, role: str = "single") -> DataFrame:
    """Placeholder texts per column, as in the whole profile, from aggregates without a shuffle of values."""
    columns, kinds = visible(df), families(df)
    specs = {n: {"placeholders": count_if(_is_placeholder(strip(col(n))))} for n in columns if kinds[n] == "text"}
    found = column_aggregates(df, specs)
    schema = pa.schema([PROFILE_SCHEMA.field(n) for n in ("dataset_role", "ordinal", "column_name", "placeholder_count")])
    records = [
        {"dataset_role": role, "ordinal": i, "column_name": n, "placeholder_count": found.get(n, {}).get("placeholders", 0)}
        for i, n in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(records, schema=schema))


def cardinality_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per column and their share of rows."""
    df = nan_to_null(df)
    columns, kinds = [n for n in visible(df) if families(df)[n] != "other"], families(df)
    if exact:
        unique = value_frequencies(df, columns, digest=[n for n in columns if kinds[n] == "text"])
        unique = unique.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    else:
        sketch = df.agg(*[F.approx_count_distinct(col(n)).alias(f"u{i}") for i, n in enumerate(columns)])
        unique = sketch.select(
            F.inline(F.array(*[
                F.struct(F.lit(n).alias("column_name"), F.col(f"u{i}").alias("unique_count"))
                for i, n in enumerate(columns)
            ]))
        )
    rows = missing_profile(df.select(*[col(n) for n in columns]))
    total = df.count()
    found = rows.select("ordinal", "column_name").join(F.broadcast(unique), "column_name", "left")
    unique_count = F.coalesce("unique_count", F.lit(0))
    return found.select(
        "ordinal", "column_name", unique_count.alias("unique_count"),
        (unique_count / F.lit(max(total, 1))).alias("cardinality_ratio"),
    )


def parse_rates(df: DataFrame) -> DataFrame:
    """Share of non-missing text cells that parse as a number and as a date."""
    columns = [n for n, kind in families(df).items() if kind == "text" and n in visible(df)]
    samples = sample_values(df, columns)
    shapes = date_shapes(df, samples)
    aggs, rows = [], []
    for i, n in enumerate(columns):
        c = col(n)
        aggs += [
            F.count(c).alias(f"p{i}"),
            F.count(to_number(c, "text")).alias(f"n{i}"),
            F.count(to_time(c, df.schema[n].dataType, shapes[n])).alias(f"d{i}"),
        ]
        share = lambda k, i=i: F.coalesce(F.try_divide(F.col(f"{k}{i}"), F.col(f"p{i}")), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(n).alias("column_name"),
                share("n").alias("numeric_parse_rate"),
                share("d").alias("datetime_parse_rate"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Class counts of a target; one row per class, however many there are."""
    counts = value_frequencies(nan_to_null(df), [target])
    return counts.select(F.col("value").alias("class"), F.col("n").alias("class_count"))


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and missing rate of a table, in one row."""
    df = nan_to_null(df)
    columns = visible(df)
    gaps = sum((F.count(F.lit(1)) - F.count(col(n)) for n in columns), F.lit(0))
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), gaps.alias("missing_cells"))
    cells = F.greatest(F.col("row_count") * len(columns), F.lit(1))
    return counted.select(
        "row_count",
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        "missing_cells",
        (F.col("missing_cells") / cells).alias("missing_rate"),
        F.array(*map(F.lit, columns)).cast("array<string>").alias("columns"),
    )


def run_overview(profiles: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues per severity and columns per type, plus the target's type per role."""
    severity = issues.groupBy(F.lit("issues").alias("kind"), F.col("severity").alias("label")).count()
    types = profiles.groupBy(F.lit("column_types").alias("kind"), F.col("inferred_type").alias("label")).count()
    target = profiles.filter("is_target").select(
        F.lit("target").alias("kind"),
        F.concat_ws(":", "dataset_role", "column_name", "inferred_type").alias("label"),
        F.col("count"),
    )
    return severity.unionByName(types).unionByName(target).withColumnRenamed("count", "value")
