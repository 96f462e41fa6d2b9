"""Train/test comparison: numeric shift, unseen categories, target shift, row overlap, score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import col, count_if, families, nan_to_null, visible
from tableprep.functions.keys import row_keys
from tableprep.functions.text import text_of, to_number
from tableprep.operators.issues import DRIFT, OVERLAP, SCHEMA, TARGET_SHIFT, issue, issues_from
from tableprep.plans.freq import value_frequencies
from tableprep.plans.jobs import side_by_side

SHOWN_UNSEEN = 25
COLUMNS_PER_JOB = 20
_DRIFT_COLUMNS = (
    "ordinal bigint, column_name string, inferred_type string, status string, train_mean double, test_mean double, "
    "train_std double, standardized_mean_diff double, train_unique bigint, test_unique bigint, "
    "unseen_categories array<string>, unseen_category_count bigint, unseen_row_rate double, drift_flag boolean"
)


def common_columns(train: DataFrame, test: DataFrame) -> list[str]:
    return [n for n in visible(train) if n in visible(test)]


def schema_difference(train: DataFrame, test: DataFrame) -> tuple[list[str], list[str]]:
    """Columns missing from test and columns only in test."""
    return sorted(set(visible(train)) - set(visible(test))), sorted(set(visible(test)) - set(visible(train)))


def _number_stats(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    kinds, frames = families(df), []
    for i in range(0, len(columns), COLUMNS_PER_JOB):
        aggs, rows = [], []
        for j, n in enumerate(columns[i : i + COLUMNS_PER_JOB]):
            x = to_number(col(n), kinds[n])
            aggs += [F.count(x).alias(f"n{j}"), F.avg(x).alias(f"m{j}"), F.stddev_samp(x).alias(f"s{j}")]
            rows.append(
                F.struct(
                    F.lit(n).alias("column_name"), F.col(f"n{j}").alias(f"{side}_n"),
                    F.col(f"m{j}").alias(f"{side}_mean"), F.coalesce(F.col(f"s{j}"), F.lit(0.0)).alias(f"{side}_std"),
                )
            )
        frames.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, frames)


def numeric_shift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised difference of means per column; flagged from one train deviation on."""
    both = _number_stats(nan_to_null(train), columns, "train").join(
        _number_stats(nan_to_null(test), columns, "test"), "column_name"
    )
    enough = (F.col("train_n") > 0) & (F.col("test_n") > 0)
    scale = F.when(F.col("train_std") > 0, F.col("train_std")).otherwise(F.greatest(F.abs("train_mean"), F.lit(1.0)))
    gap = F.abs(F.col("test_mean") - F.col("train_mean")) / scale
    shown = lambda c: F.when(enough, c)
    return both.select(
        "column_name", F.when(enough, "compared").otherwise("insufficient_data").alias("status"),
        shown(F.col("train_mean")).alias("train_mean"), shown(F.col("test_mean")).alias("test_mean"),
        shown(F.col("train_std")).alias("train_std"), shown(gap).alias("standardized_mean_diff"),
        F.coalesce(shown(gap >= 1.0), F.lit(False)).alias("drift_flag"),
    )


def _value_sides(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value on both sides from one shuffle: (column_name, value, train_n, test_n)."""
    kinds = families(train), families(test)
    same = {n: kinds[0][n] == kinds[1][n] and kinds[0][n] != "other" for n in columns}
    pick = lambda df: [col(n) if same[n] else text_of(df, n).alias(n) for n in columns]
    side = F.lit("train").alias("side"), F.lit("test").alias("side")
    both = nan_to_null(train).select(side[0], *pick(train)).unionByName(nan_to_null(test).select(side[1], *pick(test)))
    return value_frequencies(
        both, columns, carry=["side"],
        aggregates={"train_n": count_if(F.col("side") == "train"), "test_n": count_if(F.col("side") == "test")},
    )


def category_shift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct counts and test categories never seen in train, with their share of test rows."""
    sides = _value_sides(train, test, columns)
    unseen = F.col("train_n") == 0
    totals = sides.groupBy("column_name").agg(
        count_if(F.col("train_n") > 0).alias("train_unique"),
        count_if(F.col("test_n") > 0).alias("test_unique"),
        count_if(unseen).alias("unseen_category_count"),
        (F.coalesce(F.sum(F.when(unseen, F.col("test_n"))), F.lit(0)) / F.greatest(F.sum("test_n"), F.lit(1))).alias(
            "unseen_row_rate"
        ),
    )
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    shown = (
        sides.filter(unseen).withColumn("rank", rank).filter(F.col("rank") <= SHOWN_UNSEEN)
        .groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("unseen_categories"))
    )
    empty = F.array().cast("array<string>")
    return totals.join(shown, "column_name", "left").select(
        "column_name", "train_unique", "test_unique",
        F.coalesce("unseen_categories", empty).alias("unseen_categories"),
        "unseen_category_count", "unseen_row_rate",
        ((F.col("unseen_row_rate") >= 0.05) | (F.col("unseen_category_count") > 0)).alias("drift_flag"),
    )


def target_distribution(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Class shares of the target on both sides, one row per class."""
    sides = _value_sides(train, test, [target])
    totals = sides.agg(F.sum("train_n").alias("train_total"), F.sum("test_n").alias("test_total")).first()
    share = lambda n, total: (F.col(n) / F.lit(max(total or 0, 1))).alias(n.replace("_n", "_rate"))
    return sides.select(
        F.col("value").alias("class"), share("train_n", totals["train_total"]), share("test_n", totals["test_total"])
    )


def target_shift(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Largest class-share difference between the sides; flagged from 0.20 on."""
    gap = F.max(F.abs(F.col("train_rate") - F.col("test_rate")))
    row = target_distribution(train, test, target).agg(F.coalesce(gap, F.lit(0.0)).alias("max_class_rate_delta"))
    return row.withColumn("drift_flag", F.col("max_class_rate_delta") >= 0.20)


def row_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows that also occur in train on all common columns.

    Both sides are reduced to distinct row keys with counts first, so a row
    repeated any number of times meets its partner once.
    """
    train, test = nan_to_null(train), nan_to_null(test)
    columns = common_columns(train, test)
    if not columns:
        rows = train.select(F.lit(1).alias("train_n"), F.lit(0).alias("test_n")).unionAll(
            test.select(F.lit(0).alias("train_n"), F.lit(1).alias("test_n"))
        )
        return rows.agg(*_overlap(F.lit(0).cast("bigint")))
    kinds = families(train), families(test)
    differing = frozenset(n for n in columns if kinds[0][n] != kinds[1][n])
    sides = [df.select(F.lit(side).alias("side"), *row_keys(df, columns, differing)) for df, side in ((train, 0), (test, 1))]
    keys = [n for n in sides[0].columns if n != "side"]
    rows = sides[0].union(sides[1]).groupBy(*keys).agg(
        count_if(F.col("side") == 0).alias("train_n"), count_if(F.col("side") == 1).alias("test_n")
    )
    return rows.agg(*_overlap(F.coalesce(F.sum(F.when(F.col("train_n") > 0, F.col("test_n"))), F.lit(0))))


def _overlap(shared: Column) -> list[Column]:
    test_rows = F.coalesce(F.sum("test_n"), F.lit(0))
    return [
        shared.alias("overlap_count"),
        (shared / F.greatest(test_rows, F.lit(1))).alias("overlap_rate"),
        F.coalesce(F.sum("train_n"), F.lit(0)).alias("train_rows"),
        test_rows.alias("test_rows"),
    ]


@dataclass
class DriftReport:
    columns: DataFrame
    target: DataFrame | None
    overlap: DataFrame
    summary: DataFrame
    issues: DataFrame


def compare_tables(
    train: DataFrame, test: DataFrame, train_profiles: DataFrame, target: str | None = None
) -> DriftReport:
    """Drift of test against train: column shifts, target shift, overlap, score and issues."""
    spark = train.sparkSession
    common, (missing, extra) = common_columns(train, test), schema_difference(train, test)
    types = {r["column_name"]: r for r in train_profiles.select("column_name", "ordinal", "inferred_type").collect()}
    compared = [n for n in common if n != target and n in types]
    numeric = [n for n in compared if types[n]["inferred_type"] == "numeric"]
    category = [n for n in compared if types[n]["inferred_type"] in ("categorical", "boolean", "text")]

    # One row per column (and at most 25 shown categories each): small enough to keep as a local table.
    has_target = target in common
    shifts, unseen, shift, overlap = side_by_side(
        spark,
        lambda: numeric_shift(train, test, numeric).collect() if numeric else [],
        lambda: category_shift(train, test, category).collect() if category else [],
        lambda: target_shift(train, test, target).first() if has_target else None,
        lambda: row_overlap(train, test).first(),
    )
    found = {r["column_name"]: r.asDict() for r in shifts}
    if category:
        found |= {r["column_name"]: {"status": "compared", **r.asDict()} for r in unseen}
        blank = {"status": "compared", "train_unique": 0, "test_unique": 0, "unseen_categories": [],
                 "unseen_category_count": 0, "unseen_row_rate": 0.0, "drift_flag": False}
        found |= {n: blank for n in category if n not in found}
    names = [f.split()[0] for f in _DRIFT_COLUMNS.split(", ")]
    rows = [
        [({**found[n], **types[n].asDict()}).get(key) for key in names] for n in compared if n in found
    ]
    columns = spark.createDataFrame(rows, _DRIFT_COLUMNS)

    flagged = sum(bool(found[n]["drift_flag"]) for n in found)
    points = flagged + bool(shift and shift["drift_flag"]) + (overlap["overlap_rate"] > 0)
    summary = spark.createDataFrame(
        [(
            min(100.0, 100.0 * points / max(len(common), 1)), overlap["train_rows"], overlap["test_rows"], len(visible(train)),
            len(visible(test)), missing, extra, flagged,
            sum(found[n]["status"] == "insufficient_data" for n in found), len(missing) + len(extra),
            shift["max_class_rate_delta"] if shift else None, overlap["overlap_count"], overlap["overlap_rate"],
        )],
        "drift_score double, train_rows bigint, test_rows bigint, train_columns bigint, test_columns bigint, "
        "missing_columns_in_test array<string>, extra_columns_in_test array<string>, flagged_columns bigint, "
        "insufficient_data_columns bigint, schema_issue_count bigint, max_class_rate_delta double, "
        "overlap_count bigint, overlap_rate double",
    )
    local = lambda row: spark.createDataFrame([row]) if row else None
    return DriftReport(columns, local(shift), local(overlap), summary, drift_issues(columns, summary, target))


def drift_issues(columns: DataFrame, summary: DataFrame, target: str | None) -> DataFrame:
    """Issues raised by a comparison, after those of the tables themselves (texts are fixed values)."""
    columns, summary = (d.withColumn("dataset_role", F.lit("test")) for d in (columns, summary))
    name, is_number = F.col("column_name"), F.col("inferred_type") == "numeric"
    numeric = issue(
        "warning", "drift", F.concat(F.lit("Numeric drift in "), name),
        "The test mean differs substantially from the train mean.", [name],
        ["inspect split quality", "fit preprocessing on train only", "monitor feature drift"], DRIFT, F.col("ordinal"),
    )
    unseen = issue(
        "warning", "drift", F.concat(F.lit("Unseen categories in "), name),
        "The test set contains categories that do not appear in train.", [name],
        ["use unknown-safe encoding", "group rare categories", "inspect train/test split"], DRIFT, F.col("ordinal"),
    )
    flagged = F.col("drift_flag")
    mismatch = issue(
        "warning", "split", "Train/test column mismatch", "Train and test datasets do not have identical columns.",
        [], ["align train/test columns", "verify split/export process"], SCHEMA,
    ).withField("affected_columns", F.concat("missing_columns_in_test", "extra_columns_in_test"))
    shifted = issue(
        "warning", "target", "Train/test target distribution shift",
        "The target distribution differs between train and test.", [F.lit(target)] if target else [],
        ["use stratified splitting", "verify test set construction"], TARGET_SHIFT,
    )
    shared = issue(
        F.when(F.col("overlap_rate") >= 0.10, "critical").otherwise("warning"), "split",
        "Duplicate row overlap across train/test", "Some test rows also appear in train.", [],
        ["remove split leakage", "recreate train/test split"], OVERLAP,
    )
    return issues_from(columns, [F.when(flagged & is_number, numeric), F.when(flagged & ~is_number, unseen)]).unionByName(
        issues_from(
            summary,
            [
                F.when(F.col("schema_issue_count") > 0, mismatch),
                F.when(F.col("max_class_rate_delta") >= 0.20, shifted),
                F.when(F.col("overlap_rate") > 0, shared),
            ],
        )
    )
