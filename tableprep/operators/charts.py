"""Chart and report tables: small aggregates over profiles, issues, drift and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHART_ROWS = 30


def _count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("value")).orderBy("label")


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return _count_by(issues, "severity")


def issues_by_category(issues: DataFrame) -> DataFrame:
    return _count_by(issues, "category")


def columns_by_type(profiles: DataFrame) -> DataFrame:
    return _count_by(profiles, "inferred_type")


def _top_rate(profiles: DataFrame, rate: str) -> DataFrame:
    rows = profiles.select(F.col("column_name").alias("label"), F.round(rate, 4).alias("value"), "dataset_role", "ordinal")
    role_order = F.when(F.col("dataset_role") == "test", 1).otherwise(0)
    return rows.orderBy(F.desc("value"), role_order, "ordinal").limit(CHART_ROWS)


def missing_rates(profiles: DataFrame) -> DataFrame:
    return _top_rate(profiles, "missing_rate")


def cardinality_ratios(profiles: DataFrame) -> DataFrame:
    return _top_rate(profiles, "cardinality_ratio")


def drift_rows(drift_columns: DataFrame, drift_summary: DataFrame) -> DataFrame:
    """Overall drift score, then mean shift or unseen rate per compared column."""
    overall = drift_summary.select(
        F.lit(-1).cast("bigint").alias("ordinal"), F.lit("overall_drift_score").alias("label"),
        F.round("drift_score", 4).alias("value"),
    )
    value = F.coalesce("standardized_mean_diff", "unseen_row_rate")
    per_column = drift_columns.filter(value.isNotNull()).select(
        "ordinal", F.col("column_name").alias("label"), F.round(value, 4).alias("value")
    )
    return overall.unionByName(per_column).orderBy("ordinal")


def missing_vs_present(profiles: DataFrame) -> DataFrame:
    """Missing and present cells of each column."""
    present = F.coalesce("count", F.col("row_count") - F.col("missing_count"))
    flat = profiles.select(
        "ordinal", "column_name", F.col("missing_count").alias("missing"), present.alias("present")
    )
    return flat.unpivot(["ordinal", "column_name"], ["missing", "present"], "label", "value")


def numeric_points(profiles: DataFrame) -> DataFrame:
    """Five-number summary and mean of each numeric column."""
    points = ["min", "q1", "median", "q3", "max", "mean"]
    flat = profiles.filter("inferred_type = 'numeric'").select("ordinal", "column_name", *[F.round(p, 4).alias(p) for p in points])
    return flat.unpivot(["ordinal", "column_name"], points, "label", "value").filter("value IS NOT NULL")


def top_value_rows(profiles: DataFrame) -> DataFrame:
    """Top values of each categorical column, one row per value."""
    rows = profiles.select("ordinal", "column_name", F.posexplode("top_values").alias("position", "top"))
    return rows.select(
        "ordinal", "column_name", (F.col("position") + 1).cast("bigint").alias("rank"),
        F.col("top.value").alias("label"), F.col("top.count").alias("value"),
    )


def class_balance_rows(class_counts: DataFrame) -> DataFrame:
    return class_counts.select(F.col("class").alias("label"), F.col("class_count").alias("value"))


def shape_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and missing rate before and after, from two table summaries."""
    flat = lambda df, when: df.select(
        F.lit(when).alias("moment"), F.col("row_count").cast("double").alias("rows"),
        F.col("column_count").cast("double").alias("columns"), F.round("missing_rate", 4).alias("missing_rate"),
    )
    both = flat(before, "before").unionByName(flat(after, "after"))
    return both.unpivot(["moment"], ["rows", "columns", "missing_rate"], "measure", "value")


def worst_missing_columns(profiles: DataFrame, limit: int = 10) -> DataFrame:
    return profiles.orderBy(F.desc("missing_rate"), F.desc("missing_count"), "ordinal").limit(limit)


def highest_cardinality_columns(profiles: DataFrame, limit: int = 10) -> DataFrame:
    return profiles.orderBy(F.desc("cardinality_ratio"), "ordinal").limit(limit)


def columns_by_role(profiles: DataFrame) -> DataFrame:
    return _count_by(profiles, "dataset_role")


def warning_rows(profiles: DataFrame, limit: int = 50) -> DataFrame:
    rows = profiles.select("dataset_role", "ordinal", "column_name", F.posexplode("warnings").alias("position", "warning"))
    return rows.orderBy("dataset_role", "ordinal", "position").limit(limit)


def first_issues(issues: DataFrame, limit: int = 25) -> DataFrame:
    return issues.orderBy("issue_id").limit(limit)
