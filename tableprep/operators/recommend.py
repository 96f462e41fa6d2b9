"""From issues to steps: suggested step, suggested list of steps, recommendations, advisories."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.rules import PRIORITY_RANK, SEVERITY_PRIORITY, SUGGESTED_PLACEHOLDERS

# Parameters of suggested steps.
PARAMS = {
    "remove_duplicate_rows": {"subset": [], "keep": "first"},
    "replace_placeholder_values": {"placeholders": SUGGESTED_PLACEHOLDERS, "replacement": None},
    "numeric_imputation": {"strategy": "median"},
    "categorical_imputation": {"strategy": "constant", "fill_value": "__MISSING__"},
    "text_basic_features": {
        "lowercase": False, "strip_whitespace": True, "create_length_feature": True,
        "create_word_count_feature": True, "drop_original": False,
    },
    "add_missing_indicator": {"suffix": "_was_missing"},
    "outlier_clipping": {"method": "iqr", "iqr_multiplier": 1.5},
    "rare_category_grouping": {"min_frequency": 0.01, "rare_label": "__RARE__", "include_missing": False},
    "drop_columns": {},
}
# Why a step is suggested.
REASONS = {
    "remove_duplicate_rows": "Duplicate rows can usually be removed before modeling after domain review.",
    "replace_placeholder_values": "Placeholder strings should be normalized to missing values before imputation.",
    "numeric_imputation": "Median imputation is a conservative numeric default that is robust to outliers.",
    "categorical_imputation": "A constant missing label preserves missingness as a model-visible category.",
    "text_basic_features": "Text feature extraction normalizes missing text to an empty string and adds usable length features.",
    "add_missing_indicator": "For this type, a missingness indicator is safer than changing the source value automatically.",
    "outlier_clipping": "IQR clipping limits extreme numeric values while fitting thresholds from the training data.",
    "rare_category_grouping": "Grouping rare categories reduces sparse categorical noise before encoding.",
}
# Why a column is suggested for dropping.
DROP_ID_REASON = "Nearly unique columns often act as identifiers rather than reusable predictors."
DROP_REASON = "The flagged column is unlikely to add stable predictive value without further justification."
# Order of suggested steps.
STEP_ORDER = {
    "remove_duplicate_rows": 0, "drop_columns": 10, "replace_placeholder_values": 20, "add_missing_indicator": 30,
    "numeric_imputation": 40, "categorical_imputation": 45, "text_basic_features": 50, "outlier_clipping": 60,
    "rare_category_grouping": 70,
}
# Titles of recommendations.
TITLES = {
    "remove_duplicate_rows": "Remove duplicate rows",
    "replace_placeholder_values": "Normalize placeholder missing values",
    "numeric_imputation": "Impute numeric missing values",
    "categorical_imputation": "Impute categorical missing values",
    "text_basic_features": "Create basic text preprocessing features",
    "outlier_clipping": "Clip numeric outliers",
    "rare_category_grouping": "Group rare categories",
    "add_missing_indicator": "Add missingness indicator columns",
}
DROP_TITLES = {
    "leakage": "Review and drop leakage-prone columns",
    "cardinality": "Drop likely identifier columns",
    "constant": "Drop constant or near-constant columns",
}
# Advice for issues no step can fix.
ADVICE = {
    "target": "This is not an in-place feature preprocessing step; handle it through split strategy, validation design, or model training settings.",
    "split": "Resolve the split issue before trusting preprocessing previews or model validation.",
    "drift": "Use train-only fitted preprocessing and inspect whether the split reflects deployment data.",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def suggested_steps(issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each issue with the step that would address it; operation null where there is none.

    The type of the first affected column comes from the train (or single) profile.
    """
    types = profiles.filter(F.col("dataset_role") != "test").select(
        F.col("column_name").alias("first_column"), F.col("inferred_type").alias("first_type")
    )
    category, title = F.col("category"), F.col("title")
    kind = F.coalesce("first_type", F.lit("unknown"))
    with_columns = F.size("affected_columns") > 0
    missing = (
        F.when(title.contains("Placeholder values"), "replace_placeholder_values")
        .when(kind == "numeric", "numeric_imputation")
        .when(kind.isin("categorical", "boolean"), "categorical_imputation")
        .when(kind == "text", "text_basic_features")
        .otherwise("add_missing_indicator")
    )
    operation = F.when(category == "duplicate", "remove_duplicate_rows").when(
        with_columns,
        F.when(category == "missingness", missing)
        .when(category == "outlier", "outlier_clipping")
        .when((category == "cardinality") & ~title.contains("ID-like"), "rare_category_grouping")
        .when(category.isin("cardinality", "constant", "leakage"), "drop_columns"),
    )
    params = {op: json.dumps(p, sort_keys=True) for op, p in PARAMS.items()}
    reason = F.when(
        F.col("operation_type") == "drop_columns",
        F.when(category == "cardinality", DROP_ID_REASON).otherwise(DROP_REASON),
    ).otherwise(_lookup(REASONS, F.col("operation_type")))
    return (
        issues.withColumn("first_column", F.get("affected_columns", F.lit(0)))
        .join(types, "first_column", "left")
        .withColumn("operation_type", operation)
        .withColumn("params_json", _lookup(params, F.col("operation_type")))
        .withColumn("reason", reason)
        .withColumn("step_columns", F.when(category == "duplicate", F.array().cast("array<string>")).otherwise(F.col("affected_columns")))
        .drop("first_column", "first_type")
    )


def _ordered(values: str, order: str = "issue_id") -> Column:
    """Values of a group in issue order, repeats removed."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: p["v"])))


def suggested_pipeline(issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Ordered steps: dropped columns leave the other steps, equal steps are merged."""
    steps = suggested_steps(issues, profiles).filter("operation_type IS NOT NULL")
    dropped = steps.filter("operation_type = 'drop_columns'").select(F.explode("step_columns").alias("name")).distinct()
    rows = steps.select(
        "issue_id", "operation_type", "params_json", "reason", F.explode_outer("step_columns").alias("name")
    )
    kept = rows.filter("operation_type IN ('drop_columns', 'remove_duplicate_rows')").unionByName(
        rows.filter("operation_type NOT IN ('drop_columns', 'remove_duplicate_rows')").join(dropped, "name", "left_anti")
    )
    kept = kept.withColumn("names", F.array_compact(F.array("name")))
    return (
        kept.groupBy("operation_type", "params_json")
        .agg(
            _ordered("names").alias("columns"),
            F.min_by("reason", "issue_id").alias("reason"),
            F.min("issue_id").alias("first_issue"),
        )
        .withColumn("step_order", _lookup(STEP_ORDER, F.col("operation_type")))
        .orderBy("step_order", "first_issue")
    )


def _priority() -> Column:
    return _lookup(SEVERITY_PRIORITY, F.col("severity"))


def advisories(issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Advice for target, split and drift issues, which no step fixes."""
    manual = suggested_steps(issues, profiles).filter(
        F.col("operation_type").isNull() & F.col("category").isin(list(ADVICE))
    )
    priority = F.when(F.col("category") == "drift", "medium").otherwise(_priority())
    return manual.select(
        priority.alias("priority"), "category", "title",
        F.concat_ws(" ", "explanation", _lookup(ADVICE, F.col("category"))).alias("rationale"),
        "affected_columns", F.array("issue_id").alias("issue_ids"),
        F.lit(None).cast("string").alias("operation_type"), F.lit(None).cast("string").alias("params_json"),
        F.lit(1).alias("manual"), F.col("issue_id").alias("first_issue"),
    )


def recommendations(issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """Recommendations and advisories by priority, category and title."""
    steps = suggested_steps(issues, profiles).filter("operation_type IS NOT NULL")
    drop_title = F.coalesce(_lookup(DROP_TITLES, F.col("category")), F.lit("Drop low-value columns"))
    title = F.when(F.col("operation_type") == "drop_columns", drop_title).otherwise(
        _lookup(TITLES, F.col("operation_type"))
    )
    ranks = {v: k for k, v in PRIORITY_RANK.items()}
    grouped = (
        steps.withColumn("priority_rank", _lookup(PRIORITY_RANK, _priority()))
        .groupBy("category", "operation_type", "params_json")
        .agg(
            F.min("priority_rank").alias("rank"),
            F.min_by("reason", "issue_id").alias("rationale"),
            _ordered("step_columns").alias("affected_columns"),
            F.sort_array(F.collect_list("issue_id")).alias("issue_ids"),
            F.min("issue_id").alias("first_issue"),
        )
        .select(
            _lookup(ranks, F.col("rank")).alias("priority"), "category", title.alias("title"), "rationale",
            "affected_columns", "issue_ids", "operation_type", "params_json", F.lit(0).alias("manual"), "first_issue",
        )
    )
    everything = reduce(DataFrame.unionByName, [grouped, advisories(issues, profiles)])
    return everything.withColumn("priority_rank", _lookup(PRIORITY_RANK, F.col("priority"))).orderBy(
        "priority_rank", "category", "title", "manual", "first_issue"
    )
