"""Issue rules over profiles and tables, and the readiness score.

Thresholds, titles, explanations and suggested actions are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import col, count_if, local_table, nan_to_null, visible
from tableprep.functions.keys import row_keys
from tableprep.functions.rules import LEAKAGE_TERMS, SEVERITY_PENALTY, SEVERITY_RANK
from tableprep.functions.text import percent
from tableprep.operators.profile import profile_table

ISSUE_COLUMNS = [
    "issue_id", "dataset_role", "severity", "category", "title", "explanation", "affected_columns",
    "suggested_actions",
]
# Position of a rule in a run's issue list; ids sort in the order issues are raised.
MISSING, COLUMN, DUPLICATE, PLACEHOLDER, LEAKAGE, TARGET, SCHEMA, DRIFT, TARGET_SHIFT, OVERLAP = range(1, 11)


def issue(
    severity: Column | str, category: str, title: Column | str, explanation: Column | str,
    columns: list[Column], actions: list[str], rule: int, ordinal: Column | int = 0, part: int = 0,
) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    affected = F.array(*columns) if columns else F.array()
    return F.struct(
        (F.lit(rule * 100_000_000 + part).cast("bigint") + lit(ordinal).cast("bigint") * 10).alias("issue_id"),
        F.col("dataset_role"),
        lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        lit(title).alias("title"),
        lit(explanation).alias("explanation"),
        affected.cast("array<string>").alias("affected_columns"),
        F.array(*map(F.lit, actions)).alias("suggested_actions"),
    )


def issues_from(rows: DataFrame, candidates: list[Column]) -> DataFrame:
    """Turn conditional issue structs (null where a rule does not hold) into issue rows."""
    return rows.select(F.explode(F.array_compact(F.array(*candidates))).alias("i")).select("i.*")


def missingness_issues(profiles: DataFrame) -> DataFrame:
    rate = F.col("missing_rate")
    severity = F.when(rate >= 0.50, "critical").when(rate >= 0.10, "warning").otherwise("info")
    found = issue(
        severity, "missingness", F.concat(F.lit("Missing values in "), "column_name"),
        F.concat(percent(rate), F.lit(" of values are missing.")), [F.col("column_name")],
        ["impute missing values", "add missingness indicator", "drop column if missingness is too high"],
        MISSING, F.col("ordinal"),
    )
    return issues_from(profiles, [F.when(rate > 0, found)])


def constant_issues(profiles: DataFrame) -> DataFrame:
    return issues_from(profiles, _constant_rules())


def _constant_rules() -> list[Column]:
    name, dominant = F.col("column_name"), F.coalesce("dominant_value_rate", F.lit(0.0))
    constant = issue(
        "critical", "constant", F.concat(F.lit("Constant column "), name),
        "The column has one or zero unique non-missing values.", [name], ["drop column"],
        COLUMN, F.col("ordinal"), 1,
    )
    near = issue(
        "warning", "constant", F.concat(F.lit("Near-constant column "), name),
        F.concat(F.lit("The dominant value covers "), percent(dominant), F.lit(" of non-missing rows.")),
        [name], ["drop column", "keep only with domain justification"], COLUMN, F.col("ordinal"), 1,
    )
    return [F.when(F.col("unique_count") <= 1, constant).when(dominant >= 0.95, near)]


def cardinality_issues(profiles: DataFrame) -> DataFrame:
    return issues_from(profiles, _cardinality_rules())


def id_like_issues(profiles: DataFrame) -> DataFrame:
    return issues_from(profiles, _id_rules())


def _cardinality_rules() -> list[Column]:
    name = F.col("column_name")
    high = issue(
        "warning", "cardinality", F.concat(F.lit("High-cardinality categorical column "), name),
        "The column has many unique categories relative to row count.", [name],
        ["group rare categories", "frequency encode", "drop ID-like column"], COLUMN, F.col("ordinal"), 2,
    )
    many = (F.col("inferred_type") == "categorical") & (F.col("unique_count") > 50)
    return [F.when(many & (F.col("cardinality_ratio") > 0.20), high)]


def _id_rules() -> list[Column]:
    name = F.col("column_name")
    unique = issue(
        "warning", "cardinality", F.concat(F.lit("Possible ID-like column "), name),
        "The column is nearly unique per row.", [name],
        ["drop ID-like column", "keep only with domain justification"], COLUMN, F.col("ordinal"), 3,
    )
    return [F.when((F.col("cardinality_ratio") > 0.90) & (F.col("unique_count") > 10), unique)]


def outlier_issues(profiles: DataFrame) -> DataFrame:
    return issues_from(profiles, _outlier_rules())


def _outlier_rules() -> list[Column]:
    name, rate = F.col("column_name"), F.coalesce("outlier_rate_iqr", F.lit(0.0))
    text = F.concat(F.lit("IQR rule flags "), percent(rate), F.lit(" of numeric values as outliers."))
    many = issue(
        "warning", "outlier", F.concat(F.lit("Outliers detected in "), name), text, [name],
        ["percentile clipping", "IQR clipping", "log1p transform", "leave unchanged if meaningful"],
        COLUMN, F.col("ordinal"), 4,
    )
    some = issue(
        "info", "outlier", F.concat(F.lit("Some outliers in "), name), text, [name],
        ["inspect outliers", "clip if appropriate"], COLUMN, F.col("ordinal"), 4,
    )
    return [F.when(rate >= 0.05, many).when(rate > 0, some)]


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows and duplicate rows of a table; copies collapse inside each task before the shuffle."""
    df = nan_to_null(df)
    groups = df.groupBy(*row_keys(df, visible(df))).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    )


def duplicate_issues(df: DataFrame, role: str = "single") -> DataFrame:
    counts = duplicate_counts(df).withColumn("dataset_role", F.lit(role))
    rate = F.col("duplicate_count") / F.greatest("row_count", F.lit(1))
    found = issue(
        F.when(rate >= 0.10, "critical").otherwise("warning"), "duplicate", "Duplicate rows detected",
        F.concat(F.col("duplicate_count").cast("string"), F.lit(" duplicate rows were found.")), [],
        ["remove duplicate rows", "inspect whether duplicates are legitimate repeated observations"], DUPLICATE,
    )
    return issues_from(counts, [F.when(F.col("duplicate_count") > 0, found)])


def placeholder_issues(profiles: DataFrame) -> DataFrame:
    name, n = F.col("column_name"), F.col("placeholder_count")
    found = issue(
        "warning", "missingness", F.concat(F.lit("Placeholder values in "), name),
        F.concat(n.cast("string"), F.lit(" placeholder strings may represent missing values.")), [name],
        ["replace placeholder values with missing", "impute missing values"], PLACEHOLDER, F.col("ordinal"),
    )
    return issues_from(profiles, [F.when(n > 0, found)])


def leakage_issues(profiles: DataFrame, target: str | None) -> DataFrame:
    name = F.col("column_name")
    suspicious = reduce(Column.__or__, [F.lower(name).contains(term) for term in LEAKAGE_TERMS])
    found = issue(
        "warning", "leakage", F.concat(F.lit("Possible leakage feature "), name),
        "The column name looks related to the target or final outcome.", [name],
        ["inspect feature timing", "drop leakage-prone feature"], LEAKAGE, F.col("ordinal"),
    )
    return issues_from(profiles, [F.when(F.lit(target is not None) & (name != F.lit(target)) & suspicious, found)])


def imbalance_issues(df: DataFrame, target: str, role: str = "single") -> DataFrame:
    """Majority class share of a classification target; class counts are pre-aggregated."""
    classes = nan_to_null(df).filter(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    share = classes.agg((F.max("n") / F.sum("n")).alias("rate")).withColumn("dataset_role", F.lit(role))
    found = issue(
        "warning", "target", "Imbalanced target",
        F.concat(F.lit("The majority class covers "), percent(F.col("rate")), F.lit(" of labeled rows.")),
        [F.lit(target)],
        ["review class distribution", "use stratified split", "consider class weighting during modeling"], TARGET,
    )
    return issues_from(share, [F.when(F.col("rate") >= 0.90, found)])


def detect_issues(
    df: DataFrame, profiles: DataFrame, target: str | None = None, problem_type: str = "unknown",
    role: str = "single",
) -> DataFrame:
    """All issues of a table; ``issue_id`` sorts them in rule order."""
    per_column = _constant_rules() + _cardinality_rules() + _id_rules() + _outlier_rules()
    known = target in visible(df)
    rules = [missingness_issues(profiles), issues_from(profiles, per_column), placeholder_issues(profiles)]
    rules += [leakage_issues(profiles, target)] if known else []
    parts = [reduce(DataFrame.unionByName, rules), duplicate_issues(df, role)]
    parts += [imbalance_issues(df, target, role)] if known and problem_type == "classification" else []
    return local_table(*parts)


def readiness_score(issues: DataFrame, default_score: float = 100.0) -> DataFrame:
    """Score, counts per severity, total penalty and band, in one row."""
    counts = issues.agg(*[count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITY_PENALTY])
    penalty = sum((F.col(f"{s}_count") * F.lit(p) for s, p in SEVERITY_PENALTY.items()), F.lit(0.0))
    scored = counts.withColumn("penalty", penalty).withColumn(
        "score", F.greatest(F.lit(0.0), F.lit(float(default_score)) - F.col("penalty"))
    )
    total = sum((F.col(f"{s}_count") for s in SEVERITY_PENALTY), F.lit(0))
    return scored.withColumn("issue_count", total).withColumn("band", readiness_band(F.col("score")))


def readiness_band(score: Column) -> Column:
    return F.when(score >= 85, "Ready").when(score >= 65, "Needs Review").otherwise("High Risk")


def readiness_for_table(df: DataFrame, target: str | None = None, problem_type: str = "unknown") -> DataFrame:
    """Profile, issues and score of any table; a target that is absent is ignored."""
    target = target if target in visible(df) else None
    return readiness_score(detect_issues(df, profile_table(df, target=target), target, problem_type))


def issue_list(issues: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """Issues by importance: severity, category, title, id."""
    if severity:
        issues = issues.filter(F.col("severity") == severity)
    if category:
        issues = issues.filter(F.col("category") == category)
    rank = F.create_map(*[x for s, r in SEVERITY_RANK.items() for x in (F.lit(s), F.lit(r))])[F.col("severity")]
    return issues.withColumn("severity_rank", rank).orderBy("severity_rank", "category", "title", "issue_id")
