"""A whole analysis run: clean, profile, issues, drift and score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tableprep.config import PrepConfig
from tableprep.functions.columns import PrepError
from tableprep.operators.drift import DriftReport, compare_tables
from tableprep.operators.issues import detect_issues, readiness_score
from tableprep.operators.profile import profile_table
from tableprep.operators.suggest import apply_missing_tokens, drop_ignored


@dataclass
class Analysis:
    profiles: DataFrame
    issues: DataFrame
    readiness: DataFrame
    drift: DriftReport | None = None


def prepare(df: DataFrame, config: PrepConfig) -> DataFrame:
    return drop_ignored(apply_missing_tokens(df, config.missing_value_tokens), config.ignored_columns)


def analyze(df: DataFrame, config: PrepConfig = PrepConfig(), test: DataFrame | None = None) -> Analysis:
    """Profiles, issues and readiness of a table, or of a train table compared with its test table."""
    config.check(df)
    if (config.mode == "train_test") != (test is not None):
        raise PrepError("train_test mode needs a train and a test table")
    target, kind = config.target_column, config.problem_type
    role = "single" if test is None else "train"
    table = prepare(df, config)
    profiles = profile_table(table, role, target, kind, config.column_type_overrides)
    issues = detect_issues(table, profiles, target, kind, role)
    if test is None:
        return Analysis(profiles, issues, readiness_score(issues))
    other = prepare(test, config)
    drift = compare_tables(table, other, profiles, target)
    other_profiles = profile_table(other, "test", target, kind, config.column_type_overrides)
    issues = issues.unionByName(drift.issues)
    return Analysis(profiles.unionByName(other_profiles), issues, readiness_score(issues), drift)
