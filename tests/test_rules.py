import pytest
from pyspark.sql import functions as F

from tableprep import PrepConfig, analyze, compare_tables, detect_issues, issue_list, profile_table, readiness_score
from tableprep import recommendations, suggested_pipeline
from tableprep.operators import charts, drift
from tableprep.operators.issues import duplicate_counts


def test_issues_and_score_of_dirty_table(dirty):
    p = profile_table(dirty, target="target", problem_type="classification")
    issues = detect_issues(dirty, p, "target", "classification")
    titles = {r["title"]: r["severity"] for r in issues.collect()}
    assert titles["Missing values in age"] == "warning"
    assert titles["Duplicate rows detected"] == "critical"
    assert titles["Placeholder values in city"] == "warning"
    row = readiness_score(issues).first()
    assert row["score"] == max(0.0, 100 - 12 * row["critical_count"] - 5 * row["warning_count"] - 1.5 * row["info_count"])
    ranks = [r["severity_rank"] for r in issue_list(issues).collect()]
    assert ranks == sorted(ranks)


def test_duplicates_see_missing_as_equal(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 1.0), ("a", "", 1.0), ("b", None, 0.0), ("b", None, -0.0)], "x string, y string, z double")
    row = duplicate_counts(df).first()
    assert (row["row_count"], row["duplicate_count"]) == (5, 2)


def test_digest_does_not_confuse_cell_borders(spark):
    df = spark.createDataFrame([("a|1:b", "c"), ("a", "b|1:c"), ("a", "b")], "x string, y string")
    assert duplicate_counts(df).first()["duplicate_count"] == 0


def test_drift_of_the_pair(drifted):
    train, test = drifted
    report = compare_tables(train, test, profile_table(train, "train", "target", "classification"), "target")
    s = report.summary.first()
    assert s["overlap_count"] == 1 and s["overlap_rate"] == 0.2
    city = report.columns.filter("column_name = 'city'").first()
    assert city["unseen_category_count"] == 2 and city["unseen_categories"] == ["Denver", "Miami"]
    assert city["unseen_row_rate"] == pytest.approx(0.6)
    assert report.target.first()["max_class_rate_delta"] >= 0.5
    assert s["drift_score"] == 100.0
    assert {r["category"] for r in report.issues.collect()} == {"drift", "target", "split"}


def test_numeric_shift_without_numbers(spark):
    train, test = spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([(None,)], "x double")
    row = drift.numeric_shift(train, test, ["x"]).first()
    assert row["status"] == "insufficient_data" and not row["drift_flag"]


def test_overlap_counts_repeated_rows_once_per_test_row(spark):
    train = spark.createDataFrame([("a", 1)] * 3 + [(None, 2)], "x string, y int")
    test = spark.createDataFrame([("a", 1)] * 2 + [(None, 2), ("b", 1)], "x string, y int")
    assert drift.row_overlap(train, test).first()["overlap_count"] == 3


def test_schema_difference_is_an_issue(drifted):
    train, test = drifted
    test = test.withColumnRenamed("income", "pay")
    report = compare_tables(train, test, profile_table(train, "train"), "target")
    row = report.issues.filter("title = 'Train/test column mismatch'").first()
    assert row["affected_columns"] == ["income", "pay"]


def test_train_test_analysis_and_recommendations(drifted):
    train, test = drifted
    run = analyze(train, PrepConfig("target", "classification", "train_test"), test)
    assert [r["label"] for r in charts.columns_by_role(run.profiles).collect()] == ["test", "train"]
    recs = recommendations(run.issues, run.profiles).collect()
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    assert [order[r["priority"]] for r in recs] == sorted(order[r["priority"]] for r in recs)
    assert all(r["priority"] == "medium" for r in recs if r["category"] == "drift")
    assert any(r["title"] == "Duplicate row overlap across train/test" for r in recs)


def test_suggested_steps_drop_wins_and_merge(dirty):
    p = profile_table(dirty, overrides={"age": "numeric", "income": "numeric"})
    steps = suggested_pipeline(detect_issues(dirty, p), p).collect()
    assert [s["operation_type"] for s in steps][:2] == ["remove_duplicate_rows", "replace_placeholder_values"]
    numeric = next(s for s in steps if s["operation_type"] == "numeric_imputation")
    assert numeric["columns"] == ["age", "income"]
    assert [s["step_order"] for s in steps] == sorted(s["step_order"] for s in steps)


def test_column_charts(dirty):
    p = profile_table(dirty)
    city = {r["label"]: r["value"] for r in charts.missing_vs_present(p.filter(F.col("column_name") == "city")).collect()}
    assert city == {"missing": 0, "present": 5}


def test_every_rule_keeps_its_rows_beside_empty_ones(spark):
    """No duplicates between column issues and an imbalanced target: all of them are reported."""
    df = spark.createDataFrame([(float(i), "rare" if i == 0 else "often") for i in range(30)], "x double, label string")
    issues = detect_issues(df, profile_table(df, target="label", problem_type="classification"), "label", "classification")
    assert {r["title"] for r in issues.collect()} == {"Possible ID-like column x", "Imbalanced target"}
