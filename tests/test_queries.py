"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "missing_tokens_to_null", "target_candidates_coded_customers", "numeric_summary_lineitem", "profile_table_doc_quality",
    "issues_all_scored", "category_shift", "row_overlap", "drift_issues", "recommendations_doc_quality", "dedupe_last",
    "rare_grouping_min_count", "ordinal_many_values", "clip_iqr", "apply_train_test", "step_effects", "csv_na_scan",
    "changed_columns", "changed_cells", "column_diffs_all_rows",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    got = check.rows_of(df.columns, df.collect())
    result = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert got == check.rows_of(columns, result.fetchall())


def test_every_query_has_sql_and_entry_runs(spark):
    from workload import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) <= set(contract.queries())
    rows = contract.entry(spark).collect()
    assert {r["column_name"] for r in rows} >= {"l_orderkey", "l_shipdate"}


def test_tasks_do_not_follow_the_number_of_small_splits(spark):
    df = contract.queries()["csv_multi_line_splits"](spark, "/root/testdata/sf0.1")
    assert df.first()["several"] and df.count() == 150_000
    # Each task writes a file; there are 136 splits.
    assert len(df.inputFiles()) <= 2 * 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
