"""tableprep: profiling, issue finding, drift and leakage-safe preprocessing of tables on Spark."""

from tableprep.config import PrepConfig, Step
from tableprep.functions.columns import PrepError, with_row_order
from tableprep.operators.analysis import Analysis, analyze
from tableprep.operators.compare import changed_cells, changed_columns, column_fingerprints
from tableprep.operators.drift import compare_tables
from tableprep.operators.issues import detect_issues, issue_list, readiness_for_table, readiness_score
from tableprep.operators.pipeline import FittedPipeline, Pipeline, load_config
from tableprep.operators.preview import preview_single, preview_train_test
from tableprep.operators.profile import profile_table, table_summary
from tableprep.operators.recommend import recommendations, suggested_pipeline
from tableprep.operators.suggest import suggest_setup
from tableprep.sources.csv import CsvError, ingest_stats, read_csv, table_preview
from tableprep.sources.results import latest_per_key, list_results, newest_first, run_history, store_results
from tableprep.sources.sinks import apply_and_export, write_table

__all__ = [
    "Analysis", "CsvError", "FittedPipeline", "Pipeline", "PrepConfig", "PrepError", "Step", "analyze",
    "apply_and_export", "changed_cells", "changed_columns", "column_fingerprints", "compare_tables", "detect_issues", "ingest_stats", "issue_list", "latest_per_key",
    "list_results", "load_config", "newest_first", "preview_single", "preview_train_test", "profile_table", "read_csv",
    "readiness_for_table", "readiness_score", "recommendations", "run_history", "store_results", "suggest_setup",
    "suggested_pipeline", "table_preview", "table_summary", "with_row_order", "write_table",
]
