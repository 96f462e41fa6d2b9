"""Cleaned data and config outputs of a run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, functions as F

from tableprep.config import Step
from tableprep.functions.columns import PrepError, col, families, visible
from tableprep.operators.pipeline import FittedPipeline, Pipeline
from tableprep.operators.profile import table_summary


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> dict[str, Any]:
    """Write the data columns of a table as CSV with header or as parquet; returns the summary of what was written.

    The counts are observed in the tasks that write, whose results Spark counts once however often a task is run, so the
    table is not read again for them.
    """
    data = df.select(*[col(n) for n in visible(df)])
    names, kinds, seen = data.columns, families(data), Observation()
    # NaN counts as missing, as everywhere, and is written as it is.
    cell = lambda n: F.when(~F.isnan(col(n)), col(n)) if kinds[n] == "double" else col(n)
    data = data.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(cell(n)).alias(f"p{i}") for i, n in enumerate(names)])
    if fmt == "csv":
        data.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        data.write.mode("overwrite").parquet(path)
    else:
        raise PrepError("format must be csv or parquet")
    counts = seen.get
    missing = len(names) * counts["rows"] - sum(counts[f"p{i}"] for i in range(len(names)))
    return {
        "row_count": counts["rows"], "column_count": len(names), "missing_cells": missing,
        "missing_rate": missing / max(counts["rows"] * len(names), 1), "columns": names,
    }


def apply_and_export(
    df: DataFrame, steps: list[Step], folder: str, *, test: DataFrame | None = None, name: str = "pipeline",
    target: str | None = None, problem_type: str = "unknown", fmt: str = "csv", inputs: list[str] = (),
) -> tuple[FittedPipeline, dict[str, str]]:
    """Fit, transform, and write the cleaned table (or train and test) with the fitted config."""
    mode = "single" if test is None else "train_test"
    fitted, cleaned = Pipeline(steps, name, mode).fit_transform(df)
    if test is None:
        outputs = {"cleaned_single": (cleaned, f"{folder}/cleaned_dataset")}
    else:
        outputs = {
            "cleaned_train": (cleaned, f"{folder}/clean_train"),
            "cleaned_test": (fitted.transform(test), f"{folder}/clean_test"),
        }
    written = [write_table(table, path, fmt) for table, path in outputs.values()]
    fitted.save(
        df.sparkSession, folder, target_column=target, problem_type=problem_type, input_file_names=list(inputs),
        output_file_names=[path.rsplit("/", 1)[1] for _, path in outputs.values()],
        metadata={"before_summary": table_summary(df).first().asDict(), "after_summary": written[0]},
    )
    return fitted, {key: path for key, (_, path) in outputs.items()} | {"config": f"{folder}/config"}
