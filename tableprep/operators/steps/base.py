"""What an operation declares: its parameters, what it must learn, and how it applies."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import PrepError, col, require_columns, visible


@dataclass
class Learned:
    """Statistics an operation asked for: scalars, quantiles, and value counts per column."""

    scalars: dict[str, Any] = field(default_factory=dict)
    quantiles: dict[str, list[float | None]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    frequencies: DataFrame | None = None

    def values_of(self, column: str) -> DataFrame:
        return self.frequencies.filter(F.col("column_name") == column).select("value", "n")


class Operation:
    """Base of all operations; stateless ones override ``check`` and ``transform`` only."""

    name = ""
    defaults: dict[str, Any] = {}
    # A barrier changes rows or the column list, so nothing is fitted across it in one pass.
    barrier = False

    def check(self, df: DataFrame, columns: list[str], params: dict[str, Any]) -> dict[str, Any]:
        """Resolved parameters; raises PrepError on values that make no sense."""
        return {**self.defaults, **params}

    def created(self, columns: list[str], params: dict[str, Any]) -> list[str]:
        """Names of new columns, as far as they are known before the fit."""
        return []

    def scalars(self, df: DataFrame, columns: list[str], params: dict[str, Any]) -> dict[str, Column]:
        return {}

    def quantiles(self, df: DataFrame, columns: list[str], params: dict[str, Any]) -> dict[str, tuple[Column, list[float]]]:
        return {}

    def categories(self, columns: list[str], params: dict[str, Any]) -> list[str]:
        """Columns whose value counts are needed."""
        return []

    def fit(self, df: DataFrame, columns: list[str], params: dict[str, Any], learned: Learned) -> dict[str, Any]:
        return dict(params)

    def transform(self, df: DataFrame, columns: list[str], fitted: dict[str, Any]) -> DataFrame:
        raise NotImplementedError

    def counters(self, df: DataFrame, columns: list[str], fitted: dict[str, Any]) -> dict[str, Column]:
        """Per-row counts (on the step's input) of what the step changes."""
        return {}

    def summary(self, columns: list[str], params: dict[str, Any], counts: dict[str, int]) -> str:
        return ""


def choice(params: dict[str, Any], key: str, allowed: list[str], operation: str) -> None:
    if params[key] not in allowed:
        raise PrepError(f"{operation} {key} must be one of {', '.join(allowed)}")


def must_be(params: dict[str, Any], key: str, kind: type, word: str) -> None:
    if not isinstance(params[key], kind):
        raise PrepError(f"{key} must be {word}")


def new_names(df: DataFrame, names: list[str], replaced: list[str] = ()) -> None:
    """Refuse to create a column over another one."""
    clash = [n for n in names if n in df.columns and n not in replaced]
    if clash or len(set(names)) < len(names):
        raise PrepError(f"Columns already exist: {', '.join(clash or names)}")


def present(df: DataFrame, columns: list[str]) -> list[str]:
    return [n for n in columns if n in visible(df)]


def missing_counters(df: DataFrame, columns: list[str], after: dict[str, Column]) -> dict[str, Column]:
    """Missing cells before and after, per column."""
    out = {}
    for n in columns:
        out[f"missing_before:{n}"] = col(n).isNull().cast("long")
        out[f"missing_after:{n}"] = after[n].isNull().cast("long")
    return out


__all__ = [
    "Learned", "Operation", "PrepError", "choice", "col", "missing_counters", "must_be", "new_names", "present",
    "require_columns", "visible",
]
