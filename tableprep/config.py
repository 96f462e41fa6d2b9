"""Settings and step records."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tableprep.functions.columns import PrepError, visible

# Semantic column types, modes and problem types.
COLUMN_TYPES = ["numeric", "categorical", "boolean", "datetime", "text", "unknown"]
PROBLEM_TYPES = ["classification", "regression", "unknown"]
MODES = ["single", "train_test"]


@dataclass(frozen=True)
class PrepConfig:
    """What an analysis needs to know about a table."""

    target_column: str | None = None
    problem_type: str = "unknown"
    mode: str = "single"
    column_type_overrides: dict[str, str] = field(default_factory=dict)
    missing_value_tokens: list[str] = field(default_factory=list)
    ignored_columns: list[str] = field(default_factory=list)

    def override(self, **settings: Any) -> PrepConfig:
        """A copy in which given settings win; type overrides are merged by column."""
        merged = {**self.__dict__, **settings}
        merged["column_type_overrides"] = {
            **self.column_type_overrides, **settings.get("column_type_overrides", {})
        }
        return PrepConfig(**merged)

    def check(self, df: DataFrame) -> None:
        """Raise before any job starts when the settings do not fit the table."""
        if self.mode not in MODES:
            raise PrepError("mode must be single or train_test")
        if self.problem_type not in PROBLEM_TYPES:
            raise PrepError(f"problem_type must be one of {', '.join(PROBLEM_TYPES)}")
        unknown = sorted(set(self.column_type_overrides.values()) - set(COLUMN_TYPES))
        if unknown:
            raise PrepError(f"Unknown column types: {', '.join(unknown)}")
        if self.target_column is not None:
            if self.target_column not in visible(df):
                raise PrepError(f"Target column does not exist: {self.target_column}")
            if self.target_column in self.ignored_columns:
                raise PrepError("Target column cannot be ignored")


@dataclass(frozen=True)
class Step:
    """One preprocessing operation of an ordered list."""

    operation_type: str
    columns: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    order_index: int = 0
    step_id: int | None = None


def in_order(steps: list[Step]) -> list[Step]:
    """Enabled steps by order index; list order decides equal indexes."""
    return sorted([s for s in steps if s.enabled], key=lambda s: s.order_index)
