"""Placeholder replacement, imputation and missing indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions.columns import PrepError, families
from tableprep.functions.rules import STEP_PLACEHOLDERS
from tableprep.functions.text import number_of, text_of
from tableprep.operators.steps.base import (
    Operation, choice, col, missing_counters, must_be, new_names, present,
)


class ReplacePlaceholderValues(Operation):
    """Exact matches (no trimming) become missing or a given value."""

    name = "replace_placeholder_values"
    defaults = {"placeholders": STEP_PLACEHOLDERS, "replacement": None}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        must_be(params, "placeholders", list, "a list")
        return params

    def _matches(self, df, name, placeholders):
        if families(df)[name] == "text":
            words = [p for p in placeholders if isinstance(p, str)]
            return col(name).isin(words) if words else F.lit(False)
        numbers = [p for p in placeholders if isinstance(p, (int, float)) and not isinstance(p, bool)]
        numeric = families(df)[name] in ("long", "double", "decimal")
        return col(name).isin(numbers) if numeric and numbers else F.lit(False)

    def transform(self, df, columns, fitted):
        exprs = {}
        for n in present(df, columns):
            value = F.lit(fitted["replacement"]).try_cast(df.schema[n].dataType)
            exprs[n] = F.when(self._matches(df, n, fitted["placeholders"]), value).otherwise(col(n))
        return df.withColumns(exprs)

    def counters(self, df, columns, fitted):
        changed = F.lit(0)
        for n in present(df, columns):
            matched = self._matches(df, n, fitted["placeholders"])
            if fitted["replacement"] is not None:
                matched = matched & (col(n) != F.lit(fitted["replacement"]))
            changed = changed + F.coalesce(matched, F.lit(False)).cast("long")
        return {"cells_replaced": changed}

    def summary(self, columns, params, counts):
        return f"Replaced {counts['cells_replaced']} placeholder values."


class NumericImputation(Operation):
    """Fill missing numbers with the mean, the exact median or a constant; text is read as numbers."""

    name = "numeric_imputation"
    defaults = {"strategy": "median", "fill_value": 0}

    def check(self, df, columns, params):
        params = super().check(df, columns, {k: v for k, v in params.items() if k != "fill_value" or v is not None})
        choice(params, "strategy", ["mean", "median", "constant"], self.name)
        return params

    def scalars(self, df, columns, params):
        if params["strategy"] == "mean":
            return {f"mean:{n}": F.avg(number_of(df, n)) for n in columns}
        return {}

    def quantiles(self, df, columns, params):
        return {n: (number_of(df, n), [0.5]) for n in columns} if params["strategy"] == "median" else {}

    def fit(self, df, columns, params, learned):
        pick = {
            "mean": lambda n: learned.scalars[f"mean:{n}"],
            "median": lambda n: learned.quantiles[n][0],
            "constant": lambda n: float(params["fill_value"]),
        }[params["strategy"]]
        return {"strategy": params["strategy"], "fill_values": {n: pick(n) for n in columns}}

    def _filled(self, df, name, value):
        number = number_of(df, name)
        if value is None:
            return number
        filled = F.coalesce(number, F.lit(float(value)))
        whole = families(df)[name] == "long" and float(value).is_integer()
        return F.coalesce(col(name).cast("bigint"), F.lit(int(value))) if whole else filled

    def transform(self, df, columns, fitted):
        values = {n: v for n, v in fitted["fill_values"].items() if n in df.columns}
        return df.withColumns({n: self._filled(df, n, v) for n, v in values.items()})

    def counters(self, df, columns, fitted):
        shown = present(df, columns)
        return missing_counters(df, shown, {n: self._filled(df, n, fitted["fill_values"][n]) for n in shown})

    def summary(self, columns, params, counts):
        return f"Filled numeric missing values using {params['strategy']}."


class CategoricalImputation(Operation):
    """Fill missing categories with the most frequent value or a constant label."""

    name = "categorical_imputation"
    defaults = {"strategy": "most_frequent", "fill_value": "__MISSING__"}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        choice(params, "strategy", ["most_frequent", "constant"], self.name)
        return params

    def categories(self, columns, params):
        return list(columns) if params["strategy"] == "most_frequent" else []

    def fit(self, df, columns, params, learned):
        if params["strategy"] == "constant":
            values = {n: str(params["fill_value"]) for n in columns}
        else:
            values = {n: learned.modes.get(n, "__MISSING__") for n in columns}
        return {"strategy": params["strategy"], "fill_values": values}

    def transform(self, df, columns, fitted):
        values = {n: v for n, v in fitted["fill_values"].items() if n in df.columns}
        return df.withColumns({n: F.coalesce(text_of(df, n), F.lit(v)) for n, v in values.items()})

    def counters(self, df, columns, fitted):
        shown = present(df, columns)
        return missing_counters(df, shown, {n: F.coalesce(text_of(df, n), F.lit(fitted["fill_values"][n])) for n in shown})

    def summary(self, columns, params, counts):
        return f"Filled categorical missing values using {params['strategy']}."


class AddMissingIndicator(Operation):
    name = "add_missing_indicator"
    defaults = {"suffix": "_was_missing"}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        params["suffix"] = str(params["suffix"])
        if not params["suffix"]:
            raise PrepError("suffix must not be empty")
        new_names(df, self.created(columns, params))
        return params

    def created(self, columns, params):
        return [f"{n}{params['suffix']}" for n in columns]

    def fit(self, df, columns, params, learned):
        return {"created_columns": self.created(columns, params), "suffix": params["suffix"]}

    def transform(self, df, columns, fitted):
        return df.withColumns({f"{n}{fitted['suffix']}": col(n).isNull().cast("int") for n in present(df, columns)})

    def summary(self, columns, params, counts):
        return f"Created {len(columns)} missingness indicators."
