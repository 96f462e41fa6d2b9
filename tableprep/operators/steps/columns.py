"""Operations on the column list: drop, rename, reorder."""

from __future__ import annotations

from tableprep.operators.steps.base import Operation, PrepError, col, must_be, require_columns, visible


class DropColumns(Operation):
    name = "drop_columns"
    barrier = True

    def fit(self, df, columns, params, learned):
        return {"columns": list(columns)}

    def transform(self, df, columns, fitted):
        return df.drop(*[n for n in fitted["columns"] if n in df.columns])

    def summary(self, columns, params, counts):
        return f"Dropped {len(columns)} columns."


class RenameColumns(Operation):
    name = "rename_columns"
    defaults = {"rename_map": {}}
    barrier = True

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        must_be(params, "rename_map", dict, "an object")
        params["rename_map"] = {str(k): str(v) for k, v in params["rename_map"].items()}
        self._check_names(df, params["rename_map"])
        return params

    def _check_names(self, df, mapping):
        require_columns(df, list(mapping))
        after = [mapping.get(n, n) for n in df.columns]
        twice = sorted({n for n in after if after.count(n) > 1})
        if twice:
            raise PrepError(f"Rename target already exists: {', '.join(twice)}")

    def transform(self, df, columns, fitted):
        self._check_names(df, fitted["rename_map"])
        return df.withColumnsRenamed(fitted["rename_map"])

    def summary(self, columns, params, counts):
        return "Renamed columns."


class ReorderColumns(Operation):
    name = "reorder_columns"
    defaults = {"column_order": []}
    barrier = True

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        must_be(params, "column_order", list, "a list")
        params["column_order"] = [str(n) for n in params["column_order"]]
        require_columns(df, params["column_order"])
        return params

    def transform(self, df, columns, fitted):
        first = fitted["column_order"]
        require_columns(df, first)
        rest = [n for n in visible(df) if n not in first] + [n for n in df.columns if n not in visible(df)]
        return df.select(*[col(n) for n in [*first, *rest]])

    def summary(self, columns, params, counts):
        return "Reordered columns."
