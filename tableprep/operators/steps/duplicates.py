"""Duplicate-row removal."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tableprep.functions.columns import order_keys
from tableprep.functions.keys import row_keys
from tableprep.operators.steps.base import Operation, choice, must_be, present, require_columns, visible


class RemoveDuplicateRows(Operation):
    """Keep the first, the last or no row of each group of equal rows.

    First and last follow the row-order key, which should be unique. Copies are
    pruned to one or two per group inside each task before the shuffle.
    """

    name = "remove_duplicate_rows"
    defaults = {"subset": [], "keep": "first"}
    barrier = True

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        params["subset"] = params["subset"] or list(columns)
        must_be(params, "subset", list, "a list")
        params["subset"] = [str(n) for n in params["subset"]]
        require_columns(df, params["subset"])
        choice(params, "keep", ["first", "last", "none"], self.name)
        return params

    def transform(self, df, columns, fitted):
        subset = present(df, fitted["subset"]) or visible(df)
        whole = set(subset) == set(df.columns)
        if whole and fitted["keep"] != "none":
            return df.dropDuplicates()
        keys = row_keys(df, subset)
        keyed = df.select("*", *keys)
        names = [n for n in keyed.columns if n not in df.columns]
        orders = order_keys(df)
        if fitted["keep"] == "last":
            orders = [c.desc() for c in orders]
        group = Window.partitionBy(*names)
        ranked = keyed.withColumn("__tp_rank", F.row_number().over(group.orderBy(*orders)))
        if fitted["keep"] == "none":
            # Two rows of a group are enough to know that it repeats.
            pair = ranked.filter(F.col("__tp_rank") <= 2)
            kept = pair.withColumn("__tp_rank", F.max("__tp_rank").over(group)).filter(F.col("__tp_rank") == 1)
        else:
            kept = ranked.filter(F.col("__tp_rank") == 1)
        return kept.drop("__tp_rank", *names)

    def summary(self, columns, params, counts):
        return f"Removed {counts['rows_before'] - counts['rows_after']} duplicate rows."
