"""Operations that learn category maps: rare grouping and the three encodings."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from tableprep.functions.columns import PrepError
from tableprep.functions.text import text_of
from tableprep.operators.steps.base import Operation, choice, must_be, present
from tableprep.plans.maps import CategoryMap, drop_helpers, lookup, sorted_codes


class RareCategoryGrouping(Operation):
    """Values below a train frequency, and values unseen in train, become one label."""

    name = "rare_category_grouping"
    defaults = {"min_frequency": 0.01, "min_count": None, "rare_label": "__RARE__", "include_missing": False}

    def categories(self, columns, params):
        return list(columns)

    def scalars(self, df, columns, params):
        return {"rows": F.count(F.lit(1))}

    def fit(self, df, columns, params, learned):
        rows, least = learned.scalars["rows"], params["min_count"]
        threshold = int(least) if least is not None else max(1, math.ceil(rows * float(params["min_frequency"])))
        frequent = {}
        for n in columns:
            kept = learned.values_of(n).filter(F.col("n") >= threshold).withColumn("code", F.lit(True))
            # At most rows/threshold values can reach the threshold.
            size = min(learned.sizes.get(n, 0), learned.totals.get(n, 0) // max(threshold, 1))
            frequent[n] = CategoryMap.learn(kept, size, "frequent")
        return {
            "frequent_values": frequent, "rare_label": str(params["rare_label"]),
            "include_missing": bool(params["include_missing"]),
        }

    def transform(self, df, columns, fitted):
        maps = {n: m for n, m in fitted["frequent_values"].items() if n in df.columns}
        text = {n: text_of(df, n) for n in maps}
        helped, codes = lookup(df, {n: (text[n], m) for n, m in maps.items() if m.inline is None}, "boolean")
        label, grouped = F.lit(fitted["rare_label"]), {}
        missing = label if fitted["include_missing"] else F.lit(None).cast("string")
        for n, mapping in maps.items():
            known = codes[n].isNotNull() if n in codes else text[n].isin(list(mapping.inline)) if mapping.inline else F.lit(False)
            grouped[n] = F.when(text[n].isNull(), missing).when(known, text[n]).otherwise(label)
        return drop_helpers(helped.withColumns(grouped), df) if grouped else df

    def summary(self, columns, params, counts):
        return "Grouped rare categories using train frequencies."


class OneHotEncoding(Operation):
    """One 0/1 column per train category in text order; missing and unseen values are all 0.

    ``max_categories`` bounds the columns; without it there is one for every category, however many. For columns of
    very many categories ``output: "index"`` gives one column instead, ``<column>_index``: the place of the 1 (from 0,
    in text order), or null where all would be 0. Its map is looked up like any other and has no size limit.
    """

    name = "one_hot_encoding"
    defaults = {"drop_first": False, "max_categories": None, "handle_unknown": "ignore", "output": "columns"}
    barrier = True

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        choice(params, "handle_unknown", ["ignore"], self.name)
        choice(params, "output", ["columns", "index"], self.name)
        return params

    def categories(self, columns, params):
        return list(columns)

    def fit(self, df, columns, params, learned):
        limit, first = params["max_categories"], int(bool(params["drop_first"]))
        if params["output"] == "index":
            mappings = {}
            for n in columns:
                codes = sorted_codes(learned.values_of(n))
                codes = codes if limit is None else codes.filter(F.col("code") < int(limit))
                kept = codes.filter(F.col("code") >= first).withColumn("code", F.col("code") - first)
                mappings[n] = CategoryMap.learn(kept, learned.sizes.get(n, 0), "one_hot")
            return {"mappings": mappings, "drop_first": bool(first)}
        categories = {}
        for n in columns:
            ordered = learned.values_of(n).orderBy("value")
            ordered = ordered if limit is None else ordered.limit(int(limit))
            categories[n] = [r["value"] for r in ordered.select("value").collect()][first:]
        created = [name for n in columns for name, _ in self._names(n, categories[n])]
        remaining = set(df.columns) - set(columns)
        twice = sorted(n for n, times in Counter(created).items() if times > 1 or n in remaining)
        if twice:
            raise PrepError(f"Encoded columns share a name: {', '.join(twice)}")
        return {"categories": categories, "drop_first": bool(first)}

    def _names(self, column, categories):
        safe = lambda text: "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in text)
        return [(f"{column}_{safe(c)}", c) for c in categories]

    def transform(self, df, columns, fitted):
        shown, encoded = present(df, columns), {}
        if "mappings" in fitted:
            helped, codes = lookup(df, {n: (text_of(df, n), fitted["mappings"][n]) for n in shown}, "bigint")
            return drop_helpers(helped.withColumns({f"{n}_index": code for n, code in codes.items()}), df).drop(*shown)
        for n in shown:
            text = text_of(df, n)
            for name, category in self._names(n, fitted["categories"].get(n, [])):
                encoded[name] = F.coalesce((text == F.lit(category)).cast("int"), F.lit(0))
        return df.withColumns(encoded).drop(*shown) if shown else df

    def summary(self, columns, params, counts):
        return "One-hot encoded categorical columns."


class OrdinalEncoding(Operation):
    """Integer codes in a given order or in text order; other values get ``unknown_value``."""

    name = "ordinal_encoding"
    defaults = {"categories_order": {}, "unknown_value": -1}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        must_be(params, "categories_order", dict, "an object")
        return params

    def categories(self, columns, params):
        return [n for n in columns if not isinstance(params["categories_order"].get(n), list)]

    def fit(self, df, columns, params, learned):
        mappings = {}
        for n in columns:
            given = params["categories_order"].get(n)
            if isinstance(given, list):
                mappings[n] = CategoryMap(inline={str(v): i for i, v in enumerate(given)})
            else:
                size = learned.sizes.get(n, 0)
                mappings[n] = CategoryMap.learn(sorted_codes(learned.values_of(n)), size, "ordinal")
        return {"mappings": mappings, "unknown_value": int(params["unknown_value"])}

    def transform(self, df, columns, fitted):
        return _encode(df, fitted["mappings"], "bigint", fitted["unknown_value"])

    def summary(self, columns, params, counts):
        return "Ordinal encoded categorical columns."


class FrequencyEncoding(Operation):
    """Share (or count) of each value among non-missing train rows."""

    name = "frequency_encoding"
    defaults = {"normalize": True, "unknown_value": 0}

    def categories(self, columns, params):
        return list(columns)

    def fit(self, df, columns, params, learned):
        maps = {}
        for n in columns:
            total = F.lit(float(max(learned.totals.get(n, 0), 1))) if params["normalize"] else F.lit(1.0)
            rows = learned.values_of(n).withColumn("code", F.col("n").cast("double") / total)
            maps[n] = CategoryMap.learn(rows, learned.sizes.get(n, 0), "frequency")
        return {"frequency_maps": maps, "unknown_value": float(params["unknown_value"])}

    def transform(self, df, columns, fitted):
        return _encode(df, fitted["frequency_maps"], "double", fitted["unknown_value"])

    def summary(self, columns, params, counts):
        return "Frequency encoded categorical columns."


def _encode(df, maps, code_type, unknown):
    helped, codes = lookup(df, {n: (text_of(df, n), m) for n, m in maps.items() if n in df.columns}, code_type)
    encoded = {n: F.coalesce(code, F.lit(unknown).cast(code_type)) for n, code in codes.items()}
    return drop_helpers(helped.withColumns(encoded), df) if encoded else df
