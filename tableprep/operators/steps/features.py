"""Date and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions.columns import PrepError, families, order_keys
from tableprep.functions.text import DATE_SHAPES, date_forms, spark_date_format, strip, text_of, to_time, word_count
from tableprep.operators.steps.base import Operation, col, must_be, new_names, present

DATE_FEATURES = ["year", "month", "day", "day_of_week", "is_weekend"]


class DatetimeExtract(Operation):
    """Calendar parts of a date; text is parsed by a given format, the one of the first train value or the one of its values' pattern."""

    name = "datetime_extract"
    defaults = {"date_format": None, "features": DATE_FEATURES, "drop_original": True}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        must_be(params, "features", list, "a list")
        unknown = [f for f in params["features"] if f not in DATE_FEATURES]
        if unknown:
            raise PrepError(f"Unknown datetime features: {', '.join(unknown)}")
        if params["date_format"]:
            spark_date_format(params["date_format"])
        new_names(df, self.created(columns, params))
        return params

    def created(self, columns, params):
        return [f"{n}_{f}" for n in columns for f in DATE_FEATURES if f in params["features"]]

    def fit(self, df, columns, params, learned):
        shapes = {}
        if not params["date_format"]:
            kinds = families(df)
            texts = [n for n in columns if kinds[n] == "text"]
            if texts:
                place = F.struct(*order_keys(df))
                row = df.agg(*[F.min_by(col(n), F.when(col(n).isNotNull(), place)).alias(f"f{i}") for i, n in enumerate(texts)]).first()
                shapes = date_forms(df, {n: [v] if v is not None else [] for n, v in zip(texts, row)})
        fixed = {n: DATE_SHAPES[i][1] for n, i in shapes.items() if isinstance(i, int)}
        return {**params, "date_shapes": fixed, "date_formats": {n: f for n, f in shapes.items() if isinstance(f, str)}}

    def transform(self, df, columns, fitted):
        formats, times, exprs, shown = [f for _, f in DATE_SHAPES], {}, {}, present(df, columns)
        for k, n in enumerate(shown):
            shape, derived = fitted.get("date_shapes", {}).get(n), fitted.get("date_formats", {}).get(n)
            # A column of its own, so that a text is parsed once for all its parts.
            times[f"__tp_time_{k}"] = to_time(col(n), df.schema[n].dataType, formats.index(shape) if shape else derived, fitted["date_format"] or None)
            time = F.col(f"__tp_time_{k}")
            day = F.weekday(time)
            parts = {
                "year": F.year(time), "month": F.month(time), "day": F.day(time), "day_of_week": day,
                "is_weekend": F.coalesce((day >= 5).cast("int"), F.lit(0)),
            }
            exprs |= {f"{n}_{f}": parts[f] for f in DATE_FEATURES if f in fitted["features"]}
        out = df.withColumns(times).withColumns(exprs).drop(*times) if shown else df
        return out.drop(*shown) if fitted["drop_original"] else out

    def summary(self, columns, params, counts):
        return "Extracted datetime features."


class TextBasicFeatures(Operation):
    """Cleaned text (missing becomes empty) with character and word counts."""

    name = "text_basic_features"
    defaults = {
        "lowercase": False, "strip_whitespace": True, "create_length_feature": True,
        "create_word_count_feature": True, "drop_original": False,
    }

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        new_names(df, self.created(columns, params))
        return params

    def created(self, columns, params):
        out = []
        for n in columns:
            out += [f"{n}_length"] if params["create_length_feature"] else []
            out += [f"{n}_word_count"] if params["create_word_count_feature"] else []
        return out

    def transform(self, df, columns, fitted):
        shown, exprs = present(df, columns), {}
        for n in shown:
            text = F.coalesce(text_of(df, n), F.lit(""))
            text = strip(text) if fitted["strip_whitespace"] else text
            text = F.lower(text) if fitted["lowercase"] else text
            if fitted["create_length_feature"]:
                exprs[f"{n}_length"] = F.char_length(text)
            if fitted["create_word_count_feature"]:
                exprs[f"{n}_word_count"] = word_count(text)
            if not fitted["drop_original"]:
                exprs[n] = text
        out = df.withColumns(exprs)
        return out.drop(*shown) if fitted["drop_original"] else out

    def summary(self, columns, params, counts):
        return "Created basic text features."
