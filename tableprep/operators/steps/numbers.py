"""Numeric operations: scaling, clipping and log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions.columns import PrepError
from tableprep.functions.text import number_of
from tableprep.operators.steps.base import Operation, choice, new_names, present


class NumericScaling(Operation):
    """Standard (population deviation), min-max, or robust scaling.

    Robust scaling centres on the low quantile and divides by the quantile range.
    """

    name = "numeric_scaling"
    defaults = {"method": "standard", "feature_range": [0, 1], "quantile_range": [25, 75]}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        choice(params, "method", ["standard", "minmax", "robust"], self.name)
        return params

    def scalars(self, df, columns, params):
        learn = {"standard": {"mean": F.avg, "std": F.stddev_pop}, "minmax": {"min": F.min, "max": F.max}}
        wanted = learn.get(params["method"], {})
        return {f"{key}:{n}": agg(number_of(df, n)) for n in columns for key, agg in wanted.items()}

    def quantiles(self, df, columns, params):
        if params["method"] != "robust":
            return {}
        low, high = (float(q) / 100.0 for q in params["quantile_range"])
        return {n: (number_of(df, n), [low, high]) for n in columns}

    def fit(self, df, columns, params, learned):
        stats, method = {}, params["method"]
        for n in columns:
            get = lambda key: learned.scalars[f"{key}:{n}"]
            if method == "standard":
                stats[n] = {"mean": get("mean"), "std": get("std") or 1.0}
            elif method == "minmax":
                low, high = params["feature_range"]
                stats[n] = {"min": get("min"), "max": get("max"), "low": float(low), "high": float(high)}
            else:
                stats[n] = dict(zip(("q_low", "q_high"), learned.quantiles[n]))
        return {"method": method, "stats": stats}

    def _scaled(self, x, method, s):
        if any(v is None for v in s.values()):
            return F.lit(None).cast("double")
        if method == "standard":
            return (x - s["mean"]) / s["std"]
        if method == "minmax":
            return (x - s["min"]) / ((s["max"] - s["min"]) or 1.0) * (s["high"] - s["low"]) + s["low"]
        return (x - s["q_low"]) / ((s["q_high"] - s["q_low"]) or 1.0)

    def transform(self, df, columns, fitted):
        stats = {n: s for n, s in fitted["stats"].items() if n in df.columns}
        return df.withColumns({n: self._scaled(number_of(df, n), fitted["method"], s) for n, s in stats.items()})

    def summary(self, columns, params, counts):
        return f"Scaled numeric columns using {params['method']}."


class OutlierClipping(Operation):
    """Clip numbers to learned percentiles or to the IQR fence."""

    name = "outlier_clipping"
    defaults = {"method": "percentile", "lower_percentile": 1.0, "upper_percentile": 99.0, "iqr_multiplier": 1.5}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        choice(params, "method", ["percentile", "iqr"], self.name)
        return params

    def quantiles(self, df, columns, params):
        ends = [float(params["lower_percentile"]) / 100.0, float(params["upper_percentile"]) / 100.0]
        probs = ends if params["method"] == "percentile" else [0.25, 0.75]
        return {n: (number_of(df, n), probs) for n in columns}

    def fit(self, df, columns, params, learned):
        thresholds = {}
        for n in columns:
            low, high = learned.quantiles[n]
            if params["method"] == "iqr" and low is not None:
                reach = float(params["iqr_multiplier"]) * (high - low)
                low, high = low - reach, high + reach
            thresholds[n] = {"lower": low, "upper": high}
        return {"method": params["method"], "thresholds": thresholds}

    def transform(self, df, columns, fitted):
        exprs = {}
        for n, t in fitted["thresholds"].items():
            if n in df.columns:
                x = number_of(df, n)
                low, high = F.lit(t["lower"]).cast("double"), F.lit(t["upper"]).cast("double")
                exprs[n] = F.when(x.isNotNull(), F.greatest(F.least(x, high), low))
        return df.withColumns(exprs)

    def counters(self, df, columns, fitted):
        clipped = F.lit(0)
        for n in present(df, columns):
            x, t = number_of(df, n), fitted["thresholds"][n]
            if t["lower"] is not None:
                clipped = clipped + F.coalesce((x < t["lower"]) | (x > t["upper"]), F.lit(False)).cast("long")
        return {"values_clipped": clipped}

    def summary(self, columns, params, counts):
        return f"Clipped {counts['values_clipped']} values."


class LogTransform(Operation):
    """log1p of a number plus an offset; negative values after the offset are an error."""

    name = "log_transform"
    defaults = {"method": "log1p", "offset": 0, "replace_original": True, "new_suffix": "_log"}

    def check(self, df, columns, params):
        params = super().check(df, columns, params)
        choice(params, "method", ["log1p"], self.name)
        params["offset"] = float(params["offset"])
        if not params["replace_original"]:
            new_names(df, self.created(columns, params))
        return params

    def created(self, columns, params):
        return [] if params["replace_original"] else [f"{n}{params['new_suffix']}" for n in columns]

    def scalars(self, df, columns, params):
        return {f"least:{n}": F.min(number_of(df, n) + params["offset"]) for n in columns}

    def _message(self, column):
        return f"Column {column} contains negative values after offset"

    def fit(self, df, columns, params, learned):
        for n in columns:
            least = learned.scalars[f"least:{n}"]
            if least is not None and least < 0:
                raise PrepError(self._message(n))
        return {key: params[key] for key in ("offset", "replace_original", "new_suffix")}

    def transform(self, df, columns, fitted):
        exprs = {}
        for n in present(df, columns):
            x = number_of(df, n) + fitted["offset"]
            name = n if fitted["replace_original"] else f"{n}{fitted['new_suffix']}"
            exprs[name] = F.when(x < 0, F.raise_error(F.lit(self._message(n))).cast("double")).otherwise(F.log1p(x))
        return df.withColumns(exprs)

    def summary(self, columns, params, counts):
        return "Applied log1p transform."
