import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tableprep.plans.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def expected(values, p):
    ordered = sorted(values)
    at = p * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def check(spark, values, **limits):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    found = exact_quantiles(df, {"x": (F.col("x"), PROBS)}, **limits)["x"]
    assert found == pytest.approx([expected(values, p) for p in PROBS])


def test_bracketing_agrees_with_sorting(spark):
    rng = random.Random(7)
    spread = [rng.lognormvariate(0, 3) for _ in range(3000)]
    # A third of all rows share one value, and the range has far outliers.
    tied = [rng.gauss(0, 1) for _ in range(2000)] + [0.25] * 1000 + [1e12, -1e12]
    for values in (spread, tied, [5.0] * 50, [1.0, 2.0]):
        check(spark, values)
        check(spark, values, direct_rows=1, bracket_values=20, accuracy=50)
        check(spark, values, direct_rows=1, uniques={"x": len(set(values))})


def test_inexact_sketch_is_widened(spark):
    check(spark, [((i * 7919) % 1009) ** 2 for i in range(1009)], direct_rows=1, bracket_values=5, accuracy=3)


def test_empty_columns_and_many_requests(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "e double, x double")
    found = exact_quantiles(df, {"e": (F.col("e"), [0.5]), "x": (F.col("x"), [0.5, 0.25])})
    assert found == {"e": [None], "x": [2.0, 1.5]}
    assert statistics.median([1.0, 3.0]) == 2.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_any_small_list(spark, values):
    check(spark, values, direct_rows=1, bracket_values=3, accuracy=10)
