"""Comparing two versions of a table, and counts taken while writing."""

import collections
import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tableprep import Pipeline, PrepError, Step, changed_cells, changed_columns, column_fingerprints, table_summary, write_table

SCHEMA = "k string, x double, t string, f boolean"


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, "", "a", "b", str(i)]), rng.choice([None, float("nan"), 0.0, -0.0, 1.5, float(i)]), rng.choice([None, "", "é" * 500, "z"]), rng.choice([None, True])) for i in range(n)]


def brute(before, after):
    clean = lambda v: None if v != v else "True" if v is True else v if v is None or isinstance(v, str) else v + 0.0
    count = collections.Counter()
    for side, table in ((0, before), (1, after)):
        for r in table:
            count.update((side, r[0], c, clean(r[i])) for i, c in ((1, "x"), (2, "t"), (3, "f")))
    cells = {c[1:] for c in count}
    return sorted(((k, c, count[0, k, c, v], count[1, k, c, v]) for k, c, v in cells if count[0, k, c, v] != count[1, k, c, v]), key=str)


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_changed_cells_equal_brute_force(spark, buckets):
    """Repeated and missing keys, missing values, NaN, both zeros, rows of one side only."""
    before = rows(1, 300)
    after = [(k, x, t + "!" if t == "z" and i % 50 == 0 else t, f) for i, (k, x, t, f) in enumerate(before)][5:] + rows(2, 4)
    frames = [spark.createDataFrame(r, SCHEMA).repartition(n) for r, n in ((before, 3), (after, 2))]
    got = changed_cells(*frames, ["k"], buckets=buckets).collect()
    assert sorted(((r["k"], r["column_name"], r["n_before"], r["n_after"]) for r in got), key=str) == brute(before, after)
    assert changed_cells(frames[0], frames[0].repartition(5), ["k"], buckets=buckets).count() == 0


def test_fingerprints_see_every_row_and_no_order(spark):
    data = [(str(i), float(i), "same", None) for i in range(500)]
    before = spark.createDataFrame(data, SCHEMA)
    after = spark.createDataFrame(data[:-1] + [("499", 499.0, "other", None)], SCHEMA).orderBy(F.rand(1))
    status = {r["column_name"]: r["status"] for r in changed_columns(before, after, ["k"]).collect()}
    assert status == {"k": "unchanged", "x": "unchanged", "t": "changed", "f": "unchanged"}
    swapped = spark.createDataFrame([("498" if k == "499" else "499" if k == "498" else k, x, t, f) for k, x, t, f in data], SCHEMA)
    status = {r["column_name"]: r["status"] for r in changed_columns(before, swapped, ["k"]).collect()}
    assert (status["x"], status["t"]) == ("changed", "unchanged")
    plan = column_fingerprints(before, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" in plan


def test_types_columns_and_empty_tables(spark):
    before = spark.createDataFrame([(1, 5, "x", 1), (2, None, "y", 1)], "k int, n int, t string, gone int")
    after = before.select("k", F.col("n").cast("double").alias("n"), "t", F.lit(1).alias("new"))
    status = {r["column_name"]: r["status"] for r in changed_columns(before, after, ["k"]).collect()}
    assert status == {"k": "unchanged", "n": "unchanged", "t": "unchanged", "gone": "removed", "new": "added"}
    assert changed_cells(before, after, ["k"]).count() == 0
    nothing = before.limit(0)
    assert {r["status"] for r in changed_columns(nothing, nothing, ["k"]).collect()} == {"unchanged"}
    assert {r["status"] for r in changed_columns(before, nothing, ["k"]).collect()} == {"changed"}
    assert changed_cells(nothing, nothing, ["k"]).count() == 0 and changed_cells(before, nothing, ["k"]).count() == 6
    # Names that the comparison uses itself.
    odd = before.select(F.col("k").alias("bucket"), F.col("t").alias("value"), F.col("n").alias("column_name"))
    assert changed_cells(odd, odd.withColumn("value", F.lit("q")), ["bucket"]).count() == 4
    with pytest.raises(PrepError):
        changed_columns(before, after, ["absent"])


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_written_counts_equal_the_summary(spark, tmp_path, fmt):
    df = spark.createDataFrame(rows(3, 100), SCHEMA).repartition(3)
    for name, table in (("full", df), ("empty", df.limit(0)), ("none", df.filter("false"))):
        assert write_table(table, str(tmp_path / name), fmt) == table_summary(table).first().asDict()


def test_effects_take_one_job_a_stretch(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (2, 5.0)], "id int, x double")
    once = lambda i: Step("remove_duplicate_rows", [], {"subset": ["id", "x"]} if i == 0 else {"subset": ["id"]}, order_index=i)
    fitted = Pipeline([once(0), Step("numeric_imputation", ["x"], order_index=1), once(2), once(3)]).fit(df)
    collected, first = [], DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda self: collected.append(1) or first(self))
    effects = fitted.effects(df)
    monkeypatch.undo()
    # Four stretches: before, between and after the three steps that remove rows.
    assert len(collected) == 4
    got = [(r["rows_before"], r["rows_after"]) for r in effects.orderBy("step_order").collect()]
    assert got == [(4, 3), (3, 3), (3, 2), (2, 2)]
