"""Derived date formats: patterns, ambiguity settled by ranges, one job for all columns, nothing for other texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tableprep import Pipeline, Step, profile_table, with_row_order
from tableprep.functions import dates

DAYS = [datetime.datetime(1968, 12, 31) + datetime.timedelta(days=97 * i, hours=i % 24, minutes=7 * i % 60) for i in range(150)]


def column(spark, render):
    return spark.createDataFrame([(i, render(t)) for i, t in enumerate(DAYS)], "i int, text string")


@pytest.mark.parametrize("render, cut", [
    ("%A, %d. %B %Y", "%Y-%m-%d"), ("%a %d %b %Y %H:%M:%S +0200", "%Y-%m-%d %H:%M:%S"), ("%d/%m/%y %H:%M", "%Y-%m-%d %H:%M"), ("%y/%m/%d", "%Y-%m-%d"),
    ("%Y%m%dT%H%M%S", "%Y-%m-%d %H:%M:%S"), ("%Y.%j", "%Y-%m-%d"), ("%B %Y", "%Y-%m"), ("%I:%M %p %d-%b-%Y", "%Y-%m-%d %H:%M"), ("%m.%d.%Y", "%Y-%m-%d"),
    ("%Y-%d-%m %H:%M", "%Y-%m-%d %H:%M"), ("%Y/%m/%d %H:%M:%S,123456789", "%Y-%m-%d %H:%M:%S"), ("Sept. %d, %Y", None), ("%d%%", None), ("10.0.%d.%m", None),
])
def test_formats_of_many_renderings(spark, render, cut):
    df = column(spark, lambda t: t.strftime(render))
    found = dates.infer_date_formats(df, ["text"])
    if cut is None:
        assert ("text" in found) == render.startswith("Sept")
        return
    got = {r["i"]: r["t"] for r in df.select("i", dates.parsed(F.col("text"), found["text"]).alias("t")).collect()}
    # Two-digit years reach from 1969 to 2068.
    want = {i: t.replace(year=t.year + 100) if "%y" in render and t.year < 1969 else t for i, t in enumerate(DAYS)}
    assert {i: t.strftime(cut) for i, t in got.items()} == {i: t.strftime(cut) for i, t in want.items()}


def test_majority_odd_values_and_other_texts(spark):
    rows = [(i, t.strftime("%d.%b.%Y"), f"item {i}", None, "x" * 500) for i, t in enumerate(DAYS)]
    rows += [(200, "soon", "", "5th", None), (201, "31.Feb.2001", None, None, ""), (202, None, None, None, None), (203, "2001/01/01", "a", None, "b")]
    df = spark.createDataFrame(rows, "i int, day string, name string, rare string, long string")
    assert dates.infer_date_formats(df, ["day", "name", "rare", "long"]) == {"day": "d.MMM.yyyy"} and dates.infer_date_formats(df, []) == {}
    assert dates.infer_date_formats(df.limit(0), ["day"]) == {}
    got = {r["column_name"]: r for r in profile_table(with_row_order(df, "i").drop("i")).collect()}
    assert got["day"]["inferred_type"] == "datetime" and got["day"]["invalid_date_count"] == 3 and got["name"]["inferred_type"] != "datetime"


def test_a_format_is_kept_in_the_fitted_step(spark, tmp_path):
    from tableprep import FittedPipeline

    train = with_row_order(column(spark, lambda t: t.strftime("%A %d-%m-%y")), "i")
    fitted, out = Pipeline([Step("datetime_extract", ["text"], {"features": ["day", "month"]})]).fit_transform(train)
    fitted.save(spark, str(tmp_path / "config"))
    # Alone, the text would be read month first.
    late = spark.createDataFrame([(0, "Tuesday 02-01-01")], "i int, text string")
    row = FittedPipeline.load(spark, str(tmp_path / "config")).transform(late).first()
    assert (row["text_day"], row["text_month"]) == (2, 1)
    assert {(r["i"], r["text_day"], r["text_month"]) for r in out.collect()} == {(i, t.day, t.month) for i, t in enumerate(DAYS)}
