import math
import statistics

import pytest
from pyspark.sql import functions as F

from tableprep import PrepConfig, PrepError, analyze, profile_table, suggest_setup, table_summary, with_row_order
from tableprep.operators import profile as P
from tableprep.operators.suggest import apply_missing_tokens


def by_name(profiles):
    return {r["column_name"]: r for r in profiles.collect()}


def test_types_missing_and_samples(dirty):
    p = by_name(profile_table(dirty, target="target", problem_type="classification"))
    assert {n: r["inferred_type"] for n, r in p.items()} == {
        "age": "numeric", "income": "numeric", "city": "categorical", "notes": "categorical", "target": "boolean",
    }
    assert (p["age"]["missing_count"], p["age"]["missing_rate"], p["age"]["unique_count"]) == (1, 0.2, 3)
    assert p["age"]["sample_values"] == ["25.0", "41.0", "37.0", "25.0"]
    assert p["age"]["warnings"] == ["contains_missing_values"]
    assert p["target"]["majority_class"] == "yes" and p["target"]["majority_class_rate"] == 0.6
    assert p["target"]["minority_class"] == "no" and p["target"]["is_target"]


def test_override_and_numeric_class_target(spark):
    df = spark.createDataFrame([(5, 10001), (6, 10002), (7, 10003), (5, 10004)], "quality int, zip_code int")
    p = by_name(profile_table(df, target="quality", problem_type="classification", overrides={"zip_code": "categorical"}))
    assert p["zip_code"]["inferred_type"] == "categorical" and p["zip_code"]["warnings"] == ["user_type_override"]
    assert p["zip_code"]["count"] == 4 and len(p["zip_code"]["top_values"]) == 4
    counts = {r["class"]: r["class_count"] for r in P.class_balance(df, "quality").collect()}
    assert counts == {"5": 2, "6": 1, "7": 1}


def test_numeric_summary_against_plain_python(spark):
    values = [float(v) for v in (1, 2, 2, 3, 9, 14, 14, 20, 35, 400, -7, 0)]
    p = by_name(profile_table(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int").select("x")))["x"]
    n, mean = len(values), statistics.mean(values)
    m2, m3 = sum((v - mean) ** 2 for v in values) / n, sum((v - mean) ** 3 for v in values) / n
    assert p["inferred_type"] == "numeric" and p["count"] == n
    assert p["std"] == pytest.approx(statistics.stdev(values))
    assert p["skewness"] == pytest.approx(m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2))
    assert (p["zero_count"], p["negative_count"], p["outlier_count_iqr"]) == (1, 1, 1)
    q = statistics.quantiles(values, n=4, method="inclusive")
    assert [p["q1"], p["median"], p["q3"]] == pytest.approx(q)


@pytest.mark.parametrize(
    "values, expected",
    [
        (["yes", " No ", "YES", None], "boolean"),
        (["1.5", " 2 ", "-3e4", "7", "8", "9", "10", "11", "12", "x"], "numeric"),
        (["1d", "2d", "3d"], "categorical"),
        (["2024-01-05", "2024-02-06", "2024-03-07", "soon"], "categorical"),
        (["2024-01-05", "2024-02-06"] * 4 + ["soon"], "datetime"),
        (["1/2/2020", "2/3/2020"], "datetime"),
        (["word " * 10, "other " * 10], "text"),
        (["red", "blue", "red"], "categorical"),
    ],
)
def test_inferred_text_types(spark, values, expected):
    df = with_row_order(spark.createDataFrame(list(enumerate(values)), "i int, c string"), "i").drop("i")
    assert by_name(profile_table(df))["c"]["inferred_type"] == expected


def test_any_date_shape_without_a_first_format(spark):
    from tableprep.functions.text import DATE_SHAPES, guess_date_shapes, to_time
    from pyspark.sql import types as T

    texts = ["2024-3-5", "2024-03-05 06:07", "2024-03-05T06:07:08", "2024-03-05 06:07:08.25", "2024/03/05", "3/5/2024",
             "3/5/2024 06:07", "13/5/2024", "3-5-2024", "25-12-2024", "5.3.2024", "Mar 5, 2024", "March 5, 2024",
             "5 Mar 2024", "5-Mar-2024", "5 March 2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    free = {r[0]: r[1] for r in df.select("t", to_time(F.col("t"), T.StringType())).collect()}
    for text in texts:
        shape = guess_date_shapes(spark, {"x": text})["x"]
        assert shape is not None, text
        fixed = df.filter(F.col("t") == text).select(to_time(F.col("t"), T.StringType(), shape)).first()[0]
        assert free[text] == fixed and fixed is not None, (text, DATE_SHAPES[shape])


def test_mixed_date_formats_follow_the_first_value(spark):
    df = spark.createDataFrame([(1, "2024-01-05"), (2, "01/06/2024")], "i int, c string")
    rate = P.parse_rates(with_row_order(df, "i").drop("i")).first()
    assert rate["datetime_parse_rate"] == 0.5


def test_empty_and_all_missing_tables(spark):
    empty = by_name(profile_table(spark.createDataFrame([], "a string, b double")))
    assert empty["a"]["inferred_type"] == "unknown" and empty["b"]["count"] in (0, None)
    nulls = by_name(profile_table(spark.createDataFrame([(None, None)], "a string, b double")))
    assert nulls["a"]["missing_rate"] == 1.0 and nulls["b"]["unique_count"] == 0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert by_name(profile_table(df))["x"]["missing_count"] == 2
    assert table_summary(df).first()["missing_cells"] == 2


def test_repartitioning_does_not_change_a_profile(dirty):
    expected = profile_table(dirty).collect()
    for parts in (1, 7):
        assert profile_table(dirty.repartition(parts)).collect() == expected


def test_missing_tokens_and_setup(dirty):
    cleaned = apply_missing_tokens(dirty, ["?", "unknown", "  "])
    assert by_name(profile_table(cleaned))["notes"]["missing_count"] == 2
    row = suggest_setup(dirty).first()
    assert row["recommended_target_column"] == "target" and row["recommended_problem_type"] == "classification"
    assert row["missing_value_tokens"] == ["?", "unknown"]


def test_analysis_checks_settings_before_any_job(dirty):
    with pytest.raises(PrepError, match="does not exist"):
        analyze(dirty, PrepConfig(target_column="nope"))
    with pytest.raises(PrepError, match="ignored"):
        analyze(dirty, PrepConfig(target_column="age", ignored_columns=["age"]))
    config = PrepConfig(target_column="age", column_type_overrides={"a": "text"}).override(
        problem_type="regression", column_type_overrides={"b": "text"})
    assert config.target_column == "age" and config.column_type_overrides == {"a": "text", "b": "text"}


def test_other_types_are_only_counted(spark):
    df = spark.createDataFrame([([1, 2],), (None,)], "v array<int>")
    row = by_name(profile_table(df))["v"]
    assert row["inferred_type"] == "unknown" and row["missing_count"] == 1


def test_hot_value_is_preaggregated(spark):
    """A value holding most rows reaches the shuffle as one row per task."""
    from tableprep.plans.freq import value_frequencies

    df = spark.range(0, 5000, numPartitions=4).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    freq = value_frequencies(df, ["c"])
    plan = freq._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.index("Exchange") < plan.index("partial_count")
    assert freq.filter("value = 'hot'").first()["n"] == 4500


def test_sparse_columns_are_sampled_in_row_order(spark):
    from tableprep import with_row_order
    from tableprep.operators.profile import sample_values

    columns = {f"c{i}": F.when(F.col("id") % 1000 == 300 + i, F.concat(F.lit(f"v{i}-"), F.col("id"))) for i in range(30)}
    df = with_row_order(spark.range(9000).withColumns(columns).repartition(5), "id")
    got = sample_values(df, [*columns, "id"])
    assert all(got[f"c{i}"] == [f"v{i}-{300 + i + 1000 * k}" for k in range(5)] for i in range(30)) and got["id"] == list("01234")


def test_each_different_short_text_is_parsed_once(spark, monkeypatch):
    texts = [f"{d}th of nothing" if d % 9 == 0 else f"2024.0{1 + d % 2}.1{d % 10}" for d in range(300)]
    df = spark.createDataFrame([(t, "x" * 50 if i else "short", None) for i, t in enumerate(texts)], "day string, late string, empty string")
    df = with_row_order(df.withColumn("n", F.monotonically_increasing_id()), "n").drop("n")
    parsed, plain = [], P._text_rates
    monkeypatch.setattr(P, "_text_rates", lambda c, time, count: parsed.append(str(c)) or plain(c, time, count))
    rows = {r["column_name"]: r for r in P.profile_records(df)}
    assert "day" not in "".join(parsed) and any("value" in c for c in parsed)
    assert rows["day"]["inferred_type"] == "datetime" and rows["day"]["invalid_date_count"] == 34
    assert (rows["day"]["min_date"], rows["day"]["max_date"]) == ("2024-01-10T00:00:00", "2024-02-19T00:00:00")
    assert rows["late"]["inferred_type"] == "text" and rows["late"]["max_length"] == 50 and rows["late"]["placeholder_count"] == 0
    assert rows["empty"]["inferred_type"] == "categorical" and rows["empty"]["missing_count"] == 300


def test_placeholders_are_counted_from_value_counts(spark):
    df = spark.createDataFrame([("?",), ("unknown",), (" ? ",), ("x",), (None,)] * 30, "a string")
    assert set(P._first_pass(df, ["a"], [], {})["a"]) == {"rows", "present", "total_length"}
    (row,) = P.profile_records(df)
    assert (row["placeholder_count"], row["unique_count"], row["missing_count"]) == (90, 4, 30)


def test_placeholder_counts_alone_need_no_other_statistic(spark, monkeypatch):
    from workload import QUERIES
    from workload.tables import dirty_orders

    df = spark.createDataFrame(
        [("?", " NA\t", 1, "x" * 50), ("unknown", "--", 2, "?"), (" ? ", "n/a", 3, None), (None, None, None, "-" * 45)] * 30,
        "a string, `b.c` string, n int, late string",
    ).withColumn("empty", F.lit(None).cast("string"))
    whole = {r["column_name"]: r for r in P.profile_records(df)}
    folder = "/root/testdata/sf0.001"
    orders = P.profile_table(dirty_orders(spark, folder)).filter("placeholder_count > 0").collect()
    for step in ("value_frequencies", "exact_quantiles", "sample_values"):
        monkeypatch.setattr(P, step, lambda *a, **k: pytest.fail("more than placeholder counts"))
    alone = P.placeholder_profile(df).collect()
    assert [r["placeholder_count"] for r in alone] == [90, 60, 0, 30, 0]
    assert all(r["placeholder_count"] == whole[r["column_name"]]["placeholder_count"] for r in alone)
    assert [(r["dataset_role"], r["ordinal"]) for r in alone] == [("single", i) for i in range(5)]
    (issue,) = QUERIES["issues_placeholder"](spark, folder).collect()
    assert issue["explanation"].startswith(f"{orders[0]['placeholder_count']} placeholder") and len(orders) == 1
