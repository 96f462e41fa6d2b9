import json

import pytest
from pyspark.sql import functions as F

from tableprep import (
    FittedPipeline, Pipeline, PrepError, Step, apply_and_export, load_config, preview_single, preview_train_test,
    with_row_order,
)
from tableprep.operators.preview import column_diffs
from tableprep.plans import maps


def run(df, operation, columns=(), **params):
    return Pipeline([Step(operation, list(columns), params)]).fit_transform(df)


def cells(df, column):
    return [r[column] for r in df.orderBy("__tp_row" if "__tp_row" in df.columns else df.columns[0]).select(column).collect()]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 10.0, "a", "x y"), (2, None, "b", None), (3, 30.0, None, " Z "), (4, 1000.0, "a", "")]
    return with_row_order(spark.createDataFrame(rows, "id int, age double, city string, note string"), "id")


def test_five_steps_on_one_table(table):
    steps = [
        Step("numeric_imputation", ["age"], {"strategy": "median"}, order_index=0),
        Step("categorical_imputation", ["city"], order_index=1),
        Step("outlier_clipping", ["age"], {"method": "iqr"}, order_index=2),
        Step("one_hot_encoding", ["city"], order_index=3),
        Step("drop_columns", ["id"], order_index=4),
    ]
    fitted, done = Pipeline(steps).fit_transform(table)
    assert [c for c in done.columns if not c.startswith("__tp_")] == ["age", "note", "city_a", "city_b"]
    assert fitted.steps[0].fitted["fill_values"] == {"age": 30.0}
    assert cells(done, "city_a") == [1, 0, 1, 1]
    assert max(cells(done, "age")) < 1000


def test_train_only_fit(spark):
    train = spark.createDataFrame([("Seattle", 10), ("Austin", 20), ("Seattle", 30)], "city string, income int")
    test = spark.createDataFrame([("Miami", 100), ("Seattle", 200)], "city string, income int")
    steps = [
        Step("rare_category_grouping", ["city"], {"min_count": 2}), Step("one_hot_encoding", ["city"]),
        Step("numeric_scaling", ["income"]),
    ]
    fitted = Pipeline(steps, mode="train_test").fit(train)
    assert fitted.steps[2].fitted["stats"]["income"]["mean"] == 20.0
    done = fitted.transform(test).orderBy("income").collect()
    assert [r["city_Seattle"] for r in done] == [0, 1] and [r["city___RARE__"] for r in done] == [1, 0]
    again = Pipeline(steps, mode="train_test").fit(train)
    assert again.to_config()["steps"] == fitted.to_config()["steps"]


def test_replay_from_json(table, spark):
    fitted = run(table, "numeric_imputation", ["age"], strategy="mean")[0]
    config = json.loads(json.dumps(fitted.to_config()))
    new = spark.createDataFrame([(10.0, "a"), (None, "b")], "age double, city string")
    mean = (10.0 + 30.0 + 1000.0) / 3
    assert [r["age"] for r in FittedPipeline.from_config(config, spark).transform(new).collect()] == [10.0, mean]


@pytest.mark.parametrize("keep, ids", [("first", [1, 2, 4]), ("last", [2, 3, 4]), ("none", [2, 4])])
def test_duplicates_follow_row_order(spark, keep, ids):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", None), (4, "a", "x")], "id int, k string, l string")
    done = run(with_row_order(df, "id"), "remove_duplicate_rows", subset=["k", "l"], keep=keep)[1]
    assert sorted(r["id"] for r in done.collect()) == ids


def test_rare_grouping_missing_and_unseen(spark):
    train = spark.createDataFrame([("a",)] * 8 + [("b",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    for include, missing in ((False, None), (True, "__RARE__")):
        fitted, done = run(train, "rare_category_grouping", ["c"], min_frequency=0.5, include_missing=include)
        assert {r["c"] for r in done.collect()} == {"a", "__RARE__", missing}
        assert [r["c"] for r in fitted.transform(test).collect()] == ["a", "__RARE__", "__RARE__", missing]


def test_text_numbers_are_coerced_on_both_sides(spark):
    train = spark.createDataFrame([("1",), ("x",), ("3",)], "v string")
    fitted, done = run(train, "numeric_imputation", ["v"], strategy="mean")
    assert [r["v"] for r in done.collect()] == [1.0, 2.0, 3.0]
    assert [r["v"] for r in fitted.transform(spark.createDataFrame([("y",)], "v string")).collect()] == [2.0]


def test_mode_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (None,)], "v int")
    assert run(df, "categorical_imputation", ["v"])[0].steps[0].fitted["fill_values"] == {"v": "9"}


@pytest.mark.parametrize("method, expected", [
    ("standard", [-1.2247, 0.0, 1.2247]), ("minmax", [0.0, 0.5, 1.0]), ("robust", [-0.5, 0.5, 1.5]),
])
def test_scaling(spark, method, expected):
    df = spark.createDataFrame([(10,), (20,), (30,)], "v int")
    done = sorted(r["v"] for r in run(df, "numeric_scaling", ["v"], method=method)[1].collect())
    assert done == pytest.approx(expected, abs=1e-4)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    for method in ("standard", "minmax", "robust"):
        assert [r["v"] for r in run(df, "numeric_scaling", ["v"], method=method)[1].collect()] == [0.0, 0.0]


def test_log_refuses_negatives_on_fit_and_transform(spark):
    good, bad = spark.createDataFrame([(0.0,), (None,)], "v double"), spark.createDataFrame([(-1.0,)], "v double")
    fitted = run(good, "log_transform", ["v"])[0]
    with pytest.raises(PrepError, match="negative values"):
        run(bad, "log_transform", ["v"])
    with pytest.raises(Exception, match="negative values"):
        fitted.transform(bad).collect()


def test_datetime_parts_of_text_and_missing(spark):
    df = with_row_order(spark.createDataFrame([(1, "03/02/2024"), (2, "bad"), (3, None)], "i int, d string"), "i")
    done = run(df, "datetime_extract", ["d"])[1]
    assert cells(done, "d_month") == [3, None, None] and cells(done, "d_day_of_week") == [5, None, None]
    assert cells(done, "d_is_weekend") == [1, 0, 0]
    by_format = run(df, "datetime_extract", ["d"], date_format="%d/%m/%Y", features=["month"])[1]
    assert cells(by_format, "d_month") == [2, None, None]


def test_text_features(table):
    done = run(table, "text_basic_features", ["note"], lowercase=True)[1]
    assert cells(done, "note") == ["x y", "", "z", ""]
    assert cells(done, "note_length") == [3, 0, 1, 0] and cells(done, "note_word_count") == [2, 0, 1, 0]


def test_one_hot_name_clash_and_limit(spark):
    df = spark.createDataFrame([("a b",), ("a-b",)], "c string")
    with pytest.raises(PrepError, match="share a name"):
        run(df, "one_hot_encoding", ["c"])
    done = run(df, "one_hot_encoding", ["c"], max_categories=1)[1]
    assert done.columns == ["c_a_b"]


@pytest.mark.parametrize("step, message", [
    (Step("drop_columns", ["nope"]), "do not exist"),
    (Step("numeric_imputation", ["age"], {"strategy": "magic"}), "strategy"),
    (Step("rename_columns", [], {"rename_map": {"age": "city"}}), "already exists"),
    (Step("reorder_columns", [], {"column_order": ["nope"]}), "do not exist"),
    (Step("replace_placeholder_values", ["city"], {"placeholders": "x"}), "list"),
    (Step("datetime_extract", ["city"], {"features": ["hour"]}), "Unknown datetime"),
])
def test_bad_steps_name_the_step(table, step, message):
    with pytest.raises(PrepError, match=f"Step 1 failed: .*{message}"):
        Pipeline([step]).fit(table)
    with pytest.raises(PrepError, match="Unsupported"):
        Pipeline([Step("explode")])


@pytest.mark.parametrize("config, message", [
    ({"mode": "x", "steps": []}, "mode"), ({"steps": []}, "at least one"), ({"steps": [1]}, "must be an object"),
    ({"steps": [{}]}, "missing operation_type"), ({"steps": [{"operation_type": "no"}]}, "unsupported"),
    ({"steps": [{"operation_type": "drop_columns", "columns": "a"}]}, "columns must be"),
    ({"steps": [{"operation_type": "drop_columns", "params": []}]}, "params must be"),
])
def test_config_checks(config, message):
    with pytest.raises(PrepError, match=message):
        Pipeline.from_config(config)


def test_absent_columns_are_skipped_on_other_tables(table, spark):
    steps = [Step("add_missing_indicator", ["age"]), Step("text_basic_features", ["note"]), Step("drop_columns", ["id"])]
    other = spark.createDataFrame([("q",)], "city string")
    assert Pipeline(steps).fit(table).transform(other).columns == ["city"]


@pytest.mark.parametrize("literal, inline", [(64, 1000), (0, 1000), (0, 0)])
def test_category_maps_agree_at_every_size(spark, monkeypatch, literal, inline):
    """Literal, broadcast and hot/cold shuffled lookups give the same codes."""
    monkeypatch.setattr(maps, "LITERAL_VALUES", literal)
    monkeypatch.setattr(maps, "INLINE_VALUES", inline or 3)
    df = spark.range(400).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("c"))
    test = df.withColumn("c", F.when(F.col("id") == 1, "never seen").otherwise(F.col("c")))
    values = sorted({r["c"] for r in df.collect() if r["c"]})
    counts = {v: df.filter(F.col("c") == v).count() for v in values[:3]}
    steps = [Step("ordinal_encoding", ["c"])]
    fitted = Pipeline(steps).fit(df)
    source, done = test.collect(), {r["id"]: r["c"] for r in fitted.transform(test).collect()}
    assert len(done) == 400
    assert all(done[r["id"]] == (values.index(r["c"]) if r["c"] in values else -1) for r in source)
    share = {r["id"]: r["c"] for r in Pipeline([Step("frequency_encoding", ["c"], {"normalize": False})]).fit(df).transform(test).collect()}
    assert all(share[r["id"]] == counts[r["c"]] for r in source if r["c"] in counts)
    grouped = {r["id"]: r["c"] for r in Pipeline([Step("rare_category_grouping", ["c"], {"min_count": 1})]).fit(df).transform(test).collect()}
    assert all(grouped[r["id"]] == ("__RARE__" if r["c"] == "never seen" else r["c"]) for r in source)


def test_large_maps_are_saved_as_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(maps, "INLINE_VALUES", 2)
    monkeypatch.setattr(maps, "LITERAL_VALUES", 0)
    df = spark.createDataFrame([(i, f"v{i % 9}") for i in range(50)], "id int, c string")
    fitted, done = run(df, "frequency_encoding", ["c"])
    whole = FittedPipeline.from_config(json.loads(json.dumps(fitted.to_config())), spark).transform(df)
    assert sorted(whole.collect()) == sorted(done.collect())
    fitted.save(spark, str(tmp_path / "cfg"))
    assert load_config(spark, str(tmp_path / "cfg"))["steps"][0]["fitted"]["frequency_maps"]["c"]["kind"] == "table"
    again = FittedPipeline.load(spark, str(tmp_path / "cfg")).transform(df)
    assert sorted(again.collect()) == sorted(done.collect())


def test_effects_preview_and_diffs(table):
    steps = [
        Step("replace_placeholder_values", ["city"], {"placeholders": ["b"]}, order_index=0),
        Step("numeric_imputation", ["age"], order_index=1),
        Step("remove_duplicate_rows", [], {"subset": ["city"]}, order_index=2),
        Step("drop_columns", ["note"], order_index=3),
    ]
    pv = preview_single(table, steps, limit=2)
    effects = pv.step_effects.orderBy("step_order").collect()
    assert effects[0]["cells_replaced"] == 1 and effects[1]["missing_before"] == {"age": 1}
    assert effects[1]["missing_after"] == {"age": 0} and (effects[2]["rows_before"], effects[2]["rows_after"]) == (4, 2)
    diffs = {r["column_name"]: r for r in pv.column_diffs.collect()}
    assert diffs["note"]["status"] == "removed" and diffs["city"]["status"] == "changed"
    assert pv.before_rows.count() == 2 and pv.affected_columns == ["age", "city", "note"]
    fitted = run(table, "numeric_imputation", ["age"])[0]
    age = column_diffs(table, fitted).filter("column_name = 'age'").first()
    assert (age["status"], age["before_missing_count"], age["after_missing_count"], age["changed_sample_count"]) == ("changed", 1, 0, 1)


def test_preview_train_test_scores_train_only(drifted):
    pv = preview_train_test(*drifted, [Step("numeric_scaling", ["age"])], "target", "classification")
    scores = {(r["moment"], r["dataset_role"]): r["readiness_score"] for r in pv.summaries.collect()}
    assert scores[("after", "train")] is not None and scores[("after", "test")] is None
    assert pv.warnings == ["Train/test mode fits preprocessing parameters on train only."]


def test_export_and_refit(spark, table, tmp_path):
    steps = [Step("numeric_imputation", ["age"], {"strategy": "mean"})]
    _, paths = apply_and_export(table, steps, str(tmp_path / "out"), name="mine", fmt="parquet")
    config = load_config(spark, str(tmp_path / "out"))
    assert config["metadata"]["before_summary"]["missing_cells"] == 3 and config["pipeline_name"] == "mine"
    assert spark.read.parquet(paths["cleaned_single"]).filter("age IS NULL").count() == 0
    draft = Pipeline.from_config(config)
    assert draft.name == "mine" and draft.fit(table).to_config()["steps"] == config["steps"]


def test_fit_is_fused_for_disjoint_columns(table, monkeypatch):
    from tableprep.operators import pipeline as module

    calls = []
    learn = module._learn
    monkeypatch.setattr(module, "_learn", lambda df, pending: calls.append(len(pending)) or learn(df, pending))
    Pipeline([Step("numeric_imputation", ["age"]), Step("categorical_imputation", ["city"]), Step("numeric_scaling", ["id"]),
              Step("numeric_scaling", ["age"])]).fit(table)
    assert [c for c in calls if c] == [3, 1]


def test_cold_keys_are_spread_although_rows_are_equal(spark, monkeypatch):
    """A third of all rows are copies with a hot value: they do not meet in one join partition."""
    monkeypatch.setattr(maps, "INLINE_VALUES", 1)
    monkeypatch.setattr(maps, "LITERAL_VALUES", 0)
    df = with_row_order(spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("c")
    ), "id").drop("id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fitted = Pipeline([Step("frequency_encoding", ["c"], {"normalize": False})]).fit(df)
        out = fitted.transform(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 3000 and out.filter("c = 1000").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequent_values_known_or_unseen_cross_no_network(spark, monkeypatch, tmp_path):
    """90 % of the rows hold one known value, 9 % one unseen value: only the others reach the join, also after a replay."""
    monkeypatch.setattr(maps, "INLINE_VALUES", 2)
    monkeypatch.setattr(maps, "LITERAL_VALUES", 0)
    train = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 50).alias("c"), F.concat(F.lit("w"), F.col("id") % 25).alias("d"))
    fitted = Pipeline([Step("frequency_encoding", ["c", "d"], {"normalize": False}), Step("rare_category_grouping", ["e"], {"min_count": 1})]).fit(
        train.withColumn("e", F.col("c")))
    fitted.save(spark, str(tmp_path / "cfg"))
    c = F.when(F.col("id") % 100 < 90, "v7").when(F.col("id") % 100 < 99, "unseen").otherwise(F.concat(F.lit("v"), F.col("id") % 37))
    test = spark.range(4000).select("id", c.alias("c"), F.when(F.col("id") % 2 == 0, "w3").alias("d"), c.alias("e"))
    for pipeline in (fitted, FittedPipeline.load(spark, str(tmp_path / "cfg"))):
        found = {n: (F.col(n), pipeline.steps[0].fitted["frequency_maps"][n]) for n in ("c", "d")}
        done, rest = maps.settle(test, found, "double")
        # The sketch may list one of the rare values, too.
        assert done.count() + rest.count() == 4000 and 20 < rest.count() <= 40
        assert "hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()
        for r in pipeline.transform(test).collect():
            value = "v7" if r["id"] % 100 < 90 else "unseen" if r["id"] % 100 < 99 else f"v{r['id'] % 37}"
            assert (r["c"], r["d"]) == (0.0 if value == "unseen" else 10.0, 0.0 if r["id"] % 2 else 20.0)
            assert r["e"] == ("__RARE__" if value == "unseen" else value)


def test_replacement_that_does_not_fit_the_type_becomes_missing(spark):
    df = spark.createDataFrame([(1.0,), (-9.0,)], "v double")
    done = run(df, "replace_placeholder_values", ["v"], placeholders=[-9.0], replacement="none")[1]
    assert [r["v"] for r in done.collect()] == [1.0, None]


def test_a_lone_category_of_any_name_replays(spark, tmp_path):
    df = spark.createDataFrame([(1, "__table__"), (2, "__table__"), (3, None)], "id int, c string")
    for name, key in (("frequency_encoding", "frequency_maps"), ("ordinal_encoding", "mappings"), ("rare_category_grouping", "frequent_values")):
        fitted, done = run(df, name, ["c"])
        assert key in fitted.steps[0].fitted
        fitted.save(spark, str(tmp_path / name))
        for again in (FittedPipeline.from_config(fitted.to_config(), spark), FittedPipeline.load(spark, str(tmp_path / name))):
            assert sorted(again.transform(df).collect(), key=str) == sorted(done.collect(), key=str)


def test_errors_name_their_step_once(spark):
    df = spark.createDataFrame([("a b",), ("a_b",)], "c string")
    with pytest.raises(PrepError) as caught:
        run(df, "one_hot_encoding", ["c"])
    assert str(caught.value).count("failed") == 1


def test_one_hot_index_holds_any_number_of_categories(spark):
    df = spark.range(12_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("c"))
    fitted = Pipeline([Step("one_hot_encoding", ["c"], {"output": "index", "drop_first": True})]).fit(df)
    got = {r["id"]: r["c_index"] for r in fitted.transform(df).collect()}
    order = sorted(f"k{i}" for i in range(12_000))
    assert got == {i: (p - 1 if p else None) for i, p in ((int(k[1:]), p) for p, k in enumerate(order))}
