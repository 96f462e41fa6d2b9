"""Mergeable profiles: exact parts, bounds, merging, growing tables."""

import pytest
from pyspark.sql import functions as F

from tableprep import PrepError, profile_table
from tableprep.operators import sketches

EXACT = [
    "ordinal", "column_name", "storage", "inferred_type", "row_count", "missing_count", "warnings", "is_target", "placeholder_count", "has_leading_zero", "count",
    "min", "max", "zero_count", "negative_count", "min_length", "max_length", "average_length", "average_word_count", "empty_string_count", "min_date", "max_date",
    "majority_class", "majority_class_rate", "minority_class", "minority_class_rate", "dominant_value", "top_values",
]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 1500).alias("key"), F.when(F.col("id") % 7 > 0, F.sin("id") * 1e6 + 1e9).alias("number"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id") % 3)).alias("kind"),
        F.concat_ws(" ", F.lit("some longer free text that has a number in it"), F.sha2(F.col("id").cast("string"), 256)).alias("note"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")), "yyyy-MM-dd").alias("day"),
        F.lit(None).cast("double").alias("nothing"), (F.col("id") % 2 == 0).alias("flag"), F.lpad((F.col("id") % 40).cast("string"), 4, "0").alias("code"),
    )
    return rows.withColumn("number", F.when(F.col("key") == 3, float("nan")).otherwise(F.col("number")))


def records(df):
    return {r["column_name"]: r.asDict(recursive=True) for r in df.collect()}


def assert_near(got, want, n):
    for name, w in want.items():
        g = got[name]
        assert {k: g[k] for k in EXACT} == {k: w[k] for k in EXACT}, name
        assert abs(g["unique_count"] - w["unique_count"]) <= sketches.UNIQUE_ERROR * w["unique_count"]
        for k in ("mean", "std", "skewness"):
            assert g[k] == (None if w[k] is None else pytest.approx(w[k], rel=1e-6, abs=1e-9))


def test_one_pass_profile_keeps_its_bounds(mixed):
    want = records(profile_table(mixed, target="kind", problem_type="classification"))
    got = records(profile_table(mixed, target="kind", problem_type="classification", exact=False))
    assert_near(got, want, 3000)
    values = sorted(r["number"] for r in mixed.filter("not isnan(number)").collect() if r["number"] is not None)
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        rank = sum(v <= got["number"][name] for v in values) / len(values)
        assert abs(rank - share) <= sketches.RANK_ERROR + 1 / len(values)


def test_parts_add_up_to_the_whole(spark, mixed):
    parts = [sketches.column_states(mixed.filter(F.col("key") % 4 == i)) for i in range(4)]
    empty = sketches.column_states(mixed.limit(0))
    together = parts[0]
    for p in [*parts[1:], empty]:
        together = together.unionByName(p)
    assert_near(records(sketches.profile_of_states(sketches.merge_states(together))), records(profile_table(mixed)), 3000)
    twice = sketches.merge_states(sketches.merge_states(parts[0].unionByName(parts[1])).unionByName(sketches.merge_states(parts[2].unionByName(parts[3]))))
    assert_near(records(sketches.profile_of_states(twice)), records(profile_table(mixed)), 3000)


def test_empty_table_and_no_columns(spark, mixed):
    got = records(profile_table(mixed.limit(0), exact=False))
    assert {r["row_count"] for r in got.values()} == {0} and {r["unique_count"] for r in got.values()} == {0}
    with pytest.raises(PrepError):
        sketches.column_states(spark.range(1).select())


def test_a_growing_table_reads_new_files_only(spark, mixed, tmp_path):
    rows, store, read = str(tmp_path / "rows"), str(tmp_path / "states"), []

    def new(paths):
        read.append(sorted(paths))
        return spark.read.parquet(*paths)

    for run, part in enumerate((mixed.filter("key < 1000"), mixed.filter("key >= 1000"))):
        part.coalesce(2).write.mode("append").parquet(rows)
        merged = sketches.append_states(spark, spark.read.parquet(rows), store, f"r{run}", new)
    assert len(read) == 2 and not set(read[0]) & set(read[1]) and len(read[0] + read[1]) == len(spark.read.parquet(rows).inputFiles())
    assert_near(records(sketches.profile_of_states(merged)), records(profile_table(mixed)), 3000)
    sketches.append_states(spark, spark.read.parquet(rows), store, "r2", new)
    assert len(read) == 2
