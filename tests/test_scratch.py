"""Intermediate tables: where they are and when they go."""

from types import SimpleNamespace

import pytest

from tableprep import PrepError
from tableprep.plans import scratch


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="app-1")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(PrepError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(session)


def test_tables_go_at_the_end_of_a_scope(spark):
    import os

    with scratch.scratch_scope(spark):
        stored = scratch.materialize(spark.range(10), "ten")
        folder = scratch.scratch_dir(spark)
        assert stored.count() == 10 and any(n.startswith("ten-") for n in os.listdir(folder.removeprefix("file:")))
    assert not os.path.exists(folder.removeprefix("file:"))
    assert scratch.materialize(spark.range(3), "again").count() == 3


def test_one_dropped_path_leaves_the_others(spark):
    paths = [scratch.scratch_path(spark, "p") for _ in range(2)]
    for p in paths:
        spark.range(2).write.parquet(p)
    scratch.drop_path(spark, paths[0])
    assert spark.read.parquet(paths[1]).count() == 2


def test_materialize_alone_drops_what_was_made_on_the_way(spark):
    import os

    from tableprep.plans.scratch import materialize, materialize_alone, scratch_dir

    def make():
        inner = materialize(spark.range(5), "inner-alone")
        nested = materialize_alone(spark, lambda: materialize(inner, "deep-alone").filter("id > 1"), "nested-alone")
        return nested.filter("id > 2")

    assert sorted(r["id"] for r in materialize_alone(spark, make, "outer-alone").collect()) == [3, 4]
    left = [f.split("-")[0] for f in os.listdir(scratch_dir(spark)) if "-alone-" in f]
    assert left == ["outer"]
