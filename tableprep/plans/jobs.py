"""Independent Spark jobs side by side, so that small ones do not wait for each other."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def side_by_side(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Results of the jobs in order; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [w.result() for w in waiting]
