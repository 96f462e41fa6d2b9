"""Whitening against covariances in exact fractions and against numpy, and its odd cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import whitening
from tableprep.llm.queries import QUERIES
from tests.llm.conftest import rows_of


def exact(vectors):
    """n, sums and covariance matrix, by the definition, in fractions."""
    fit = sorted(set(map(tuple, vectors)))
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dims)]
    about = [[n * v[i] - sums[i] for i in range(dims)] for v in fit]
    cov = [[Fraction(sum(a[i] * a[j] for a in about), n**3) for j in range(dims)] for i in range(dims)]
    return n, sums, np.array([[float(c) for c in row] for row in cov])


def test_query_equals_plain_version(spark, small):
    rows = rows_of(small, "embeddings")
    vectors = {r["vec_id"]: [math.floor(256 * c) for c in r["embedding"]] for r in rows}
    n, sums, cov = exact(vectors.values())
    values, components = np.linalg.eigh(cov)
    values, components = values[::-1][:4], components[:, ::-1].T[:4]
    got = QUERIES["op11_polarisation"](spark, small).collect()
    assert len(got) == 4 * len(rows) and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    signs = {}
    for r in got:
        x, k = vectors[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        expected = (np.array(x) - np.array(sums) / n) @ components[k] / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if expected * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign * expected, abs=1e-9)
        assert r["explained"] == pytest.approx(values[k] / cov.trace(), rel=1e-9)


def frame(spark, vectors, parts=3):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in ("key", "v", "dims", "packed", "place", "n", "mean", "whitened")}).repartition(parts)


NAN, INF = float("nan"), float("inf")


def test_rows_that_are_left_out_and_copies(spark):
    good = [[0.1, -0.2, 0.3], [0.1, -0.2, 0.3], [1.0, 2.0, -3.0], [-0.0, 0.0, 1e-9], [5.0, 5.0, 5.0], [0.25, 1.0, 7.0]]
    bad = [None, [None, 1.0, 2.0], [NAN, 1.0, 2.0], [INF, 0.0, 0.0], [0.0, -INF, 0.0], [1e300, 0.0, 0.0], [], [1.0, 2.0]]
    df = frame(spark, good + bad + good[:1] * 50)
    df = df.union(df.filter("vec_id = 4").withColumn("vec_id", F.lit(None).cast("bigint")))
    model = whitening.fit_whitening(df)
    n, sums, cov = exact([[math.floor(256 * c) for c in v] for v in good])
    assert (model.n, model.sums) == (n, sums) == (5, sums) and np.array_equal(model.covariance, cov)
    got = whitening.whiten(df, model).collect()
    kept = [*range(6), *range(14, 64), None]
    assert sorted((r["vec_id"] for r in got), key=str) == sorted(kept, key=str)
    assert len({tuple(r["whitened"]) for r in got if r["vec_id"] in (0, 1, 20)}) == 1
    assert all(len(r["whitened"]) == 3 for r in got) and model.identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(rng.integers(-(2**48), 2**48)), float(rng.integers(0, 9)), float(2**45 + rng.integers(0, 9)), -1e13] for _ in range(40)]
    df = frame(spark, vectors)
    model = whitening.fit_whitening(df)
    whole = [[math.floor(256 * c) for c in v] for v in vectors]
    n, sums, cov = exact(whole)
    assert model.sums == sums and np.array_equal(model.covariance, cov)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, model).collect()}
    assert {i: int(d) for i, d in got.items()} == {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in enumerate(whole)}
    huge = frame(spark, [[3e16], [-3e16]])
    assert {r["deviation"] for r in whitening.whiten(huge, whitening.fit_whitening(huge)).collect()} == {None}


def test_nothing_to_fit(spark):
    for vectors in ([], [None], [[]], [[NAN]]):
        df = frame(spark, vectors)
        assert whitening.fit_whitening(df) is None and whitening.whiten(df, None).collect() == []
    same = frame(spark, [[1.0, 2.0], [1.0, 2.0]])
    model = whitening.fit_whitening(same)
    assert model.n == 1 and len(model.values) == 0
    assert [(int(r["deviation"]), r["whitened"]) for r in whitening.whiten(same, model).collect()] == [(0, []), (0, [])]
    flat = frame(spark, [[1.0, 2.0], [3.0, 2.0], [5.0, 2.0]])
    assert len(whitening.fit_whitening(flat).values) == 1


def test_limbs_and_widths():
    for number in (0, 1, -1, 2**40, -(2**40), 2**150 + 17, -(2**150) - 17):
        assert whitening.joined(whitening.limbs(number)) == number
    assert [len(whitening.packed(np.array([v, 0]))) for v in (127, -128, 128, 32768, 2**31)] == [2, 2, 4, 8, 16]
    cells = [whitening.packed(np.array(v)) for v in ([1, 2], [300, 2], [1, 2**40])]
    assert sorted(m.tolist()[0] for m in whitening.unpacked(cells, 2)) == [[1, 2], [1, 2**40], [300, 2]]
