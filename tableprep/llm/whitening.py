"""Embedding whitening: exact covariances by polarisation, principal components, whitened projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.text import arrow_map
from tableprep.plans.scratch import materialize

# Sums of whole numbers travel as limbs of so many bits, of which a long column can add up 2^23 without overflow.
LIMB_BITS, LIMBS = 40, 5
# Whole numbers below this bound are squared and added in 64 bits for a batch of up to 2^12 rows, greater ones in Python's.
SMALL = 1 << 23
BATCH_ROWS = 1 << 12


@dataclass
class Whitening:
    """What was fitted: ``n`` distinct vectors of ``dims`` entries, their sums, covariance and components.

    ``components`` holds a unit eigenvector in each row, by falling eigenvalue; ``values`` the eigenvalues, of which only
    those above rounding are kept; ``explained`` their shares of the trace; ``identity_error`` the largest absolute entry
    of the whitened fit list's covariance minus the identity, over the components kept.
    """

    dims: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    def nearest(self) -> list[int]:
        """The whole number nearest to each mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def rest(self) -> list[int]:
        """What ``n`` times :meth:`nearest` lacks of each sum; at most n / 2 in size."""
        return [s - self.n * m for s, m in zip(self.sums, self.nearest())]


def wholes(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """floor(scale * entry) of every list, as int64; None for a null list and for entries that are null, not finite or no long."""
    flat = vectors.values
    offsets = vectors.offsets.to_numpy()
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    scaled = np.floor(values * scale)
    bad = ~(np.isfinite(scaled) & (np.abs(scaled) < 2.0**63))  # a null reads as NaN
    whole = np.where(bad, 0, scaled).astype(np.int64)
    if len(flat) and flat.null_count:
        bad |= flat.is_null().to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = [whole[a:b] if k and wrong[a] == wrong[b] else None for a, b, k in zip(offsets[:-1], offsets[1:], known)]
    return whole, rows


def packed(row: np.ndarray) -> bytes:
    """The vector in the fewest bytes an entry that hold all its entries, so that equal vectors have equal bytes."""
    if not len(row):
        return b""
    low, high = int(row.min()), int(row.max())
    for kind in ("<i1", "<i2", "<i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return row.astype(kind).tobytes()
    return row.astype("<i8").tobytes()


def unpacked(cells: list[bytes], dims: int) -> Iterator[np.ndarray]:
    """int64 matrices of packed vectors, one for each width that occurs."""
    by_width: dict[int, list[bytes]] = {}
    for c in cells:
        by_width.setdefault(len(c) // dims, []).append(c)
    for width, rows in by_width.items():
        for at in range(0, len(rows), BATCH_ROWS):
            part = rows[at : at + BATCH_ROWS]
            yield np.frombuffer(b"".join(part), f"<i{width}").reshape(len(part), dims).astype(np.int64)


def limbs(total: int) -> list[int]:
    """The number in limbs of LIMB_BITS bits, the last with the sign."""
    low = [(total >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
    return [*low, total >> (LIMB_BITS * (LIMBS - 1))]


def joined(parts: list[int]) -> int:
    return sum(p << (LIMB_BITS * k) for k, p in enumerate(parts))


def exact_totals(fit: DataFrame, of_matrix: Callable[[np.ndarray], np.ndarray], dims: int, width: int) -> list[int]:
    """Exact sums of ``of_matrix`` (``width`` whole numbers) over all vectors: added up in each task, limbs over tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for b in batches:
            for matrix in unpacked(b["packed"].to_pylist(), dims):
                total = total + of_matrix(matrix).astype(object)
        split = [limbs(int(t)) for t in total]
        for at in range(0, width, BATCH_ROWS):
            part = split[at : at + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + len(part)), pa.int64()), *[pa.array([s[k] for s in part], pa.int64()) for k in range(LIMBS)]],
                ["place", *[f"l{k}" for k in range(LIMBS)]],
            )

    fields = "place bigint, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))
    summed = arrow_map(fit, {"packed": "packed"}, work, fields).groupBy("place").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    out = [0] * width
    for r in summed.collect():
        out[r["place"]] = joined([r[f"l{k}"] for k in range(LIMBS)])
    return out


def centred(matrix: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """In 64 bits where squares of pair sums of a batch add up in them, else in Python's numbers."""
    if max(np.abs(matrix).max(initial=0), np.abs(centre).max(initial=0)) < SMALL:
        return matrix - centre.astype(np.int64)
    return matrix.astype(object) - centre


def column_sums(matrix: np.ndarray) -> np.ndarray:
    high, low = matrix >> 32, matrix & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


def squares(centre: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of squares of each centred dimension and of the sum of each pair (i, j), i < j, in the order of ``triu_indices``."""

    def of_matrix(matrix: np.ndarray) -> np.ndarray:
        z = centred(matrix, centre)
        out = []
        for i in range(z.shape[1]):
            pair = z[:, i:] + z[:, i : i + 1]
            pair[:, 0] = z[:, i]
            out.append((pair * pair).sum(axis=0))
        return np.concatenate(out)

    return of_matrix


def covariance(n: int, rest: list[int], sums: list[int], dims: int) -> np.ndarray:
    """Covariances from the sums of squares of dimensions and pair sums, exact until the last division.

    With the squares' sum Q of values that were centred at a whole number and ``d`` what n such numbers lack of the sum,
    the exact sum of squares about the mean is (n Q - d d) / n; and 2 cov(i, j) = var(i + j) - var(i) - var(j).
    """
    rows, columns = np.triu_indices(dims)
    about_mean = [n * q - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for i, j, q in zip(rows.tolist(), columns.tolist(), sums)]
    own = {i: v for i, j, v in zip(rows.tolist(), columns.tolist(), about_mean) if i == j}
    out = np.zeros((dims, dims))
    for i, j, v in zip(rows.tolist(), columns.tolist(), about_mean):
        out[i, j] = out[j, i] = v / (n * n) if i == j else (v - own[i] - own[j]) / (2 * n * n)
    return out


def projected(matrix: np.ndarray, centre: np.ndarray, shift: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Vectors about their mean times ``onto``; the whole part of the mean is taken off before anything is rounded."""
    return (centred(matrix, centre).astype(np.float64) - shift) @ onto


def moments(fit: DataFrame, dims: int, centre: np.ndarray, shift: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Covariance of the projected vectors: each batch about its own mean, batches and tasks put together by their means."""
    width = onto.shape[1]

    def merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for matrix in unpacked(b["packed"].to_pylist(), dims):
                w = projected(matrix, centre, shift, onto)
                mean = w.mean(axis=0)
                total = merged(total, (len(w), mean, (w - mean).T @ (w - mean)))
        if total:
            n, mean, about = total
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([about.ravel().tolist()])], ["n", "mean", "about"])

    total = None
    parts = arrow_map(fit, {"packed": "packed"}, work, "n bigint, mean array<double>, about array<double>")
    for r in parts.collect():
        total = merged(total, (r["n"], np.array(r["mean"]), np.array(r["about"]).reshape(width, width)))
    return total[2] / total[0]


def fit_whitening(df: DataFrame, vector: str = "embedding", scale: int = 256, keep: int = 4) -> Whitening | None:
    """Fits on each distinct vector of whole numbers floor(scale * entry) once; None where no vector has an entry.

    1. Vectors are packed into the fewest bytes and made distinct by one shuffle, in which copies meet first in each task;
       the list is stored. Its count and sums are exact.
    2. For every dimension and every pair of dimensions the squares of the centred values, and of the centred pair sums,
       are added up exactly. Differences of these variances give all covariances (polarisation), each rounded once.
    3. The covariance matrix, dims * dims numbers, is all that reaches the driver, for ``eigh``. A last pass over the
       list measures the whitened covariance.

    Rows whose vector is null, or holds a null, a number that is not finite or one whose whole number is no long, are left
    out. Where lengths differ, the length of the most distinct vectors counts, of equal ones the greater, and vectors of
    others are left out. Empty vectors and tables give None; repeated rows count once.
    """
    source = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in wholes(b["v"], scale)[1] if r is not None and len(r)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(r) for r in rows], pa.int64()), pa.array([packed(r) for r in rows], pa.binary())], ["dims", "packed"]
            )

    fit = materialize(arrow_map(source, {"v": "v"}, pack, "dims bigint, packed binary").distinct(), "fit")
    lengths = fit.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    dims, n = lengths["dims"], lengths["n"]
    fit = fit.filter(F.col("dims") == dims)
    found = Whitening(dims, n, exact_totals(fit, column_sums, dims, dims), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    centre = np.array(found.nearest(), object)
    found.covariance = covariance(n, found.rest(), exact_totals(fit, squares(centre), dims, dims * (dims + 1) // 2), dims)
    values, vectors = np.linalg.eigh(found.covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    large = values > max(values[0], 0) * dims * np.finfo(float).eps
    found.values, found.components = values[large][:keep], vectors[large][:keep]
    # The entry of the largest size is positive, so that a fit repeats its signs.
    found.components = found.components * np.sign(found.components[np.arange(len(found.components)), np.abs(found.components).argmax(axis=1)])[:, None]
    trace = float(np.trace(found.covariance))
    found.explained = found.values / trace if trace else found.values
    if len(found.values):
        onto = found.components.T / np.sqrt(found.values)
        shift = np.array([d / n for d in found.rest()])
        found.identity_error = float(np.abs(moments(fit, dims, centre, shift, onto) - np.eye(len(found.values))).max())
    return found


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``key``, ``deviation`` (decimal: exact sum over dimensions of (n x - S)^2) and ``whitened`` (array, one a component).

    Rows that the fit leaves out by their vector give no row; repeated rows each give one; null keys are kept; further
    columns are not read. A deviation of more than 38 digits is null. A fit without components (all vectors equal) gives
    empty arrays, no fit no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")
    n, dims = model.n, model.dims
    centre, rest = np.array(model.nearest(), object), model.rest()
    shift = np.array([d / n for d in rest])
    onto = model.components.T / np.sqrt(model.values) if len(model.values) else np.zeros((dims, 0))
    of_rest, most = sum(d * d for d in rest), 10**38

    def deviations(matrix: np.ndarray) -> Iterator[Decimal | None]:
        """(n x - S)^2 summed: with z = x - nearest and d = S - n nearest, n n z z - 2 n z d + d d."""
        z = centred(matrix, centre)
        own = (z * z).sum(axis=1).astype(object)
        across = z @ np.array(rest, np.int64) if z.dtype != object and n * dims < 1 << 37 else z.astype(object) @ np.array(rest, object)
        for a, b in zip(own, across.astype(object)):
            value = n * n * a - 2 * n * b + of_rest
            yield Decimal(value) if value < most else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = wholes(b["v"], scale)[1]
            places = [i for i, r in enumerate(rows) if r is not None and len(r) == dims]
            for at in range(0, len(places), BATCH_ROWS):
                part = places[at : at + BATCH_ROWS]
                matrix = np.stack([rows[i] for i in part])
                flat = pa.array(projected(matrix, centre, shift, onto).ravel(), pa.float64())
                offsets = pa.array(np.arange(len(part) + 1) * onto.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b["key"].take(pa.array(part)), pa.array(list(deviations(matrix)), pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, flat)],
                    ["key", "deviation", "whitened"],
                )

    columns = {"key": key, "v": F.col(f"`{vector}`").cast("array<double>")}
    return arrow_map(df, columns, work, f"key {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("key", key)
