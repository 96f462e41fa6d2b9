"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time, adds up to one lookup table for each feature and for each of
the strongest pairs of features; scoring is one addition of a bin's value for each table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.line_frequency import SYMBOLS, TAILS
from tableprep.llm.text import SPACES, arrow_map, held_out, utf8
from tableprep.plans.scratch import materialize

FEATURES = (
    "log_words", "word_length", "longest_word", "symbols", "bars", "punctuation", "exclamations", "digits", "capitals", "other_letters",
    "distinct_words", "top_word", "adjacent_repeats", "repeated_windows", "double_lines", "log_lines", "line_words", "sentence_ends",
)
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
MARKS = b".,;:!?'\"()-"


def features(text: bytes) -> list[float]:
    """Values of ``FEATURES`` of a whole text; shares are of its words or characters, 0 for an empty text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    without = lambda drop: size - len(text.translate(None, drop))
    chars = max(1, len(text.translate(None, SPACES + TAILS)))
    upper, lower = without(UPPER), without(LOWER)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    repeats = 0
    if n > 3:
        k = len(codes)
        pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        windows = np.unique(pairs * k + ids[2:], return_inverse=True)[1]
        repeats = int((np.bincount(windows)[windows] > 1).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return [
        math.log1p(n), chars / n, max(map(len, words)), without(SYMBOLS) / chars, text.count(b"|") / n, without(MARKS) / chars, text.count(b"!") / n,
        without(DIGITS) / chars, upper / max(1, upper + lower), (chars - len(text.translate(None, SPACES + bytes(range(128, 256))))) / chars,
        len(codes) / n, int(counts.max()) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, repeats / n,
        1 - len(set(lines)) / len(lines), math.log1p(len(lines)), n / len(lines), text.count(b".") / n,
    ]


@dataclass(frozen=True)
class Fitting:
    """``rows``: the most labelled rows that the tables are fitted on, those of the smallest key hashes."""

    rows: int = 40_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 10
    rounds: int = 120
    pair_rounds: int = 40
    rate: float = 0.15
    ridge: float = 5.0


@dataclass
class Tables:
    """``edges`` of a feature's bins, its ``main`` values; for pairs (i, j) a grid over coarser bins."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    main: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """One lookup and addition for each table, over all rows at once."""
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.main):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        places = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (i, j), grid in self.pairs.items():
            out += grid[places[i], places[j]]
        return out


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins: those before it against the rest; place 0: none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Newton steps of a tree of at most ``leaves`` leaves over a row of bins, as a table of values."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, place, a, b = max(cuts)
        if gain <= 1e-9 or not place:
            break
        parts.remove((a, b))
        parts += [(a, a + place), (a + place, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best tree of one cut on the first feature and one on the second in either part; its gain and values."""
    best = (0.0, np.zeros_like(g))
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for row in range(1, len(g)):
        out, gain = np.zeros_like(g), -whole
        for part in (slice(0, row), slice(row, None)):
            a, b = g[part].sum(axis=0), h[part].sum(axis=0)
            cut = _best_cut(a, b, ridge)[1]
            for side in (slice(0, cut), slice(cut, None)):
                if b[side].size:
                    value = a[side].sum() / (b[side].sum() + ridge)
                    out[part, side] = value
                    gain += value * a[side].sum()
        if gain > best[0]:
            best = (gain, out)
    return best


def fit(x: np.ndarray, y: np.ndarray, how: Fitting = Fitting()) -> Tables:
    """Cyclic boosting under logistic loss. Without rows, or with one class only, the base alone speaks."""
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    width = x.shape[1]
    edges = [_edges(x[:, j], how.bins) for j in range(width)]
    coarse = [_edges(x[:, j], how.pair_bins) for j in range(width)]
    out = Tables(base, edges, coarse, [np.zeros(len(e) + 1) for e in edges])
    if not 0 < y.sum() < len(y):
        return out
    places = [np.searchsorted(edges[j], x[:, j], "right") for j in range(width)]
    logit = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(how.rounds):
        for j in range(width):
            g, h = slopes()
            size = len(out.main[j])
            step = how.rate * shallow_tree(np.bincount(places[j], g, size), np.bincount(places[j], h, size), how.ridge)
            out.main[j] += step
            logit += step[places[j]]
    spots = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(width)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        rows, columns = shape(i, j)
        at = spots[i] * columns + spots[j]
        return np.bincount(at, g, rows * columns).reshape(rows, columns), np.bincount(at, h, rows * columns).reshape(rows, columns)

    strength = {(i, j): grid_tree(*grids(i, j), how.ridge)[0] for i in range(width) for j in range(i + 1, width)}
    chosen = sorted(strength, key=lambda p: (-strength[p], p))[: how.pairs]
    out.pairs = {p: np.zeros(shape(*p)) for p in chosen if strength[p] > 0}
    for _ in range(how.pair_rounds):
        for (i, j), table in out.pairs.items():
            step = how.rate * grid_tree(*grids(i, j), how.ridge)[1]
            table += step
            logit += step[spots[i], spots[j]]
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [features(t) for t in utf8(b["text"])]
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(values, pa.list_(pa.float64()))], ["id", "x"])


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 5, how: Fitting = Fitting(),
    threshold: float = 0.3,
) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text; the model learns from labels outside the held-out part.

    Features come from the text alone. At most ``how.rows`` labelled rows are fitted on (a documented bound of what is
    sent to the driver); the features of all texts are computed once and stored, and scored from there.

    Null and empty texts have zero features and a score like others; several labels of a key are averaged, a tie is 1;
    null labels and labels of unknown keys do not count; without labels every score is 0.5; a null key is held out only
    if the text '' is, and is never labelled; repeated rows each give a row; no documents give no rows; further columns
    are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    measured = materialize(arrow_map(docs, {"id": key, "text": text}, _measured, f"id {kind}, x array<double>"), "features")
    known = (
        labels.filter(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.avg(F.col(f"`{label}`")).alias("y"))
        .filter(~held_out("id", parts)).select("id", (F.col("y") >= 0.5).cast("double").alias("y"))
    )
    sample = measured.join(known, "id").select("x", "y", F.xxhash64("id").alias("h")).orderBy("h", "x").limit(how.rows).toArrow()
    x = np.array(sample["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    sent = docs.sparkSession.sparkContext.broadcast(fit(x, sample["y"].to_numpy(), how))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-sent.value.logits(values)))
            predicted = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(score), pa.array(predicted)], ["id", "score", "predicted"])

    out = arrow_map(measured, {"id": "id", "x": "x"}, scored, f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(key), held_out("id", parts).alias("held_out"), "score", "predicted")
