"""Exact, linearly interpolated quantiles without a one-task value map.

Small columns use the built-in exact aggregate, and columns with few distinct
values use it on their value counts. The others are narrowed first:
a quantile sketch gives a bracket of values around each rank, one counting pass
proves that the rank lies inside, and only the values in the bracket are
grouped. Sketch and counts are map-side aggregates, so no pass shuffles the
column itself; a bracket that still holds too many values is sketched again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import count_if

DIRECT_ROWS = 200_000
BRACKET_VALUES = 100_000
ACCURACY = 10_000


@dataclass
class _Bracket:
    key: str
    value: Column
    prob: float
    rows: int
    low: float
    high: float
    slack: float = 2.0 / ACCURACY
    below: int = 0
    inside: int = 0
    settled: bool = False
    index: int = field(init=False)
    weight: float = field(init=False)

    def __post_init__(self) -> None:
        position = self.prob * (self.rows - 1)
        self.index = min(math.floor(position), self.rows - 1)
        self.weight = position - self.index

    @property
    def last(self) -> int:
        return self.index + (1 if self.weight > 0 else 0)

    def holds(self) -> bool:
        return self.below <= self.index and self.last < self.below + self.inside

    def within(self) -> Column:
        return self.value.between(F.lit(self.low), F.lit(self.high))


def _aggregate(df: DataFrame, aggs: list[Column], chunk: int = 120) -> list:
    """Values of scalar aggregates, at most ``chunk`` per job to keep generated code small."""
    out: list = []
    for i in range(0, len(aggs), chunk):
        part = aggs[i : i + chunk]
        out.extend(df.agg(*[a.alias(f"a{j}") for j, a in enumerate(part)]).first())
    return out


def exact_quantiles(
    df: DataFrame,
    requests: dict[str, tuple[Column, list[float]]],
    *,
    counts: dict[str, int] | None = None,
    uniques: dict[str, int] | None = None,
    direct_rows: int = DIRECT_ROWS,
    bracket_values: int = BRACKET_VALUES,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles of each requested double expression; None for empty columns.

    ``counts`` and ``uniques`` are known numbers of values and of distinct
    values per request, where the caller has them.
    """
    if not requests:
        return {}
    if counts is None:
        values = _aggregate(df, [F.count(value) for value, _ in requests.values()])
        counts = dict(zip(requests, values))
    result: dict[str, list[float | None]] = {key: [None] * len(probs) for key, (_, probs) in requests.items()}

    direct = [key for key in requests if 0 < counts[key] <= direct_rows]
    if direct:
        values = _aggregate(df, [F.percentile(requests[k][0], F.array(*map(F.lit, requests[k][1]))) for k in direct], 8)
        result.update({key: list(found) for key, found in zip(direct, values)})

    large = [key for key in requests if counts[key] > direct_rows]
    few = [key for key in large if (uniques or {}).get(key, bracket_values) < bracket_values]
    if few:
        result.update(_from_value_counts(df, {key: requests[key] for key in few}))
        large = [key for key in large if key not in few]
    if large:
        brackets = _sketch(df, requests, counts, large, accuracy)
        _narrow(df, brackets, bracket_values, accuracy)
        picked = _pick(df, [b for b in brackets if b.low < b.high])
        for key in large:
            result[key] = []
        for number, b in enumerate(brackets):
            if b.low == b.high:
                result[b.key].append(b.low)
            else:
                first, last = picked[id(b)]
                result[b.key].append(first + (last - first) * b.weight)
    return result


def _from_value_counts(df: DataFrame, requests: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float]]:
    """Exact quantiles over (value, count) rows; counts are pre-aggregated in each task."""
    names = {f"q{i}": key for i, key in enumerate(requests)}
    flat = df.select(*[requests[key][0].alias(name) for name, key in names.items()])
    tall = flat.unpivot([], list(names), "name", "value").filter("value IS NOT NULL")
    counted = tall.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    probs = sorted({p for _, wanted in requests.values() for p in wanted})
    rows = counted.groupBy("name").agg(F.percentile("value", F.array(*map(F.lit, probs)), F.col("n")).alias("q")).collect()
    return {names[r["name"]]: [r["q"][probs.index(p)] for p in requests[names[r["name"]]][1]] for r in rows}


def _sketch(df, requests, counts, large, accuracy) -> list[_Bracket]:
    aggs = []
    for key in large:
        value, probs = requests[key]
        slack = 2.0 / accuracy
        ends = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
        aggs += [F.min(value), F.max(value), F.percentile_approx(value, [float(e) for e in ends], accuracy)]
    values = _aggregate(df, aggs, 60)
    brackets = []
    for i, key in enumerate(large):
        value, probs = requests[key]
        least, most, ends = values[3 * i : 3 * i + 3]
        for j, p in enumerate(probs):
            low = least if p - 2.0 / accuracy <= 0 else ends[j]
            high = most if p + 2.0 / accuracy >= 1 else ends[len(probs) + j]
            brackets.append(_Bracket(key, value, p, counts[key], low, high, slack=2.0 / accuracy))
    return brackets


def _narrow(df: DataFrame, brackets: list[_Bracket], bracket_values: int, accuracy: int) -> None:
    open_ = list(brackets)
    while open_:
        aggs = [a for b in open_ for a in (count_if(b.value < F.lit(b.low)), count_if(b.within()))]
        values = _aggregate(df, aggs)
        for i, b in enumerate(open_):
            b.below, b.inside = values[2 * i : 2 * i + 2]
        missed = [b for b in open_ if not b.holds()]
        wide = [b for b in open_ if b.holds() and b.low < b.high and b.inside > bracket_values and not b.settled]
        # Many rows inside may still be few values: equal rows collapse in the grouping that follows.
        distinct = _aggregate(df, [F.approx_count_distinct(F.when(b.within(), b.value)) for b in wide], 8)
        crowded = [b for b, n in zip(wide, distinct) if n > bracket_values]
        if missed:
            _widen(df, missed, accuracy)
        if crowded:
            _refine(df, crowded, accuracy)
        open_ = missed + [b for b in crowded if not b.settled]


def _widen(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    aggs = []
    for b in brackets:
        b.slack *= 4
        ends = [max(b.prob - b.slack, 0.0), min(b.prob + b.slack, 1.0)]
        aggs += [F.min(b.value), F.max(b.value), F.percentile_approx(b.value, ends, accuracy)]
    values = _aggregate(df, aggs, 60)
    for i, b in enumerate(brackets):
        least, most, ends = values[3 * i : 3 * i + 3]
        b.low = least if b.prob - b.slack <= 0 else ends[0]
        b.high = most if b.prob + b.slack >= 1 else ends[1]


def _refine(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    aggs = []
    for b in brackets:
        ends = [(b.index - b.below) / b.inside, (b.last - b.below) / b.inside]
        ends = [max(ends[0] - 2.0 / accuracy, 0.0), min(ends[1] + 2.0 / accuracy, 1.0)]
        aggs.append(F.percentile_approx(F.when(b.within(), b.value), ends, accuracy))
    for b, (low, high) in zip(brackets, _aggregate(df, aggs, 60)):
        before = (b.low, b.high)
        at_low = (b.index - b.below) / b.inside - 2.0 / accuracy <= 0
        at_high = (b.last - b.below) / b.inside + 2.0 / accuracy >= 1
        b.low, b.high = (b.low if at_low else low), (b.high if at_high else high)
        b.settled = before == (b.low, b.high)


def _pick(df: DataFrame, brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """Values at the two ranks of each bracket, from its value counts."""
    if not brackets:
        return {}
    # Unpivoted first: filters on the values themselves would compute each value once for every bound.
    names = {key: f"q{i}" for i, key in enumerate(dict.fromkeys(b.key for b in brackets))}
    exprs = {names[b.key]: b.value.alias(names[b.key]) for b in brackets}
    tall = df.select(*exprs.values()).unpivot([], list(exprs), "name", "value")
    within = [(F.col("name") == names[b.key]) & F.col("value").between(F.lit(b.low), F.lit(b.high)) for b in brackets]
    near = tall.filter(reduce(Column.__or__, within))
    places = F.filter(F.array(*[F.when(inside, F.lit(i)) for i, inside in enumerate(within)]), lambda i: i.isNotNull())
    counted = near.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(F.explode(places).alias("bracket"), "value", "n")
    upto = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(upto))
    first = F.create_map(*[x for i, b in enumerate(brackets) for x in (F.lit(i), F.lit(b.index - b.below))])
    last = F.create_map(*[x for i, b in enumerate(brackets) for x in (F.lit(i), F.lit(b.last - b.below))])
    rows = (
        ranked.groupBy("bracket")
        .agg(
            F.min(F.when(F.col("upto") > first[F.col("bracket")], F.col("value"))).alias("first"),
            F.min(F.when(F.col("upto") > last[F.col("bracket")], F.col("value"))).alias("last"),
        )
        .collect()
    )
    return {id(brackets[r["bracket"]]): (r["first"], r["last"]) for r in rows}
