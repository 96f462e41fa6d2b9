"""Records of CSV files whose cells may span lines, read in splits like any text.

A line starts outside a quoted cell or inside one. The lines of a split turn each of the two into the state at its end,
so one small row for each split, put together in file order, tells every split how it starts. A second pass then
forms the records of all splits at once. Only a record that crosses splits is put together by a grouped aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tableprep.plans.scratch import materialize

WHOLE, TAIL, HEAD = 0, 1, 2
_RECORD = "file string, block bigint, place bigint, first boolean, part int, record string"
_RECORD_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("first", pa.bool_()), ("part", pa.int32()), ("record", pa.string()),
])
_SPLIT_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())])
# What follows inside a quoted cell, up to its end or that of the text; the group is empty where the cell stays open.
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+("?)')
_QUOTED = re.compile(r'(?:^|[,\n])"' + _REST.pattern)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that lie in one split, each with its (file, block)."""
    if not batch.num_rows:
        return
    ends = np.union1d(*(pc.run_end_encode(batch.column(n)).run_ends.to_numpy() for n in ("file", "block"))).tolist()
    for start, end in zip([0, *ends], ends):
        run = batch.slice(start, end - start)
        yield (run.column("file")[0].as_py(), run.column("block")[0].as_py()), run


def _text(lines: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()


def _quoted(text: str, inside: bool) -> Iterator[tuple[int, int, bool]]:
    """(start, end, closed) of each quoted cell of whole lines, from -1 where the text starts inside one.

    A quote opens a cell only at the cell's first character.
    """
    at = 0
    if inside:
        rest = _REST.match(text)
        at = rest.end()
        yield -1, at, bool(rest[1])
    if '"' in text:
        for cell in _QUOTED.finditer(text, at):
            yield cell.start(), cell.end(), bool(cell[1])


def ends_inside(text: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of whole lines."""
    closed = True
    for _, _, closed in _quoted(text, inside):
        pass
    return not closed


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split and, inside it, their order. Carriage returns stay, so that cells keep their text."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )


def _split_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split of a task: the state at its end, from either state at its start."""
    split, ends = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_SPLIT_ARROW.names, (*split, *ends)))], _SPLIT_ARROW)

    for batch in batches:
        for at, run in _runs(batch):
            if at != split:
                if split:
                    yield row()
                split, ends = at, (False, True)
            text, (outside, inside) = _text(run.column("line")), ends
            after = ends_inside(text, outside)
            ends = (after, after if inside == outside else ends_inside(text, inside))
    if split:
        yield row()


def _split_starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside) of each split that has lines, stored."""
    quoted = lines.filter(F.contains("line", F.lit('"'))).select("file", "block", "line")
    ends = quoted.mapInArrow(_split_ends, "file string, block bigint, from_outside boolean, from_inside boolean")
    # Splits without quotes leave the state as it is.
    plain = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left").select(
        "file", "block", F.coalesce("from_outside", F.lit(False)).alias("zero"), F.coalesce("from_inside", F.lit(True)).alias("one"),
    )
    # The last earlier split whose end does not depend on its start fixes a state; each later one keeps or flips it.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("zero") == F.col("one")
    flips = F.coalesce(F.sum((F.col("zero") & ~F.col("one")).cast("long")).over(before), F.lit(0))
    at = F.last(F.when(fixed, F.struct(F.col("zero").alias("state"), F.col("flips").alias("flips"))), ignorenulls=True).over(before)
    states = plain.withColumn("flips", flips).withColumn("at", at)
    from_state = F.coalesce(F.col("at.state"), F.lit(False)).cast("long")
    turned = F.col("flips") - F.coalesce(F.col("at.flips"), F.lit(0))
    return materialize(states.select("file", "block", ((from_state + turned) % 2 == 1).alias("inside")), "csv_splits")


def _form_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and at the ends of a split the parts of those that cross it. Blank lines between records go."""
    split, inside, first, part, begun, held = None, False, False, WHOLE, 0, []

    def rows(places: list[int], parts: list[int], records: list[str]) -> pa.RecordBatch:
        nonlocal first
        n = len(records)
        firsts = np.zeros(n, bool)
        firsts[:1], first = first, first and not n
        columns = [
            pa.repeat(split[0], n), pa.repeat(pa.scalar(split[1], pa.int64()), n), pa.array(places, pa.int64()), pa.array(firsts),
            pa.array(parts, pa.int32()), pa.array(records, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_RECORD_ARROW)

    def rest() -> pa.RecordBatch:
        return rows([begun], [HEAD if part == HEAD else TAIL], ["\n".join(held)])

    for batch in batches:
        for at, run in _runs(batch):
            if at != split:
                if held:
                    yield rest()
                starts = run.column("inside")[0].as_py()
                if starts is None:
                    raise RuntimeError(f"{at[0]} was split in another way than before; its size or the session's settings changed")
                split, inside, first, held = at, starts, at[1] == 0, []
                part = HEAD if inside else WHOLE
            text, numbers = _text(run.column("line")), run.column("place").to_numpy()
            cells = np.array(list(_quoted(text, inside)), np.int64).reshape(-1, 3)
            open_ = bool(len(cells)) and not cells[-1, 2]
            # A record ends with each line that ends outside the quoted cells.
            ends = np.cumsum(pc.utf8_length(run.column("line")).to_numpy() + 1) - 1
            cell = np.searchsorted(cells[:, 0], ends, "left") - 1
            whole = ~((cell >= 0) & (ends < np.append(cells[:, 1], 0)[cell]))
            if open_:
                whole[-1] = False
            last = np.flatnonzero(whole)
            starts_at = np.append(0, ends[last] + 1).tolist()
            firsts = numbers[np.append(0, last[:-1] + 1)].tolist() if len(last) else []
            records = [text[a : b - 1] for a, b in zip(starts_at, starts_at[1:])]
            parts = [WHOLE] * len(records)
            if records:
                if held:
                    records[0], firsts[0], held = "\n".join([*held, records[0]]), begun, []
                # The first record of a split that starts inside a cell is a part, blank or not.
                parts[0], head, part = part, part == HEAD or inside, WHOLE
                kept = [i for i, r in enumerate(records) if i == 0 and head or r and not r.isspace()]
                yield rows([firsts[i] for i in kept], [parts[i] for i in kept], [records[i].removesuffix("\r") for i in kept])
            if open_:
                if not held:
                    begun = int(numbers[last[-1] + 1 if len(last) else 0])
                held.append(text[starts_at[-1] :])
            inside = open_
    if held:
        yield rest()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, first, record): every record of the files, stored; ``first`` marks the header of a file.

    Records are in file order by (block, place). Lines end with a line feed, with or without a carriage return; a quote
    that is not a cell's first character opens nothing; a cell left open ends with its file.
    """
    lines = _lines(spark, path)
    # One row for each split of the files, whatever their size.
    starts = F.broadcast(_split_starts(lines))
    formed = lines.join(starts, ["file", "block"], "left").mapInArrow(_form_records, _RECORD)
    stored = materialize(formed, "csv_records")
    crossing = stored.filter(F.col("part") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "place")
    numbered = crossing.withColumn("number", F.sum((F.col("part") == TAIL).cast("long")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "record")))
    joined = numbered.groupBy("file", "number").agg(pieces.alias("pieces"), F.bool_or("first").alias("first")).select(
        "file", F.col("pieces")[0]["block"].alias("block"), F.col("pieces")[0]["place"].alias("place"), "first",
        F.array_join("pieces.record", "\n").alias("record"),
    )
    return stored.filter(F.col("part") == WHOLE).drop("part").unionByName(joined)
