"""CSV scan with missing-value tokens and inferred types, as a distributed read."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from tableprep.functions.columns import HIDDEN_PREFIX, PrepError, ROW_ORDER, col, count_if, head_in_order, visible
from tableprep.functions.text import ASCII_SPACE, INTEGER, to_number
from tableprep.plans.scratch import materialize_alone
from tableprep.sources.csv_records import csv_records

# Cells a scan takes for missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN_WORDS = ["True", "TRUE", "true", "False", "FALSE", "false"]
_EXTRA, _FILE, _BLOCK, _PLACE, _CELLS = (HIDDEN_PREFIX + part for part in ("extra", "file", "block", "place", "cells"))
QUOTING = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
COLUMNS_PER_JOB = 20


class CsvError(PrepError):
    """The input is not a usable CSV table."""


def _has_multi_line_cells(spark: SparkSession, path: str) -> bool:
    """Whether any physical line leaves a quote open, so that cells span lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> the files that begin with it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    firsts = lines.filter("block = 0").withColumn("place", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "place").alias("line"))
    return _by_line(firsts)


def _by_line(firsts: DataFrame) -> dict[str, list[str]]:
    """From rows (file, line); what comes to the driver is each different header once, with file names."""
    files = firsts.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return {r["line"]: r["files"] for r in files.collect()}


def column_names(line: str) -> list[str]:
    """Names of a header line. A name that came before, in any case, gets ``.1``, ``.2``, ...; a blank one its place."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([line]), [])):
        name, times, base = name or f"Unnamed: {i}", 0, name or f"Unnamed: {i}"
        while name.lower() in {o.lower() for o in out}:
            times += 1
            name = f"{base}.{times}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, *, multi_line: bool | None = None, row_order: bool = True) -> DataFrame:
    """Header row, missing tokens to null, then integer, double, boolean or text per column.

    Files are split. Where a cell spans lines (found out when ``multi_line`` is None), the records of all splits are
    formed first (:mod:`tableprep.sources.csv_records`) and the table is stored, so that who reads it several times does not
    parse them again. Files of a folder are matched by column name: their
    headers may order the same names differently, other names are an error. ``row_order`` attaches the file position as
    the row-order key. A row with more cells than the header is an error; missing trailing cells are null.
    """
    try:
        if multi_line is None:
            multi_line = _has_multi_line_cells(spark, path)
    except AnalysisException as exc:
        raise CsvError(f"Could not read CSV: {exc.getCondition() or exc}") from exc
    if not multi_line:
        return _typed(spark, path, False, row_order)
    names: list[str] = []

    def numbered() -> DataFrame:
        table = _typed(spark, path, True, row_order)
        names.extend(table.columns)
        return table.toDF(*[f"c{i}" for i in range(len(names))])

    return materialize_alone(spark, numbered, "csv_table").toDF(*names)


def _typed(spark: SparkSession, path: str, multi_line: bool, row_order: bool) -> DataFrame:
    try:
        records = None
        if multi_line:
            records = csv_records(spark, path)
            headers = _by_line(records.filter("first").select("file", F.col("record").alias("line")))
        else:
            headers = _headers(spark, path)
    except AnalysisException as exc:
        raise CsvError(f"Could not read CSV: {exc.getCondition() or exc}") from exc
    if not headers:
        raise CsvError("CSV is empty")
    first = min(headers.items(), key=lambda h: h[1][0])[0]
    header = column_names(first)
    if not header:
        raise CsvError("CSV has no columns")
    parts = []
    for line in sorted(headers, key=lambda h: headers[h][0]):
        names = column_names(line)
        if set(names) != set(header):
            raise CsvError(f"Files of {path} have different columns: {', '.join(sorted(set(names) ^ set(header)))}")
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _EXTRA])
        files = None if len(headers) == 1 else headers[line]
        part = _cells_of_lines(spark, files or path, schema) if records is None else _cells_of_records(records, files, schema)
        parts.append(part.select(*[col(n) for n in [*header, _EXTRA]], _FILE, _BLOCK, _PLACE))
    raw = reduce(DataFrame.unionByName, parts)
    cells = raw.withColumns({n: F.when(~col(n).isin(NA_TOKENS), col(n)) for n in header})
    types = _infer(cells, header)

    exprs = []
    for n in header:
        trimmed = F.btrim(col(n), F.lit(ASCII_SPACE))
        exprs.append({
            "bigint": trimmed.try_cast("bigint"),
            "double": to_number(col(n), "text"),
            "boolean": F.lower(trimmed) == "true",
            "string": col(n),
        }[types[n]].alias(n))
    if row_order:
        exprs.append(
            F.struct(
                F.col(_FILE).alias("file_path"), F.col(_BLOCK).alias("file_block_start"), F.col(_PLACE).alias("place"),
            ).alias(ROW_ORDER)
        )
    return cells.select(*exprs)


def _cells_of_lines(spark: SparkSession, files: str | list[str], schema: str) -> DataFrame:
    lines = spark.read.options(header=True, enforceSchema=True, **QUOTING).schema(schema).csv(files)
    return lines.withColumns({
        _FILE: F.col("_metadata.file_path"), _BLOCK: F.col("_metadata.file_block_start"), _PLACE: F.monotonically_increasing_id(),
    })


def _cells_of_records(records: DataFrame, files: list[str] | None, schema: str) -> DataFrame:
    """Cells of the records of some files (None: of all)."""
    rows = records.filter("NOT first")
    if files is not None:
        names = records.sparkSession.createDataFrame([(f,) for f in files], "file string")
        rows = rows.join(F.broadcast(names), "file")  # one row for each file
    parsed = F.from_csv("record", schema, {**QUOTING, "multiLine": "true"})
    return rows.select(
        parsed.alias(_CELLS), F.col("file").alias(_FILE), F.col("block").alias(_BLOCK), F.col("place").alias(_PLACE),
    ).select(f"{_CELLS}.*", _FILE, _BLOCK, _PLACE)


def _infer(cells: DataFrame, header: list[str]) -> dict[str, str]:
    """Narrowest type that holds every present cell of a column."""
    types: dict[str, str] = {}
    for i in range(0, len(header), COLUMNS_PER_JOB):
        part, aggs = header[i : i + COLUMNS_PER_JOB], []
        for n in part:
            inner = F.btrim(col(n), F.lit(ASCII_SPACE))
            whole = inner.rlike(INTEGER) & inner.try_cast("bigint").isNotNull()
            aggs += [F.count(col(n)), count_if(whole), F.count(to_number(col(n), "text")), count_if(col(n).isin(BOOLEAN_WORDS))]
        row = cells.agg(F.count(F.lit(1)), F.count(_EXTRA), *aggs).first()
        if row[1]:
            raise CsvError(f"Could not parse CSV: {row[1]} rows have more cells than the header")
        for j, n in enumerate(part):
            present, whole, number, flags = row[2 + 4 * j : 6 + 4 * j]
            if present == 0:
                types[n] = "double" if row[0] else "string"
            elif whole == present:
                types[n] = "bigint"
            elif number == present:
                types[n] = "double"
            else:
                types[n] = "boolean" if flags == row[0] else "string"
    return types


def ingest_stats(df: DataFrame) -> DataFrame:
    """Row count, column count and column names, in one row."""
    names = visible(df)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(names)).cast("bigint").alias("column_count"),
        F.array(*map(F.lit, names)).alias("columns"),
    )


def table_preview(df: DataFrame, limit: int = 20) -> DataFrame:
    """First rows in row order with the total row count beside them."""
    if not 1 <= limit <= 20:
        raise PrepError("limit must be between 1 and 20")
    total = df.count()
    shown = head_in_order(df, limit).select(*[col(n) for n in visible(df)])
    return shown.withColumn("total_rows", F.lit(total).cast("bigint"))
