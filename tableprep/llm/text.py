"""Shared text rules: words, splits and Arrow passes over the rows of a table."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space of the word rules.
SPACES = b"\t\n\x0b\x0c\r "


def _folded() -> bytes:
    table = bytearray(range(256))
    for code in range(128):
        char = chr(code)
        table[code] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


# ASCII letters to lower case, other ASCII than letters and digits to a space, bytes of other characters as they are.
FOLD = _folded()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, ASCII digits and all non-ASCII characters."""
    return text.translate(FOLD).split()


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def held_out(key: str, parts: int) -> Column:
    """True for one in ``parts`` keys, by the CRC-32 of the key's text; a null key counts as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts == 0


# Rows of an Arrow batch.
ROWS = 500
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, since texts can be long; and, once an application, this package for workers that lack it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(), "tableprep_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "tableprep")):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


_kept: dict[str, object] = {}


def kept(name: str, build: Callable[[], object]) -> object:
    """The object of that name that this Python worker keeps between its tasks; it keeps one at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    return _kept[name]


def begin_task(keeps: str | None) -> None:
    """Let go of what an earlier operator kept in this worker, unless this one uses it."""
    if keeps not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def arrow_map(
    df: DataFrame, columns: dict[str, Column | str], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
    keeps: str | None = None,
) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that other columns, whatever their names, are neither read nor sent.

    ``keeps``: the name of the object that ``work`` keeps by :func:`kept`.
    """
    prepare(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(keeps)
        yield from work(batches)

    picked = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select(*picked).mapInArrow(task, schema)


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... so that none clashes with a new one, and the number of each name."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the numbered columns, under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])
