"""Quality rules: lines that many documents of a host share are removed; documents left with too little are rejected."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.text import SPACES, arrow_map, utf8
from tableprep.plans.scratch import materialize

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
TAILS = bytes(range(0x80, 0xC0))
DIGITS = bytes.maketrans(b"123456789", b"000000000")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINE = "struct<line:bigint,words:bigint>"


def line_key(line: bytes) -> int:
    """Signed 64-bit key of a normalised line: A-Z lower-cased, digits alike, single spaces between words."""
    value = xxhash.xxh3_64_intdigest(b" ".join(line.lower().translate(DIGITS).split()))
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, first occurrences included."""
    if len(words) <= window:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    grams = ids[: len(ids) - window + 1]
    for k in range(1, window):
        # Pairs of codes are numbered anew at each step, so that no product overflows.
        grams = np.unique(grams * len(codes) + ids[k : len(ids) - window + 1 + k], return_inverse=True)[1]
    again = np.bincount(grams)[grams] > 1
    marks = np.zeros(len(ids), bool)
    for k in range(window):
        marks[k : k + len(again)] |= again
    return int(marks.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The values of ``MEASURES``; characters are code points."""
    words = text.split()
    seen: set[bytes] = set()
    doubles = 0
    for line in text.split(b"\n"):
        if line in seen:
            doubles += 1
        elif line and not line.isspace():
            seen.add(line)
    return (
        len(words),
        len(text.translate(None, SPACES + TAILS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        doubles,
        repeated_words(words),
    )


def line_words(text: bytes) -> Counter[int]:
    """Words on each normalised line, all its occurrences together."""
    out: Counter[int] = Counter()
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            out[line_key(line)] += n
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
    for b in batches:
        texts = utf8(b["text"])
        rows = [measure(t) for t in texts]
        values = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        lines = pa.array([[{"line": k, "words": n} for k, n in line_words(t).items()] for t in texts], kind)
        digest = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b["id"], b["host"], digest, *values, lines], ["id", "host", "digest", *MEASURES, "lines"])


def frequent_lines(measured: DataFrame, least_docs: int) -> DataFrame:
    """(host, line, docs) of the lines in at least ``least_docs`` documents of the host.

    Copies of a text are counted before its lines are unfolded, so a large group of copies costs one text.
    """
    texts = measured.groupBy("host", "digest").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    lines = texts.select("host", F.explode("lines.line").alias("line"), "copies")
    return lines.groupBy("host", "line").agg(F.sum("copies").alias("docs")).filter(F.col("docs") >= least_docs)


def line_frequency_filter(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = 10,
    least_words: int = 50, most_removed: float = 0.5, least_left: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """The verdict of each document and the frequent lines of each host.

    A line's key is the hash of its normalised words. A line is above the limit when it stands in at least
    ``least_docs`` documents of its host, copies included; how many other documents the host has does not matter, so a
    line's verdict never weakens as its host grows. A document is depleted when the words outside such lines are fewer
    than ``least_left``, or more than ``most_removed`` of its words stand on them. First table: ``key``, the text
    measures, ``removed_words``, ``base_failed`` (fewer than ``least_words``, or more than half repeated words), ``kept``.

    Null and empty texts have no words and fail; a null host is a host of its own; a null key is a key; repeated rows
    each give a row; empty tables give no rows; further columns are not read. Counting groups pre-aggregate, and the
    join back to the lines splits hot lines by Spark's skew handling.
    """
    picked = {"id": key, "host": F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")), "text": text}
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, host string, digest binary, " + ", ".join(f"{m} bigint" for m in MEASURES) + f", lines array<{LINE}>"
    measured = materialize(arrow_map(docs, picked, _measured, schema), "lines")
    frequent = materialize(frequent_lines(measured, least_docs), "frequent")
    # The removed words of a text of a host are the same in all its copies.
    removed = (
        measured.groupBy("host", "digest").agg(F.first("lines").alias("lines"))
        .select("host", "digest", F.explode("lines").alias("at")).select("host", "digest", F.col("at.line").alias("line"), "at.words")
        .join(frequent.select("host", "line"), ["host", "line"])
        .groupBy("host", "digest").agg(F.sum("words").alias("removed_words"))
    )
    gone = F.coalesce("removed_words", F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - gone < least_left) | (gone > most_removed * F.col("n_words"))
    verdicts = measured.join(removed, ["host", "digest"], "left").select(
        F.col("id").alias(key), *MEASURES, gone.alias("removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )
    return verdicts, frequent


def strip_lines(docs: DataFrame, frequent: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``key`` and the text without the host's frequent lines, other lines untouched and in order.

    Lines are numbered, joined to the frequent ones by host and key of the line, and put together again; a text all of
    whose lines go becomes empty, a null text stays null.
    """
    spot = "struct<at:bigint,line:bigint,raw:string>"
    picked = {"id": key, "host": F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")), "text": text}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int64()), ("line", pa.int64()), ("raw", pa.string())]))
        for b in batches:
            parts = [
                None if t is None else [{"at": i, "line": line_key(x), "raw": x.decode("utf-8", "replace")} for i, x in enumerate(t.split(b"\n"))]
                for t in b["text"].cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b["id"], b["host"], pa.array(parts, kind)], ["id", "host", "parts"])

    kind = docs.schema[key].dataType.simpleString()
    whole = materialize(arrow_map(docs, picked, cut, f"id {kind}, host string, parts array<{spot}>").withColumn("row", F.expr("uuid()")), "cut")
    lines = whole.select("row", "host", F.explode("parts").alias("part")).withColumn("line", F.col("part.line"))
    left = lines.join(frequent.select("host", "line"), ["host", "line"], "left_anti")
    texts = left.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["raw"]), "\n").alias("left"))
    return whole.join(texts, "row", "left").select(
        F.col("id").alias(key), F.when(F.col("parts").isNotNull(), F.coalesce("left", F.lit(""))).alias(text)
    )
