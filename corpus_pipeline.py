"""The corpus pipeline: from the documents table to packed training sequences, each stage stored before the next.

``STAGES`` names the stages in order. A stage takes (spark, docs, sf_dir); all but the last return the columns of
``docs``. Nulls in any column, empty texts, repeated rows and further columns pass through as the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, IntegralType

from tableprep.llm import decontamination, language_id, ngram_join, packing, secrets
from tableprep.llm.text import numbered, restored
from tableprep.plans.scratch import drop_path, materialize, materialize_alone

LANGUAGES = ("en", "de", "fr", "es")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without letters, or in no language that the model knows, go."""
    model = language_id.learn_text(docs, LANGUAGES)
    source, names = numbered(docs)
    found = language_id.identify(source, model, source.columns, names["text"], names["lang"], names["source"])
    return restored(found.filter("kept"), names)


def id_order(doc_id: Column, kind: DataType) -> Column:
    """The id as text whose order is that of the ids, nulls last: whole numbers in 16 digits, others as they are."""
    if isinstance(kind, IntegralType):
        shown = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        shown = doc_id.cast("string")
    return F.when(doc_id.isNotNull(), F.concat(F.lit("a"), shown)).otherwise(F.lit("b"))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself where it is a plain scan of files, so that a row has a file and a place in it; else a stored copy."""
    kind = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return docs if kind == "LogicalRelation" else materialize(docs, "stored")


# Hexadecimal digits of a file's hash and of a row's place in the file; rows that one bitmap covers; bitmaps of 4 KB
# that are broadcast at once, 64 MB.
FILE, PLACE = 16, 12
COVERED, BITMAPS = 32_768, 16_384


def dropped_bitmaps(groups: DataFrame) -> DataFrame:
    """Bitmaps of the rows that are not the first of their component, by file and range of places.

    Rows are first dealt by bitmap, so that each is built once.
    """
    at = lambda start, size: F.conv(F.substring("row", start, size), 16, 10)
    rows = groups.filter("component_id <> row").select(F.substring("row", -PLACE - FILE, FILE).alias("file"), at(-PLACE, PLACE).cast("bigint").alias("place"))
    rows = rows.select("file", F.floor(F.col("place") / COVERED).alias("range"), (F.col("place") % COVERED).alias("bit"))
    return rows.repartition("file", "range").groupBy("file", "range").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near copies, the one of the smallest id stays, rows without an id last.

    A row is told apart by its file and its place there: rows of one id with unrelated texts all stay, of rows of
    one text one stays, and rows without an id are reduced like others. Texts without words are linked with nothing
    and stay. The join's decisions become bitmaps, one bit a row, that go to the scan of the files: no text is shuffled.
    Files are taken in slices whose bitmaps have a bounded size; the tables of the join are dropped before.
    """
    docs = stored(docs)
    scan = docs.metadataColumn("_metadata")
    source, names = numbered(docs.select("*", scan["file_path"].alias("\0path"), scan["row_index"].alias("\0place")))
    path, place = F.col(names.pop("\0path")), F.col(names.pop("\0place"))
    source = source.withColumns({"path": path, "file": F.lpad(F.hex(F.xxhash64(path)), FILE, "0"), "place": place})
    source = source.withColumn(
        "row", F.concat(id_order(F.col(names["doc_id"]), docs.schema["doc_id"].dataType), "file", F.lpad(F.hex("place"), PLACE, "0"))
    )
    bitmaps = materialize_alone(spark, lambda: dropped_bitmaps(ngram_join.near_duplicates(source, "row", names["text"])), "dropped")
    files = source.select("path", "file").distinct().orderBy("path").collect()
    if len({f["file"] for f in files}) < len(files):
        raise RuntimeError("Two file names have one hash; store the table under other names")
    counts = dict(bitmaps.groupBy("file").agg(F.count("*")).collect())
    slices, held = [[]], 0
    for f in files:
        n = counts.get(f["file"], 0)
        if held and held + n > BITMAPS:
            slices.append([])
            held = 0
        slices[-1].append(f)
        held += n
    kept = None
    for part in slices:
        rows, maps = source, bitmaps
        if len(slices) > 1:
            rows = source.filter(F.col("path").between(part[0]["path"], part[-1]["path"]))
            maps = bitmaps.filter(F.col("file").isin([f["file"] for f in part]))
        maps = F.broadcast(maps.select("file", "range", "bitmap"))
        byte = F.substring("bitmap", ((F.col("place") % COVERED) / 8 + 1).cast("int"), F.lit(1))
        bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))"))
        joined = rows.withColumn("range", F.floor(F.col("place") / COVERED)).join(maps, ["file", "range"], "left")
        joined = joined.filter(F.col("bitmap").isNull() | (bit == 0))
        kept = joined if kept is None else kept.unionByName(joined)
    return restored(kept, names)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    source, names = numbered(docs)
    found = decontamination.find_contamination(source, items, source.columns, text=names["text"])
    return restored(found.filter("not contaminated"), names)


def strike_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes ``[SECRET]``; other text and all documents stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scans", strike_secrets),
    ("packing", pack),
]

# The tokenizer of the last stage has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize_alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
