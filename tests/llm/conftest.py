"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, further columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

CLASHING = [
    "id", "key", "row", "node", "spans", "items", "start", "words", "host", "digest", "ll", "best", "label", "keep_0", "n_words", "spots", "language",
]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice("the of and in to sunny river stone garden letter window marble silent copper yellow".split()) + rng.choice(["", "s", "ly", "."]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


ODD = [
    (1, None, None, None),
    (2, "", "", ""),
    (3, " \t\n\x0b\x0c\r ", "en", "a"),
    (4, "one two three", "en", "a"),
    (5, "one two three", "en", "a"),
    (6, "Éa ß 日本語 😀 a<|end|>b token = \"abcdef123456\" a b", "fr", "a"),
    (7, prose(1, 300), "en", "b"),
    (7, prose(1, 300), "en", "b"),
    (8, prose(1, 300).replace("river", "rivers", 2), "en", "b"),
    (9, prose(2, 30_000), "en", "b"),
    (None, prose(3, 80), "en", None),
    (None, None, "de", None),
    (10, "x" * 100_000, "xx-YY", "c"),
    (11, "AKIA" + "A1" * 10 + " user: someone secret: hunter2hunter2", "EN-us", "c"),
    (12, "| " * 500, "de", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


def rows_of(small, table):
    import pyarrow.dataset as ds

    return ds.dataset(f"{small}/{table}.parquet").to_table().to_pylist()
