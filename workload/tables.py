"""Input frames of the registered queries, derived from the driver tables.

The driver tables have no missing values and no duplicate rows, so untidy
inputs are derived from them by fixed rules; ``SQL`` states the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprep import with_row_order

SQL = {
    "dirty_orders": """
dirty_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ? ' WHEN o_orderkey % 7 = 0 THEN 'unknown'
      ELSE o_orderpriority END AS o_orderpriority
  FROM orders)""",
    "doc_quality": """
doc_quality AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "text_orders": """
text_orders AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 20 = 0 THEN 'n.a.' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS price_text,
    CASE WHEN o_orderkey % 10 = 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
    CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE ' no' END AS done,
    o_orderpriority AS free_text
  FROM orders)""",
    "coded_customers": """
coded_customers AS (
  SELECT c_custkey AS cust_key, (c_custkey * 7) % 90000 + 10000 AS zip_code,
    '0' || (c_nationkey + 10)::VARCHAR AS branch, c_mktsegment AS segment, c_acctbal AS balance,
    CASE WHEN c_acctbal > 0 THEN 'y' ELSE 'n' END AS label
  FROM customer)""",
    "flags": """
flags AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem)""",
    "scored": """
scored AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 25 = 0 THEN 'bad' ELSE 'good' END AS label,
    o_orderstatus AS final_result, 'one' AS constant, o_totalprice
  FROM orders)""",
    "train": """
train AS (SELECT * FROM dirty_orders WHERE o_orderkey % 5 <> 0)""",
    "test": """
test AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice * 30 AS o_totalprice, o_orderdate, o_orderpriority
  FROM dirty_orders WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT * FROM train WHERE o_orderkey % 50 = 1)""",
    "both": """
both_sides AS (SELECT 'train' AS side, * FROM train UNION ALL SELECT 'test' AS side, * FROM test)""",
}


def sql(*names: str) -> str:
    """WITH list of the named derived tables."""
    return ",".join(SQL[n] for n in names)


PAIR = ("dirty_orders", "train", "test", "both")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    orders = read(spark, folder, "orders").withColumns(
        {
            "o_totalprice": F.when(key % 11 == 0, None).when(key % 97 == 0, price * 50).otherwise(price),
            "o_orderpriority": F.when(key % 17 == 0, None).when(key % 13 == 0, " ? ").when(key % 7 == 0, "unknown")
            .otherwise(F.col("o_orderpriority")),
        }
    )
    return with_row_order(orders, "o_orderkey")


def doc_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return with_row_order(documents.join(labels, "doc_id", "left"), "doc_id")


def text_orders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = read(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 20 == 0, "n.a.").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price_text"),
        F.when(key % 10 == 3, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_text"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise(" no").alias("done"),
        F.col("o_orderpriority").alias("free_text"),
    )
    return with_row_order(orders, "o_orderkey")


def coded_customers(spark: SparkSession, folder: str) -> DataFrame:
    customers = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust_key"),
        ((F.col("c_custkey") * 7) % 90000 + 10000).alias("zip_code"),
        F.concat(F.lit("0"), (F.col("c_nationkey") + 10).cast("string")).alias("branch"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") > 0, "y").otherwise("n").alias("label"),
    )
    return with_row_order(customers, "cust_key")


def flags(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 25 == 0, "bad").otherwise("good").alias("label"),
        F.col("o_orderstatus").alias("final_result"),
        F.lit("one").alias("constant"),
        "o_totalprice",
    )
    return with_row_order(orders, "o_orderkey")


def train_and_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders, key = dirty_orders(spark, folder), F.col("o_orderkey")
    train = orders.filter(key % 5 != 0)
    shifted = orders.filter(key % 5 == 0).withColumns(
        {
            "o_orderstatus": F.when(key % 50 == 0, "X").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.col("o_totalprice") * 30,
        }
    )
    return train, shifted.unionByName(train.filter(key % 50 == 1))


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable cells: rounded doubles, bigint integers, joined lists, ISO times."""
    out = []
    for field in df.schema.fields:
        if field.name.startswith("__tp_"):
            continue
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("array<struct<value"):
            c = F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), "|")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind.startswith("map"):
            c = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
        out.append(c.alias(field.name))
    return df.select(*out)
