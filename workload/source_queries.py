"""Queries over sources, sinks and result tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tableprep import (
    CsvError, FittedPipeline, apply_and_export, ingest_stats, latest_per_key, list_results, newest_first, profile_table, read_csv,
    run_history, store_results, table_preview,
)
from tableprep.plans.scratch import scratch_path
from workload import oracle_profile as O
from workload.registry import register
from workload.step_queries import SINGLE, STEPS, steps_sql
from workload.tables import PAIR, dirty_orders, doc_quality, flat, read, sql, train_and_test

CSV_COLUMNS = """o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderkey % 2 = 0 AS even,
  'said "' || o_orderstatus || '", then' || chr(10) || 'left' AS remark"""


def _written(spark, folder) -> str:
    """Orders as a CSV folder with missing tokens, quotes, commas and line breaks inside cells."""
    orders = dirty_orders(spark, folder).select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.coalesce(F.col("o_totalprice").cast("string"), F.lit("NA")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 2 == 0, "True").otherwise("False").alias("even"),
        F.concat(F.lit('said "'), "o_orderstatus", F.lit('", then\nleft')).alias("remark"),
    )
    path = scratch_path(spark, "csv")
    orders.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


register(
    "csv_na_scan", lambda s, d: flat(read_csv(s, _written(s, d))),
    f"WITH {sql('dirty_orders')} SELECT {CSV_COLUMNS} FROM dirty_orders",
)


def _multi_line_splits(s, d):
    """The same files, each read in splits of 64 KB whose records cross them."""
    path, size, tasks = _written(s, d), "spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum"
    before, limit = s.conf.get(size), s.conf.get(tasks, None)
    # A task reads many splits, so that the number of tasks does not follow the small size.
    length = s.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    s.conf.set(size, str(1 << 16))
    s.conf.set(tasks, str(max(4 * s.sparkContext.defaultParallelism, length >> 27)))
    try:
        df = read_csv(s, path)
    finally:
        s.conf.set(size, before)
        s.conf.set(tasks, limit) if limit else s.conf.unset(tasks)
    place = F.col("__tp_row")
    several = df.agg(F.count_distinct(place["file_path"], place["file_block_start"]) > F.count_distinct(place["file_path"])).first()[0]
    return flat(df.withColumn("several", F.lit(several)))


register(
    "csv_multi_line_splits", _multi_line_splits,
    f"WITH {sql('dirty_orders')} SELECT {CSV_COLUMNS}, true AS several FROM dirty_orders",
)


def _csv_types(s, d):
    df = read_csv(s, _written(s, d), row_order=False)
    counted = profile_table(df).select("column_name", "missing_count")
    kinds = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return flat(counted.withColumn("type", kinds[F.col("column_name")]))


register(
    "csv_types", _csv_types,
    f"WITH {sql('dirty_orders')}, c AS (SELECT {CSV_COLUMNS} FROM dirty_orders) " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) - count({c}) AS missing_count FROM c"
        for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                     ("o_orderpriority", "string"), ("even", "boolean"), ("remark", "string"))
    ),
)
register(
    "ingest_stats", lambda s, d: flat(ingest_stats(read(s, d, "orders"))),
    "SELECT count(*) AS row_count, 6::BIGINT AS column_count, 'o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority' AS columns FROM orders",
)
register(
    "table_preview",
    lambda s, d: flat(table_preview(dirty_orders(s, d), 12).select("o_orderkey", "o_totalprice", "o_orderpriority", "total_rows")),
    f"""WITH {sql('dirty_orders')} SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, (SELECT count(*) FROM orders) AS total_rows
      FROM dirty_orders ORDER BY o_orderkey LIMIT 12""",
)


def _export_single(s, d):
    folder = scratch_path(s, "export")
    _, paths = apply_and_export(dirty_orders(s, d), STEPS, folder, inputs=["orders"])
    return flat(read_csv(s, paths["cleaned_single"]))


register("export_single_roundtrip", _export_single, f"WITH {sql('dirty_orders')},{SINGLE[0]} {SINGLE[1]}")


def _export_pair(s, d):
    folder = scratch_path(s, "export")
    train, test = train_and_test(s, d)
    _, paths = apply_and_export(train, STEPS, folder, test=test, fmt="parquet", inputs=["train", "test"])
    replayed = FittedPipeline.load(s, folder).transform(test)
    stored = s.read.parquet(paths["cleaned_train"]).withColumn("side", F.lit("train"))
    return flat(stored.unionByName(replayed.drop("__tp_row").withColumn("side", F.lit("test"))))


ctes, tail = steps_sql("train", "both_sides")
register("export_train_test_replay", _export_pair, f"WITH {sql(*PAIR)},{ctes} {tail}")


def _stored_profiles(s, d):
    path = scratch_path(s, "profiles")
    store_results(profile_table(dirty_orders(s, d)), "run-1", path)
    store_results(profile_table(doc_quality(s, d)), "run-2", path)
    return flat(list_results(s, path, "run-2", "ordinal").select("run_id", "ordinal", "column_name", "inferred_type", "missing_count"))


register(
    "result_tables_roundtrip", _stored_profiles,
    f"WITH {sql('doc_quality')},{O.profile('doc_quality')} SELECT 'run-2' AS run_id, ordinal, column_name, inferred_type, missing_count FROM prof",
)
register(
    "latest_per_key",
    lambda s, d: flat(latest_per_key(read(s, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")),
    """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)


def _history(s, d):
    tables = {"orders": read(s, d, "orders"), "events": read(s, d, "events"), "customers": read(s, d, "customer")}
    return flat(run_history(
        tables, {"orders": "o_orderdate", "events": "ts", "customers": "c_custkey"},
        {"orders": "o_orderkey", "events": "event_id", "customers": "c_custkey"},
    ))


def _kind(kind: str, table: str, at: str, key: str) -> str:
    return f"""SELECT '{kind}' AS kind, 'count' AS entry, 0::BIGINT AS rank, count(*)::VARCHAR AS value FROM {table}
      UNION ALL SELECT '{kind}', 'recent', rn, {key}::VARCHAR FROM (SELECT {key}, row_number() OVER (ORDER BY {at} DESC, {key} DESC) AS rn FROM {table}) WHERE rn <= 5"""


register(
    "run_history", _history,
    " UNION ALL ".join((_kind("orders", "orders", "o_orderdate", "o_orderkey"), _kind("events", "events", "ts", "event_id"), _kind("customers", "customer", "c_custkey", "c_custkey"))),
)


def _by_name(s, d):
    """A folder of plain files whose headers order the same names differently."""
    orders, path = read(s, d, "orders"), scratch_path(s, "named")
    even, odd = orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1")
    even.select("o_orderkey", "o_custkey", "o_orderstatus").write.options(header=True).csv(path)
    odd.select("o_orderstatus", "o_orderkey", "o_custkey").write.options(header=True).mode("append").csv(path)
    return flat(read_csv(s, path, row_order=False))


register("csv_by_name", _by_name, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")


def _newest(s, d):
    events = read(s, d, "events").withColumn("at", F.struct("ts", "event_id"))
    newest = newest_first(events, "at", 25).select("event_id", F.row_number().over(Window.orderBy(F.desc("at"))).alias("place"))
    return flat(newest)


register(
    "newest_first", _newest,
    "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
)


def _bad_inputs(s, d):
    """One row for each unusable input, with the kind of its error."""
    path = scratch_path(s, "bad")
    read(s, d, "region").select("r_regionkey").write.options(header=True).csv(path)
    read(s, d, "region").select("r_name").write.options(header=True).mode("append").csv(path)
    rows = []
    for what, where in (("other columns", path), ("no such path", f"{path}-none")):
        try:
            read_csv(s, where)
        except CsvError:
            rows.append((what, "refused"))
    return s.createDataFrame(rows, "input string, outcome string").join(read(s, d, "region").agg(F.count("*").alias("rows_in")))


register(
    "csv_bad_inputs", _bad_inputs,
    "SELECT input, 'refused' AS outcome, (SELECT count(*) FROM region) AS rows_in FROM (VALUES ('other columns'), ('no such path')) t(input)",
)
