"""Queries over preprocessing steps: fitted on train, applied to train and test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep import FittedPipeline, Pipeline, Step, with_row_order
from tableprep.operators import charts, preview, profile
from tableprep.plans.quantiles import exact_quantiles
from workload import oracle_profile as O
from workload.registry import register
from workload.tables import PAIR, dirty_orders, flat, read, sql, text_orders, train_and_test

P = sql(*PAIR)


def applied(steps: list[Step], *columns: str, replay: bool = False, refit: bool = False):
    """Query: fit on train, apply to both sides. ``refit``: as a draft loaded from a config that was fitted on the test side."""
    def run(spark, folder):
        train, test = train_and_test(spark, folder)
        draft = Pipeline(steps, mode="train_test")
        if refit:
            draft = Pipeline.from_config(draft.fit(test).to_config())
        fitted, done = draft.fit_transform(train)
        if replay:
            fitted = FittedPipeline.from_config(fitted.to_config(), spark)
            done = fitted.transform(train)
        pick = lambda df, side: df.select(F.lit(side).alias("side"), *(columns or [c for c in df.columns if not c.startswith("__tp_")]))
        return flat(pick(done, "train").unionByName(pick(fitted.transform(test), "test")))
    return run


def step_query(name: str, operation: str, columns: list[str], params: dict, shown: list[str], select: str, ctes: str = "", source: str = "both_sides") -> None:
    register(
        name, applied([Step(operation, columns, params)], "o_orderkey", *shown),
        f"WITH {P}{',' + ctes if ctes else ''} SELECT side, o_orderkey, {select} FROM {source}",
    )


# --- columns and rows ---------------------------------------------------------------------------

BASE = "o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"
register(
    "drop_columns", applied([Step("drop_columns", ["o_custkey", "o_orderdate"])]),
    f"WITH {P} SELECT side, o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM both_sides",
)
register(
    "rename_columns", applied([Step("rename_columns", [], {"rename_map": {"o_totalprice": "price", "o_orderkey": "id"}})], "id", "price", "o_orderstatus"),
    f"WITH {P} SELECT side, o_orderkey AS id, round(o_totalprice, 6) AS price, o_orderstatus FROM both_sides",
)


def _order_of_columns(spark, folder):
    train, _ = train_and_test(spark, folder)
    done = Pipeline([Step("reorder_columns", [], {"column_order": ["o_orderpriority", "o_orderkey"]})]).fit_transform(train)[1]
    names = F.array(*[F.lit(c) for c in done.columns if not c.startswith("__tp_")])
    return flat(done.withColumn("columns", names).select("o_orderkey", "o_orderpriority", "columns"))


register(
    "reorder_columns", _order_of_columns,
    f"""WITH {P} SELECT o_orderkey, o_orderpriority, 'o_orderpriority|o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate' AS columns FROM train""",
)
SUBSET = ["o_custkey", "o_orderpriority"]
for keep, rule in (("first", "rn = 1"), ("last", "rl = 1"), ("none", "n = 1")):
    register(
        f"dedupe_{keep}", applied([Step("remove_duplicate_rows", [], {"subset": SUBSET, "keep": keep})], "o_orderkey", *SUBSET),
        f"""WITH {P}, ranked AS (SELECT *, row_number() OVER (PARTITION BY side, o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn,
          row_number() OVER (PARTITION BY side, o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rl,
          count(*) OVER (PARTITION BY side, o_custkey, o_orderpriority) AS n FROM both_sides)
          SELECT side, o_orderkey, o_custkey, o_orderpriority FROM ranked WHERE {rule}""",
    )


def _dedupe_whole(spark, folder):
    lines = read(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    return flat(Pipeline([Step("remove_duplicate_rows")]).fit_transform(lines)[1])


register("dedupe_whole_rows", _dedupe_whole, "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_linenumber::BIGINT AS l_linenumber FROM lineitem")


def _dedupe_texts(spark, folder):
    docs = with_row_order(read(spark, folder, "documents"), "doc_id")
    return flat(Pipeline([Step("remove_duplicate_rows", [], {"subset": ["text"]})]).fit_transform(docs)[1].select("doc_id", "lang"))


register(
    "dedupe_long_texts", _dedupe_texts,
    "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)

# --- missing values -----------------------------------------------------------------------------

step_query("placeholders_to_null", "replace_placeholder_values", ["o_orderpriority"], {}, ["o_orderpriority"],
           "CASE WHEN o_orderpriority IN ('N/A', 'NA', 'unknown', '?', '-') THEN NULL ELSE o_orderpriority END AS o_orderpriority")
step_query("placeholders_to_value", "replace_placeholder_values", ["o_orderpriority", "o_orderstatus"],
           {"placeholders": ["unknown", "X"], "replacement": "none"}, ["o_orderpriority", "o_orderstatus"],
           "CASE WHEN o_orderpriority = 'unknown' THEN 'none' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'X' THEN 'none' ELSE o_orderstatus END AS o_orderstatus")
for strategy, fill in (("mean", "(SELECT avg(o_totalprice) FROM train)"), ("median", "(SELECT quantile_cont(o_totalprice, 0.5) FROM train)"), ("constant", "-1")):
    step_query(f"impute_{strategy}", "numeric_imputation", ["o_totalprice"], {"strategy": strategy, "fill_value": -1}, ["o_totalprice"],
               f"round(coalesce(o_totalprice, {fill}), 6) AS o_totalprice")
step_query("impute_most_frequent", "categorical_imputation", ["o_orderpriority"], {}, ["o_orderpriority"],
           "coalesce(o_orderpriority, (SELECT o_orderpriority FROM train WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority")
step_query("impute_label", "categorical_imputation", ["o_orderpriority"], {"strategy": "constant"}, ["o_orderpriority"],
           "coalesce(o_orderpriority, '__MISSING__') AS o_orderpriority")
step_query("missing_indicator", "add_missing_indicator", ["o_totalprice", "o_orderpriority"], {},
           ["o_totalprice_was_missing", "o_orderpriority_was_missing"],
           "(o_totalprice IS NULL)::BIGINT AS o_totalprice_was_missing, (o_orderpriority IS NULL)::BIGINT AS o_orderpriority_was_missing")

# --- categories ---------------------------------------------------------------------------------

FREQUENT = """{n} AS (SELECT {c}::VARCHAR AS v FROM train WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) >= {t})"""
step_query("rare_grouping", "rare_category_grouping", ["o_orderpriority", "o_orderstatus"], {"min_frequency": 0.1}, ["o_orderpriority", "o_orderstatus"],
           """CASE WHEN o_orderpriority IS NULL OR o_orderpriority IN (SELECT v FROM fp) THEN o_orderpriority ELSE '__RARE__' END AS o_orderpriority,
           CASE WHEN o_orderstatus IS NULL OR o_orderstatus IN (SELECT v FROM fs) THEN o_orderstatus ELSE '__RARE__' END AS o_orderstatus""",
           FREQUENT.format(n="fp", c="o_orderpriority", t="(SELECT ceil(count(*) * 0.1) FROM train)") + ","
           + FREQUENT.format(n="fs", c="o_orderstatus", t="(SELECT ceil(count(*) * 0.1) FROM train)"))
step_query("rare_grouping_min_count", "rare_category_grouping", ["o_custkey"], {"min_count": 9, "rare_label": "other"}, ["o_custkey"],
           "CASE WHEN o_custkey::VARCHAR IN (SELECT v FROM fc) THEN o_custkey::VARCHAR ELSE 'other' END AS o_custkey",
           FREQUENT.format(n="fc", c="o_custkey", t="9"))
step_query("rare_grouping_with_missing", "rare_category_grouping", ["o_orderpriority"], {"min_frequency": 0.1, "include_missing": True}, ["o_orderpriority"],
           "CASE WHEN o_orderpriority IN (SELECT v FROM fp) THEN o_orderpriority ELSE '__RARE__' END AS o_orderpriority",
           FREQUENT.format(n="fp", c="o_orderpriority", t="(SELECT ceil(count(*) * 0.1) FROM train)"))
HOT = {"F": "F", "O": "O", "P": "P"}
step_query("one_hot", "one_hot_encoding", ["o_orderstatus"], {}, [f"o_orderstatus_{k}" for k in HOT],
           ", ".join(f"coalesce((o_orderstatus = '{v}')::BIGINT, 0) AS o_orderstatus_{k}" for k, v in HOT.items()))
PRIORITIES = {"_1_URGENT": "1-URGENT", "_2_HIGH": "2-HIGH"}
step_query("one_hot_limited", "one_hot_encoding", ["o_orderpriority"], {"drop_first": True, "max_categories": 3},
           ["o_orderpriority_1_URGENT", "o_orderpriority_2_HIGH"],
           ", ".join(f"coalesce((o_orderpriority = '{v}')::BIGINT, 0) AS o_orderpriority{k}" for k, v in PRIORITIES.items()))
step_query("ordinal_sorted", "ordinal_encoding", ["o_orderpriority", "o_orderstatus"], {}, ["o_orderpriority", "o_orderstatus"],
           "coalesce(a.code, -1) AS o_orderpriority, coalesce(b.code, -1) AS o_orderstatus",
           """cp AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM train WHERE o_orderpriority IS NOT NULL GROUP BY 1),
           cs AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM train WHERE o_orderstatus IS NOT NULL GROUP BY 1)""",
           "both_sides LEFT JOIN cp a ON a.v = o_orderpriority LEFT JOIN cs b ON b.v = o_orderstatus")
step_query("ordinal_many_values", "ordinal_encoding", ["o_custkey"], {"unknown_value": -7}, ["o_custkey"], "coalesce(a.code, -7) AS o_custkey",
           "cc AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS code FROM train GROUP BY 1)",
           "both_sides LEFT JOIN cc a ON a.v = o_custkey")
step_query("ordinal_given", "ordinal_encoding", ["o_orderstatus"], {"categories_order": {"o_orderstatus": ["P", "O"]}, "unknown_value": 9}, ["o_orderstatus"],
           "CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 9 END::BIGINT AS o_orderstatus")
step_query("frequency_share", "frequency_encoding", ["o_orderpriority"], {}, ["o_orderpriority"], "round(coalesce(r, 0), 6) AS o_orderpriority",
           "fr AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(o_orderpriority) FROM train) AS r FROM train GROUP BY 1)",
           "both_sides LEFT JOIN fr ON v = o_orderpriority")
step_query("frequency_counts", "frequency_encoding", ["o_custkey"], {"normalize": False, "unknown_value": -1}, ["o_custkey"],
           "coalesce(n, -1)::DOUBLE AS o_custkey", "fr AS (SELECT o_custkey AS v, count(*) AS n FROM train GROUP BY 1)",
           "both_sides LEFT JOIN fr ON v = o_custkey")

# --- numbers ------------------------------------------------------------------------------------

X = "o_totalprice"
step_query("scale_standard", "numeric_scaling", [X], {}, [X], f"round(({X} - m) / s, 6) AS {X}",
           f"st AS (SELECT avg({X}) AS m, stddev_pop({X}) AS s FROM train)", "both_sides, st")
step_query("scale_minmax", "numeric_scaling", [X], {"method": "minmax", "feature_range": [-1, 1]}, [X],
           f"round(({X} - lo) / (hi - lo) * 2 - 1, 6) AS {X}", f"st AS (SELECT min({X}) AS lo, max({X}) AS hi FROM train)", "both_sides, st")
step_query("scale_robust", "numeric_scaling", [X], {"method": "robust", "quantile_range": [10, 90]}, [X],
           f"round(({X} - lo) / (hi - lo), 6) AS {X}",
           f"st AS (SELECT quantile_cont({X}, 0.1) AS lo, quantile_cont({X}, 0.9) AS hi FROM train)", "both_sides, st")
step_query("clip_percentile", "outlier_clipping", [X], {"lower_percentile": 2.5, "upper_percentile": 97.5}, [X],
           f"CASE WHEN {X} IS NOT NULL THEN round(greatest(least({X}, hi), lo), 4) END AS {X}",
           f"st AS (SELECT quantile_cont({X}, 0.025) AS lo, quantile_cont({X}, 0.975) AS hi FROM train)", "both_sides, st")
step_query("clip_iqr", "outlier_clipping", [X], {"method": "iqr", "iqr_multiplier": 1.0}, [X],
           f"CASE WHEN {X} IS NOT NULL THEN round(greatest(least({X}, b + (b - a)), a - (b - a)), 4) END AS {X}",
           f"st AS (SELECT quantile_cont({X}, 0.25) AS a, quantile_cont({X}, 0.75) AS b FROM train)", "both_sides, st")
step_query("log_replace", "log_transform", [X], {"offset": 1}, [X], f"round(ln(1 + {X} + 1), 6) AS {X}")
step_query("log_new_column", "log_transform", [X], {"replace_original": False, "new_suffix": "_ln"}, [X, f"{X}_ln"],
           f"round({X}, 6) AS {X}, round(ln(1 + {X}), 6) AS {X}_ln")

# --- dates and texts ----------------------------------------------------------------------------

DATE_PARTS = """year({t}) AS {c}_year, month({t}) AS {c}_month, day({t}) AS {c}_day, isodow({t}) - 1 AS {c}_day_of_week,
  coalesce((isodow({t}) >= 6)::BIGINT, 0) AS {c}_is_weekend"""
PARTS = ["year", "month", "day", "day_of_week", "is_weekend"]
step_query("datetime_parts", "datetime_extract", ["o_orderdate"], {}, [f"o_orderdate_{p}" for p in PARTS],
           DATE_PARTS.format(t="o_orderdate", c="o_orderdate"))


def _text_dates(spark, folder):
    orders = text_orders(spark, folder).select("o_orderkey", "date_text", F.date_format(F.to_date(F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd"))), "d.M.yyyy 'at' H").alias("other"), "__tp_row")
    steps = [Step("datetime_extract", ["date_text"]), Step("datetime_extract", ["other"], {"date_format": "%d.%m.%Y at %H", "features": ["day", "is_weekend"], "drop_original": False})]
    return flat(Pipeline(steps).fit_transform(orders)[1])


register(
    "datetime_from_text", _text_dates,
    f"""WITH {sql('text_orders')} SELECT o_orderkey, strftime(t, '%-d.%-m.%Y at 0') AS other, {DATE_PARTS.format(t='t', c='date_text')}, day(t) AS other_day,
      coalesce((isodow(t) >= 6)::BIGINT, 0) AS other_is_weekend FROM (SELECT o_orderkey, try_strptime(date_text, '%Y-%m-%d') AS t FROM text_orders)""",
)


def _text_features(spark, folder):
    docs = with_row_order(read(spark, folder, "documents"), "doc_id")
    steps = [Step("text_basic_features", ["text"], {"lowercase": True}), Step("text_basic_features", ["source"], {"drop_original": True, "strip_whitespace": False, "create_word_count_feature": False})]
    done = Pipeline(steps).fit_transform(docs)[1]
    return flat(done.select("doc_id", F.md5("text").alias("text"), "text_length", "text_word_count", "source_length"))


register(
    "text_features", _text_features,
    f"""SELECT doc_id, md5(lower({O.strip('text')})) AS text, length({O.strip('text')}) AS text_length, {O.words('text')} AS text_word_count,
      length(source) AS source_length FROM documents""",
)

# --- whole pipelines ----------------------------------------------------------------------------

STEPS = [
    Step("replace_placeholder_values", ["o_orderpriority"], {"placeholders": ["unknown", " ? "]}, order_index=0),
    Step("numeric_imputation", [X], {"strategy": "median"}, order_index=1),
    Step("categorical_imputation", ["o_orderpriority"], {"strategy": "constant"}, order_index=2),
    Step("outlier_clipping", [X], {"method": "iqr"}, order_index=3),
    Step("drop_columns", ["o_custkey"], enabled=False, order_index=4),
    Step("one_hot_encoding", ["o_orderstatus"], order_index=5),
    Step("ordinal_encoding", ["o_orderpriority"], order_index=6),
    Step("numeric_scaling", [X], order_index=7),
    Step("datetime_extract", ["o_orderdate"], {"features": ["year"]}, order_index=8),
    Step("drop_columns", ["o_custkey"], order_index=9),
]


def steps_sql(fit: str, source: str, side: str = "side, ") -> tuple[str, str]:
    """CTEs and select list of STEPS fitted on ``fit`` and applied to ``source``."""
    clean = "CASE WHEN o_orderpriority IN ('unknown', ' ? ') THEN NULL ELSE o_orderpriority END"
    ctes = f"""
s0 AS (SELECT quantile_cont({X}, 0.5) AS med FROM {fit}),
s1 AS (SELECT coalesce({X}, med) AS x FROM {fit}, s0),
s2 AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM s1),
s3 AS (SELECT greatest(least(x, b + 1.5 * (b - a)), a - 1.5 * (b - a)) AS x FROM s1, s2),
s4 AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM s3),
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({clean}, '__MISSING__') AS v FROM {fit})),
done AS (SELECT {side}o_orderkey,
    round((greatest(least(coalesce({X}, med), b + 1.5 * (b - a)), a - 1.5 * (b - a)) - m) / s, 6) AS {X},
    coalesce(code, -1) AS o_orderpriority, {", ".join(f"coalesce((o_orderstatus = '{k}')::BIGINT, 0) AS o_orderstatus_{k}" for k in HOT)},
    year(o_orderdate) AS o_orderdate_year
  FROM {source}, s0, s2, s4 LEFT JOIN codes ON v = coalesce({clean}, '__MISSING__'))"""
    return ctes, "SELECT * FROM done"


def _single(spark, folder):
    return flat(Pipeline(STEPS).fit_transform(dirty_orders(spark, folder))[1])


D = sql("dirty_orders")
ctes, tail = steps_sql("dirty_orders", "dirty_orders", "")
register("apply_single", _single, f"WITH {D},{ctes} {tail}")
SINGLE = (ctes, tail)
ctes, tail = steps_sql("train", "both_sides")
register("apply_train_test", applied(STEPS), f"WITH {P},{ctes} {tail}")
register("config_replay", applied(STEPS, replay=True), f"WITH {P},{ctes} {tail}")
register("config_refit", applied(STEPS, refit=True), f"WITH {P},{ctes} {tail}")


def _effects(spark, folder):
    df = dirty_orders(spark, folder)
    steps = [*STEPS[:4], Step("remove_duplicate_rows", [], {"subset": ["o_custkey"]}, order_index=4)]
    found = Pipeline(steps).fit(df).effects(df)
    return flat(found.select("step_order", "operation_type", "summary", "rows_before", "rows_after", "columns_before", "columns_after",
                             "cells_replaced", "values_clipped", "missing_before", "missing_after"))


register(
    "step_effects", _effects,
    f"""WITH {D},{SINGLE[0]},
    facts AS (SELECT count(*) AS n, count(CASE WHEN o_orderpriority IN ('unknown', ' ? ') THEN 1 END) AS replaced,
      count(*) - count({X}) AS gaps, count(CASE WHEN o_orderpriority IS NULL OR o_orderpriority IN ('unknown', ' ? ') THEN 1 END) AS holes,
      count(DISTINCT o_custkey) AS kept FROM dirty_orders),
    cut AS (SELECT count(*) AS clipped FROM s1, s2 WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a))
    SELECT 0::BIGINT AS step_order, 'replace_placeholder_values' AS operation_type, 'Replaced ' || replaced || ' placeholder values.' AS summary, n AS rows_before, n AS rows_after,
      6::BIGINT AS columns_before, 6::BIGINT AS columns_after, replaced AS cells_replaced, 0::BIGINT AS values_clipped, '' AS missing_before, '' AS missing_after FROM facts
    UNION ALL SELECT 1, 'numeric_imputation', 'Filled numeric missing values using median.', n, n, 6, 6, 0, 0, '{X}=' || gaps, '{X}=0' FROM facts
    UNION ALL SELECT 2, 'categorical_imputation', 'Filled categorical missing values using constant.', n, n, 6, 6, 0, 0, 'o_orderpriority=' || holes, 'o_orderpriority=0' FROM facts
    UNION ALL SELECT 3, 'outlier_clipping', 'Clipped ' || clipped || ' values.', n, n, 6, 6, 0, clipped, '', '' FROM facts, cut
    UNION ALL SELECT 4, 'remove_duplicate_rows', 'Removed ' || (n - kept) || ' duplicate rows.', n, kept, 6, 6, 0, 0, '', '' FROM facts""",
)
SHORT = [STEPS[0], STEPS[1], Step("add_missing_indicator", ["o_orderpriority"], order_index=2), Step("drop_columns", ["o_custkey"], order_index=3)]


def _diffs(spark, folder):
    df = dirty_orders(spark, folder)
    return flat(preview.column_diffs(df, Pipeline(SHORT).fit(df)))


register(
    "column_diffs", _diffs,
    f"""WITH {D}, facts AS (SELECT count(*) AS n, count(*) - count({X}) AS gaps, count(*) - count(o_orderpriority) AS blank,
      count(CASE WHEN o_orderpriority IS NULL OR o_orderpriority IN ('unknown', ' ? ') THEN 1 END) AS holes FROM dirty_orders),
    head AS (SELECT count(CASE WHEN {X} IS NULL THEN 1 END) AS xs, count(CASE WHEN o_orderpriority IN ('unknown', ' ? ') THEN 1 END) AS ps
      FROM (SELECT * FROM dirty_orders ORDER BY o_orderkey LIMIT 1000))
    SELECT '{X}' AS column_name, 'changed' AS status, gaps AS before_missing_count, 0::BIGINT AS after_missing_count, n - gaps AS before_non_null_count,
      n AS after_non_null_count, xs AS changed_sample_count, 'double' AS before_dtype, 'double' AS after_dtype FROM facts, head
    UNION ALL SELECT 'o_orderpriority', 'changed', blank, holes, n - blank, n - holes, ps, 'string', 'string' FROM facts, head
    UNION ALL SELECT 'o_orderpriority_was_missing', 'added', NULL, 0, NULL, n, NULL, NULL, 'int' FROM facts
    UNION ALL SELECT 'o_custkey', 'removed', 0, NULL, n, NULL, NULL, 'bigint', NULL FROM facts
    UNION ALL SELECT 'o_orderkey', 'unchanged', 0, 0, n, n, 0, 'bigint', 'bigint' FROM facts
    UNION ALL SELECT 'o_orderstatus', 'unchanged', 0, 0, n, n, 0, 'string', 'string' FROM facts
    UNION ALL SELECT 'o_orderdate', 'unchanged', 0, 0, n, n, 0, 'timestamp_ntz', 'timestamp_ntz' FROM facts""",
)


def _samples(spark, folder):
    df = dirty_orders(spark, folder)
    after = Pipeline(SHORT).fit_transform(df)[1]
    rows = lambda t, when: preview.sample_rows(t, 7).select(F.lit(when).alias("moment"), "o_orderkey", X, "o_orderpriority")
    return flat(rows(df, "before").unionByName(rows(after, "after")))


register(
    "sample_rows", _samples,
    f"""WITH {D}, med AS (SELECT quantile_cont({X}, 0.5) AS m FROM dirty_orders), h AS (SELECT * FROM dirty_orders ORDER BY o_orderkey LIMIT 7)
    SELECT 'before' AS moment, o_orderkey, round({X}, 6) AS {X}, o_orderpriority FROM h
    UNION ALL SELECT 'after', o_orderkey, round(coalesce({X}, m), 6), CASE WHEN o_orderpriority IN ('unknown', ' ? ') THEN NULL ELSE o_orderpriority END FROM h, med""",
)
STATUS = ("o_orderstatus", "classification")


def _shape(table: str) -> str:
    return f"""(SELECT count(*) AS n, (count(*) - count({X})) + (count(*) - count(o_orderpriority)) AS gaps FROM {table})"""


AFTER_SINGLE = f"""after_t AS (SELECT o_orderkey, o_orderstatus, coalesce({X}, (SELECT quantile_cont({X}, 0.5) FROM @)) AS {X}, o_orderdate,
    CASE WHEN o_orderpriority IN ('unknown', ' ? ') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    (o_orderpriority IS NULL OR o_orderpriority IN ('unknown', ' ? '))::BIGINT AS o_orderpriority_was_missing FROM #)"""
O.COLUMNS["after_t"] = [("o_orderkey", "long"), ("o_orderstatus", "text"), (X, "double"), ("o_orderdate", "time"), ("o_orderpriority", "text"), ("o_orderpriority_was_missing", "long")]


def _score(src: str, p: str) -> str:
    return (f"(SELECT greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 12 WHEN 'warning' THEN 5 ELSE 1.5 END))::DOUBLE AS score, count(*) AS found "
            f"FROM ({O.all_issues(src, *STATUS, p=p)}))")


register(
    "preview_single_summary",
    lambda s, d: flat(preview.preview_single(dirty_orders(s, d), SHORT, *STATUS, limit=5).summaries),
    f"""WITH {D},{AFTER_SINGLE.replace('@', 'dirty_orders').replace('#', 'dirty_orders')},{O.profile('dirty_orders', STATUS[0], out='p0')},{O.profile('after_t', STATUS[0], out='p1')}
    SELECT 'before' AS moment, 'single' AS dataset_role, n AS row_count, 6::BIGINT AS column_count, gaps AS missing_cells, round(gaps / (n * 6), 6) AS missing_rate,
      score AS readiness_score, found AS issue_count FROM {_shape('dirty_orders')}, {_score('dirty_orders', 'p0')}
    UNION ALL SELECT 'after', 'single', n, 6, gaps, round(gaps / (n * 6), 6), score, found FROM {_shape('after_t')}, {_score('after_t', 'p1')}""",
)


def _pair_preview(s, d):
    return flat(preview.preview_train_test(*train_and_test(s, d), SHORT, *STATUS, limit=5).summaries)


register(
    "preview_train_test_summary", _pair_preview,
    f"""WITH {P},{AFTER_SINGLE.replace('@', 'train').replace('#', 'train')},{AFTER_SINGLE.replace('after_t', 'after_s').replace('@', 'train').replace('#', 'test')},{O.profile('after_t', STATUS[0], out='p1')}
    SELECT 'before' AS moment, 'train' AS dataset_role, n AS row_count, 6::BIGINT AS column_count, gaps AS missing_cells, round(gaps / (n * 6), 6) AS missing_rate,
      NULL::DOUBLE AS readiness_score, NULL::BIGINT AS issue_count FROM {_shape('train')}
    UNION ALL SELECT 'before', 'test', n, 6, gaps, round(gaps / (n * 6), 6), NULL, NULL FROM {_shape('test')}
    UNION ALL SELECT 'after', 'train', n, 6, gaps, round(gaps / (n * 6), 6), score, found FROM {_shape('after_t')}, {_score('after_t', 'p1')}
    UNION ALL SELECT 'after', 'test', n, 6, gaps, round(gaps / (n * 6), 6), NULL, NULL FROM {_shape('after_s')}""",
)


def _shape_chart(s, d):
    df = dirty_orders(s, d)
    after = Pipeline(SHORT).fit_transform(df)[1]
    return flat(charts.shape_change(profile.table_summary(df), profile.table_summary(after)), 4)


register(
    "chart_shape_change", _shape_chart,
    f"""WITH {D},{AFTER_SINGLE.replace('@', 'dirty_orders').replace('#', 'dirty_orders')},
    m AS (SELECT 'before' AS moment, n, gaps FROM {_shape('dirty_orders')} UNION ALL SELECT 'after', n, gaps FROM {_shape('after_t')})
    SELECT moment, 'rows' AS measure, n::DOUBLE AS value FROM m UNION ALL SELECT moment, 'columns', 6.0 FROM m
    UNION ALL SELECT moment, 'missing_rate', round(gaps / (n * 6), 4) FROM m""",
)


# --- large maps, many date shapes, bracketed quantiles --------------------------------------------

step_query("one_hot_index", "one_hot_encoding", ["o_custkey"], {"output": "index", "drop_first": True}, ["o_custkey_index"],
           "CASE WHEN a.code > 0 THEN a.code - 1 END AS o_custkey_index",
           "cc AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS code FROM train GROUP BY 1)",
           "both_sides LEFT JOIN cc a ON a.v = o_custkey")
register(
    "config_replay_many_values", applied([Step("frequency_encoding", ["o_custkey"], {"normalize": False})], "o_orderkey", "o_custkey", replay=True),
    f"""WITH {P}, fr AS (SELECT o_custkey AS v, count(*) AS r FROM train GROUP BY 1)
    SELECT side, o_orderkey, coalesce(r, 0)::DOUBLE AS o_custkey FROM both_sides LEFT JOIN fr ON v = o_custkey""",
)

# 90 % of the rows hold one value of the train table, 9 % one that it lacks.
SKEWED = """CASE WHEN (7 * l_orderkey + l_linenumber) % 100 < 90 THEN (SELECT min(l_partkey) FROM lineitem)
    WHEN (7 * l_orderkey + l_linenumber) % 100 < 99 THEN -5 ELSE l_partkey END"""


def _skewed(spark, folder):
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    least, place = lines.agg(F.min("l_partkey")).first()[0], (7 * F.col("l_orderkey") + F.col("l_linenumber")) % 100
    part = F.when(place < 90, F.lit(least)).when(place < 99, F.lit(-5)).otherwise(F.col("l_partkey"))
    fitted = Pipeline([Step("frequency_encoding", ["l_partkey"], {"normalize": False})]).fit(lines)
    return flat(fitted.transform(lines.withColumn("l_partkey", part)))


register(
    "frequency_skewed_rows", _skewed,
    f"""WITH fr AS (SELECT l_partkey AS v, count(*) AS r FROM lineitem GROUP BY 1), skewed AS (SELECT l_orderkey, l_linenumber, {SKEWED} AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(r, 0)::DOUBLE AS l_partkey FROM skewed LEFT JOIN fr ON v = k""",
)

SHAPES = {
    "zoned": ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", True), "half_day": ("MM/dd/yyyy hh:mm a", True), "named": ("MMM d yyyy", True),
    "month_only": ("yyyy-MM", False), "short_year": ("MM/dd/yy", True), "utc": ("yyyy-MM-dd HH:mm:ss'Z'", True),
}


def _shaped(spark, folder):
    orders = read(spark, folder, "orders")
    return with_row_order(orders.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(n) for n, (f, _) in SHAPES.items()]), "o_orderkey")


def _date_parts(spark, folder):
    step = Step("datetime_extract", list(SHAPES), {"features": ["year", "month", "day"]})
    return flat(Pipeline([step]).fit_transform(_shaped(spark, folder))[1])


register(
    "datetime_shapes", _date_parts,
    "SELECT o_orderkey, " + ", ".join(
        f"year(o_orderdate) AS {n}_year, month(o_orderdate) AS {n}_month, {'day(o_orderdate)' if day else '1::BIGINT'} AS {n}_day"
        for n, (_, day) in SHAPES.items()
    ) + " FROM orders",
)
register(
    "datetime_shape_types", lambda s, d: flat(profile.profile_table(_shaped(s, d).drop("o_orderkey")).select("column_name", "inferred_type")),
    "SELECT column_name, 'datetime' AS inferred_type, FROM (VALUES " + ", ".join(f"('{n}')" for n in SHAPES) + ") t(column_name)",
)


# Renderings that no fixed shape reads: (format, whether it has a day of its own).
RENDERINGS = {
    "week_day": ("EEEE, MMMM d, yyyy", True), "mail": ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", True), "dotted_year": ("yyyy.MM.dd", True),
    "dotted_time": ("dd.MM.yyyy HH:mm:ss", True), "compact": ("yyyyMMdd'T'HHmmss", True), "year_day": ("yyyy-DDD", True), "short_month": ("MMM-yyyy", False),
    "long_month": ("MMMM yyyy", False), "day_short_year": ("d MMM yy", True), "year_name": ("yyyy MMM dd", True), "dashed": ("dd-MM-yy", True),
    "ordinal_dot": ("d. MMMM yyyy", True), "month_year": ("MM/yyyy", False), "slashed_time": ("yyyy/MM/dd HH:mm", True), "named_half": ("MMM d, yyyy h:mm a", True),
    "fraction": ("dd MMM yyyy HH:mm:ss.SSS", True), "ordinal_end": ("MMMM d'th', yyyy", True), "iso_half": ("yyyy-MM-dd h:mm a", True), "day_first": ("d-M-yyyy H:mm:ss", True),
    "two_digit_first": ("yy/MM/dd", True),
}


def _rendered(spark, folder):
    orders = read(spark, folder, "orders")
    return with_row_order(orders.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(n) for n, (f, _) in RENDERINGS.items()]), "o_orderkey")


register(
    "datetime_inferred",
    lambda s, d: flat(Pipeline([Step("datetime_extract", list(RENDERINGS), {"features": ["year", "month", "day"]})]).fit_transform(_rendered(s, d))[1]),
    "SELECT o_orderkey, " + ", ".join(
        f"year(o_orderdate) AS {n}_year, month(o_orderdate) AS {n}_month, {'day(o_orderdate)' if day else '1::BIGINT'} AS {n}_day"
        for n, (_, day) in RENDERINGS.items()
    ) + " FROM orders",
)
register(
    "datetime_inferred_profile",
    lambda s, d: flat(profile.profile_table(_rendered(s, d).drop("o_orderkey")).select("column_name", "inferred_type", "parse_success_rate", "min_date", "invalid_date_count")),
    " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, 'datetime' AS inferred_type, 1.0::DOUBLE AS parse_success_rate, 0::BIGINT AS invalid_date_count, "
        f"strftime({'min(o_orderdate)' if day else 'date_trunc($$month$$, min(o_orderdate))'}, '%Y-%m-%dT%H:%M:%S') AS min_date FROM orders"
        for n, (_, day) in RENDERINGS.items()
    ),
)


def _bracketed(spark, folder):
    """The path for tables of any size: sketch, proof of the rank, exact grouping of the bracket."""
    wanted = {"l_extendedprice": [0.01, 0.25, 0.5, 0.75, 0.99], "l_quantity": [0.1, 0.5, 0.9]}
    found = exact_quantiles(
        read(spark, folder, "lineitem"), {n: (F.col(n), q) for n, q in wanted.items()}, direct_rows=0, bracket_values=500, accuracy=100
    )
    rows = [(n, q, v) for n, qs in wanted.items() for q, v in zip(qs, found[n])]
    return flat(spark.createDataFrame(rows, "column_name string, q double, value double"))


register(
    "quantiles_bracketed", _bracketed,
    " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, {q}::DOUBLE AS q, round(quantile_cont({n}, {q}), 6) AS value FROM lineitem"
        for n, qs in (("l_extendedprice", (0.01, 0.25, 0.5, 0.75, 0.99)), ("l_quantity", (0.1, 0.5, 0.9))) for q in qs
    ),
)
