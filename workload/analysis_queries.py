"""Queries over profiles, suggestions, issues, drift, recommendations and chart tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tableprep.functions.columns import nan_to_null
from tableprep.operators import charts, drift, issues, profile, recommend, suggest
from workload import fixed, oracle_profile as O
from workload.fixed import CODE_HINTS, ID_HINTS, MISSING_TOKENS, TARGET_HINTS
from workload.registry import register
from workload.tables import (
    PAIR, coded_customers, dirty_orders, doc_quality, flags, flat, read, scored, sql, text_orders, train_and_test,
)

ISSUE = ["issue_id", "severity", "category", "title", "explanation", "affected_columns", "suggested_actions"]
STATUS = ("o_orderstatus", "classification")


def _profile(table, *columns, target=None, problem_type="unknown", where=None):
    """Query: chosen columns of a table's profile."""
    def run(spark, folder):
        p = profile.profile_table(table(spark, folder), target=target, problem_type=problem_type)
        return flat((p.filter(where) if where else p).select(*columns))
    return run


def _issues(table, rule, target=None, problem_type="unknown"):
    def run(spark, folder):
        df = table(spark, folder)
        p = profile.profile_table(df, target=target, problem_type=problem_type)
        return flat(rule(df, p).select(*ISSUE))
    return run


def _with(src: str, tail: str, target=None, problem_type="unknown", tables=None) -> str:
    names = sql(*(tables or (src,))) + "," if src in O_TABLES else ""
    return f"WITH {names}{O.profile(src, target, problem_type)}{tail if tail.lstrip().startswith(',') else ' ' + tail}"


O_TABLES = {"dirty_orders", "doc_quality", "text_orders", "coded_customers", "flags", "scored"}
lineitem = lambda spark, folder: read(spark, folder, "lineitem")


# --- setup suggestions --------------------------------------------------------------------------

register(
    "missing_tokens_to_null",
    lambda s, d: flat(suggest.apply_missing_tokens(dirty_orders(s, d), ["?", "unknown", " ", "NA"]).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")),
    f"""WITH {sql('dirty_orders')} SELECT o_orderkey, o_orderstatus,
      CASE WHEN trim(o_orderpriority) IN ('?', 'unknown', 'NA') THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM dirty_orders""",
)
register(
    "drop_ignored",
    lambda s, d: flat(suggest.drop_ignored(dirty_orders(s, d), ["o_custkey", "absent", "o_orderdate"])),
    f"WITH {sql('dirty_orders')} SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM dirty_orders",
)
register(
    "suggest_missing_tokens",
    lambda s, d: flat(suggest.suggest_missing_tokens(dirty_orders(s, d))),
    f"WITH {sql('dirty_orders')} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT {i}::BIGINT AS rank, '{t}' AS token, (count(CASE WHEN {O.strip('o_orderstatus')} = '{t}' THEN 1 END)"
        f" + count(CASE WHEN {O.strip('o_orderpriority')} = '{t}' THEN 1 END))::BIGINT AS cells FROM dirty_orders) WHERE cells > 0"
        for i, t in enumerate(MISSING_TOKENS)
    ),
)
NAME = "replace(lower(trim(column_name)), ' ', '_')"
ID_NAMED = "(" + " OR ".join(f"{NAME} = '{h}' OR ends_with({NAME}, '_{h}')" for h in ID_HINTS) + ")"
has = lambda hints: "(" + " OR ".join(f"contains({NAME}, '{h}')" for h in hints) + ")"
AS_TARGET = "CASE WHEN storage IN ('long', 'double') THEN 'numeric' ELSE inferred_type END"
FEW = "unique_count <= greatest(20, floor(row_count * 0.10))"
OVERRIDES = f"(({has(CODE_HINTS)} AND inferred_type = 'numeric') OR has_leading_zero OR ({ID_NAMED} AND cardinality_ratio > 0.75))"
CANDIDATES = f"""
cand_raw AS (SELECT *, {AS_TARGET} AS kind, max(ordinal) OVER () AS last FROM prof WHERE unique_count > 1 AND cardinality_ratio <= 0.95
  OR ordinal = (SELECT max(ordinal) FROM prof)),
cand AS (SELECT ordinal, column_name, kind AS inferred_type, unique_count,
    round(least(1.0, (CASE WHEN {has(TARGET_HINTS)} THEN 0.55 ELSE 0 END)::DOUBLE + (CASE WHEN ordinal = last THEN 0.25 ELSE 0 END)
      + (CASE WHEN kind IN ('categorical', 'boolean') THEN 0.20 WHEN kind = 'numeric' AND {FEW} THEN 0.12 ELSE 0 END)
      - (CASE WHEN {has(ID_HINTS)} THEN 0.40 ELSE 0 END) - (CASE WHEN kind = 'text' THEN 0.25 ELSE 0 END)), 4)::DOUBLE AS score,
    concat_ws(', ', CASE WHEN {has(TARGET_HINTS)} THEN 'name looks target-like' END, CASE WHEN ordinal = last THEN 'last column' END,
      CASE WHEN kind IN ('categorical', 'boolean') THEN 'discrete values' END,
      CASE WHEN kind = 'numeric' AND {FEW} THEN 'low-cardinality numeric values' END,
      CASE WHEN {has(ID_HINTS)} THEN 'identifier-like name' END, CASE WHEN kind = 'text' THEN 'free-text column' END) AS reason
  FROM cand_raw WHERE unique_count > 1 AND cardinality_ratio <= 0.95),
best AS (SELECT * FROM cand WHERE score > 0 ORDER BY score DESC, ordinal LIMIT 5)"""
register(
    "suggest_type_overrides",
    lambda s, d: flat(suggest.suggest_type_overrides(profile.profile_table(coded_customers(s, d)))),
    _with("coded_customers", f"SELECT ordinal, column_name, 'categorical' AS suggested_type FROM prof WHERE {OVERRIDES}"),
)
register(
    "suggest_ignored",
    lambda s, d: flat(suggest.suggest_ignored_columns(profile.profile_table(coded_customers(s, d)))),
    _with("coded_customers", f"SELECT ordinal, column_name FROM prof WHERE {ID_NAMED} AND cardinality_ratio > 0.9"),
)
for source, table in (("coded_customers", coded_customers), ("dirty_orders", dirty_orders)):
    register(
        f"target_candidates_{source}",
        lambda s, d, table=table: flat(suggest.target_candidates(profile.profile_table(table(s, d)))),
        _with(source, "SELECT * FROM best").replace(" SELECT * FROM best", f",{CANDIDATES} SELECT * FROM best"),
    )
DECIDED = f"""CASE WHEN kind IN ('categorical', 'boolean') OR (kind = 'numeric' AND {FEW}) THEN 'classification'
  WHEN kind = 'numeric' THEN 'regression' ELSE 'unknown' END"""


def _problem_types(s, d):
    p = profile.profile_table(dirty_orders(s, d))
    out = suggest.problem_type(p, "o_orderstatus")
    for name in ("o_totalprice", "o_custkey", "o_orderdate"):
        out = out.unionByName(suggest.problem_type(p, name))
    return flat(out)


register(
    "problem_type", _problem_types,
    _with("dirty_orders", f"""SELECT column_name AS target_column, {DECIDED} AS problem_type FROM (SELECT *, {AS_TARGET} AS kind FROM prof)
      WHERE column_name IN ('o_orderstatus', 'o_totalprice', 'o_custkey', 'o_orderdate')"""),
)
register(
    "setup_suggestion",
    lambda s, d: flat(suggest.suggest_setup(coded_customers(s, d))),
    _with("coded_customers", "@").replace(" @", f""",{CANDIDATES},
    pick AS (SELECT column_name FROM best ORDER BY score DESC, ordinal LIMIT 1)
    SELECT (SELECT column_name FROM pick) AS recommended_target_column,
      (SELECT {DECIDED} FROM (SELECT *, {AS_TARGET} AS kind FROM prof) WHERE column_name = (SELECT column_name FROM pick)) AS recommended_problem_type,
      (SELECT string_agg(column_name, '|' ORDER BY score DESC, ordinal) FROM best) AS target_candidates,
      '' AS missing_value_tokens,
      coalesce((SELECT string_agg(column_name, '|' ORDER BY ordinal) FROM prof WHERE {OVERRIDES}), '') AS categorical_overrides,
      coalesce((SELECT string_agg(column_name, '|' ORDER BY ordinal) FROM prof WHERE {ID_NAMED} AND cardinality_ratio > 0.9), '') AS ignored_columns,
      'Recommended target: ' || (SELECT column_name FROM pick) || '.|Detected code-like columns that are safer as categorical values.|Detected ID-like columns that are usually excluded from modeling.' AS notes"""),
)

# --- profiles -----------------------------------------------------------------------------------

SAMPLE_COLUMNS = [c for c, _ in O.COLUMNS["dirty_orders"]]
SAMPLE_TEXT = {"o_totalprice": "o_totalprice::VARCHAR"}


def _samples(s, d):
    found = profile.sample_values(nan_to_null(dirty_orders(s, d)))
    return s.createDataFrame([(n, "|".join(v)) for n, v in found.items()], "column_name string, sample_values string")


register(
    "sample_values", _samples,
    f"WITH {sql('dirty_orders')} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, string_agg({c}::VARCHAR, '|' ORDER BY o_orderkey) AS sample_values FROM "
        f"(SELECT * FROM dirty_orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 5)" for c in SAMPLE_COLUMNS
    ),
)
register(
    "parse_rates", lambda s, d: flat(profile.parse_rates(text_orders(s, d))),
    _with("text_orders", """SELECT column_name, round(numbers / greatest(present, 1), 6) AS numeric_parse_rate,
      round(dates / greatest(present, 1), 6) AS datetime_parse_rate FROM prof WHERE storage = 'text'"""),
)
for source, table in (("dirty_orders", dirty_orders), ("text_orders", text_orders), ("doc_quality", doc_quality)):
    register(
        f"infer_types_{source}", _profile(table, "ordinal", "column_name", "inferred_type"),
        _with(source, "SELECT ordinal, column_name, inferred_type FROM prof"),
    )
register(
    "missing_profile", lambda s, d: flat(profile.missing_profile(doc_quality(s, d))),
    _with("doc_quality", "SELECT ordinal, column_name, missing_count, round(missing_rate, 6) AS missing_rate FROM prof"),
)
register(
    "cardinality_profile", lambda s, d: flat(profile.cardinality_profile(read(s, d, "lineitem"))),
    _with("lineitem", "SELECT ordinal, column_name, unique_count, round(cardinality_ratio, 6) AS cardinality_ratio FROM prof"),
)
NUMBERS = ["mean", "std", "min", "max", "median", "q1", "q3"]
NUMERIC_SQL = (
    "SELECT ordinal, column_name, numbers AS count, " + ", ".join(f"round({c}, 4) AS {c}" for c in NUMBERS)
    + """, round(q3 - q1, 4) AS iqr, zero_count, negative_count, round(coalesce(skew, 0), 4) AS skewness,
      outliers AS outlier_count_iqr, round(outlier_rate, 4) AS outlier_rate_iqr FROM prof WHERE inferred_type = 'numeric'"""
)
NUMERIC = ["ordinal", "column_name", "count", *NUMBERS, "iqr", "zero_count", "negative_count", "skewness",
           "outlier_count_iqr", "outlier_rate_iqr"]
for source, table in (("lineitem", lineitem), ("dirty_orders", dirty_orders), ("text_orders", text_orders)):
    def _numeric(s, d, table=table):
        p = profile.profile_table(table(s, d)).filter("inferred_type = 'numeric'")
        return flat(p.select(*NUMERIC), 4)
    register(f"numeric_summary_{source}", _numeric, _with(source, NUMERIC_SQL))
CATEGORY = ["column_name", "count", "top_values", "rare_value_count", "rare_value_rate", "dominant_value",
            "dominant_value_rate", "possible_id_column"]
register(
    "categorical_summary", _profile(dirty_orders, *CATEGORY, where="inferred_type = 'categorical'"),
    _with("dirty_orders", """SELECT column_name, present AS count, top AS top_values, rare AS rare_value_count,
      round(rare / unique_count, 6) AS rare_value_rate, dominant AS dominant_value, round(dominant_rate, 6) AS dominant_value_rate,
      cardinality_ratio > 0.9 AS possible_id_column FROM prof WHERE inferred_type = 'categorical'"""),
)
register(
    "datetime_summary",
    lambda s, d: flat(
        profile.profile_table(text_orders(s, d).select("date_text", "__tp_row")).unionByName(
            profile.profile_table(read(s, d, "events").select("ts"))
        ).select("column_name", "count", "parse_success_rate", "min_date", "max_date", "invalid_date_count")
    ),
    f"""WITH {sql('text_orders')}
      SELECT 'date_text' AS column_name, count(date_text) AS count, round(count(t) / count(date_text), 6) AS parse_success_rate,
        strftime(min(t), '%Y-%m-%dT%H:%M:%S') AS min_date, strftime(max(t), '%Y-%m-%dT%H:%M:%S') AS max_date,
        count(date_text) - count(t) AS invalid_date_count FROM (SELECT date_text, try_strptime(date_text, '%Y-%m-%d') AS t FROM text_orders)
      UNION ALL SELECT 'ts', count(ts), 1.0, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f'), strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f'), 0 FROM events""",
)
register(
    "text_summary",
    _profile(doc_quality, "column_name", "count", "average_length", "min_length", "max_length", "empty_string_count",
             "average_word_count", where="inferred_type = 'text'"),
    f"""WITH {sql('doc_quality')} SELECT 'text' AS column_name, count(text) AS count, round(avg(length(text)), 6) AS average_length,
      min(length(text)) AS min_length, max(length(text)) AS max_length, count(CASE WHEN {O.strip('text')} = '' THEN 1 END) AS empty_string_count,
      round(avg({O.words('text')}), 6) AS average_word_count FROM doc_quality""",
)
register(
    "class_summary",
    _profile(dirty_orders, "column_name", "count", "majority_class", "majority_class_rate", "minority_class",
             "minority_class_rate", target=STATUS[0], problem_type=STATUS[1], where="is_target"),
    _with("dirty_orders", """SELECT column_name, present AS count, dominant AS majority_class, round(most / present, 6) AS majority_class_rate,
      scarcest AS minority_class, round(least / present, 6) AS minority_class_rate FROM prof WHERE is_target""", *STATUS),
)
register(
    "class_counts", lambda s, d: flat(profile.class_balance(doc_quality(s, d), "quality")),
    f"WITH {sql('doc_quality')} SELECT quality::VARCHAR AS class, count(*) AS class_count FROM doc_quality WHERE quality IS NOT NULL GROUP BY 1",
)
WARNINGS = """concat_ws('|', CASE WHEN missing_count > 0 THEN 'contains_missing_values' END, CASE WHEN unique_count <= 1 THEN 'constant_or_empty' END)"""


def _warned(s, d):
    p = profile.profile_table(doc_quality(s, d), overrides={"n_chars": "categorical"})
    return flat(p.unionByName(profile.profile_table(scored(s, d))).select("column_name", "inferred_type", "warnings"))


register(
    "column_warnings", _warned,
    f"""WITH {sql('doc_quality', 'scored')},{O.profile('doc_quality', out='a')},{O.profile('scored', out='b')}
      SELECT column_name, CASE WHEN column_name = 'n_chars' THEN 'categorical' ELSE inferred_type END AS inferred_type,
        concat_ws('|', NULLIF({WARNINGS}, ''), CASE WHEN column_name = 'n_chars' THEN 'user_type_override' END) AS warnings FROM a
      UNION ALL SELECT column_name, inferred_type, {WARNINGS} FROM b""",
)
WHOLE = ["dataset_role", "ordinal", "column_name", "inferred_type", "row_count", "missing_count", "missing_rate",
         "unique_count", "cardinality_ratio", "warnings", "is_target", "placeholder_count"]
WHOLE_SQL = f"""SELECT dataset_role, ordinal, column_name, inferred_type, row_count, missing_count, round(missing_rate, 6) AS missing_rate,
  unique_count, round(cardinality_ratio, 6) AS cardinality_ratio, {WARNINGS} AS warnings, is_target, placeholder_count FROM prof"""
for source, table, target in (
    ("dirty_orders", dirty_orders, STATUS), ("doc_quality", doc_quality, ("quality", "classification")),
    ("lineitem", lineitem, (None, "unknown")),
):
    register(
        f"profile_table_{source}", _profile(table, *WHOLE, target=target[0], problem_type=target[1]),
        _with(source, WHOLE_SQL, *target),
    )
GAPS = " + ".join(f"(count(*) - count({c}))" for c, _ in O.COLUMNS["doc_quality"])
register(
    "table_summary", lambda s, d: flat(profile.table_summary(doc_quality(s, d))),
    f"""WITH {sql('doc_quality')} SELECT count(*) AS row_count, 7::BIGINT AS column_count, {GAPS} AS missing_cells,
      round(({GAPS}) / (count(*) * 7), 6) AS missing_rate, '{'|'.join(c for c, _ in O.COLUMNS['doc_quality'])}' AS columns FROM doc_quality""",
)


def _overview(s, d):
    df = dirty_orders(s, d)
    p = profile.profile_table(df, target=STATUS[0], problem_type=STATUS[1])
    return flat(profile.run_overview(p, issues.detect_issues(df, p, *STATUS)))


register(
    "overview", _overview,
    _with("dirty_orders", f""", iss AS ({O.all_issues('dirty_orders', *STATUS)})
      SELECT 'issues' AS kind, severity AS label, count(*) AS value FROM iss GROUP BY 2
      UNION ALL SELECT 'column_types', inferred_type, count(*) FROM prof GROUP BY 2
      UNION ALL SELECT 'target', 'single:' || column_name || ':' || inferred_type, present FROM prof WHERE is_target""", *STATUS),
)

# --- issues -------------------------------------------------------------------------------------

register("issues_missingness", _issues(doc_quality, lambda df, p: issues.missingness_issues(p)), _with("doc_quality", O.missingness()))
register("issues_constant", _issues(scored, lambda df, p: issues.constant_issues(p)), _with("scored", O.constant()))
register("issues_cardinality", _issues(lambda s, d: text_orders(s, d), lambda df, p: issues.cardinality_issues(p)), _with("text_orders", O.cardinality()))
register("issues_id_like", _issues(dirty_orders, lambda df, p: issues.id_like_issues(p)), _with("dirty_orders", O.id_like()))
register("issues_outlier", _issues(doc_quality, lambda df, p: issues.outlier_issues(p)), _with("doc_quality", O.outlier()))


def _high_cardinality(s, d):
    p = profile.profile_table(dirty_orders(s, d), overrides={"o_totalprice": "categorical", "o_custkey": "categorical"})
    return flat(issues.cardinality_issues(p).select(*ISSUE))


register(
    "issues_cardinality_override", _high_cardinality,
    _with("dirty_orders", O.cardinality("(SELECT * REPLACE (CASE WHEN column_name IN ('o_totalprice', 'o_custkey') THEN 'categorical' ELSE inferred_type END AS inferred_type) FROM prof)")),
)
register(
    "issues_duplicate",
    lambda s, d: flat(issues.duplicate_issues(flags(s, d)).select(*ISSUE).unionByName(
        issues.duplicate_issues(read(s, d, "documents").select("text")).select(*ISSUE))),
    f"WITH {sql('flags')}, only_text AS (SELECT text FROM documents) {O.duplicates('flags')} UNION ALL "
    + O.duplicates("flags").replace("flags GROUP BY l_returnflag, l_linestatus, l_linenumber", "only_text GROUP BY text"),
)
# The rule reads placeholder counts alone, so no other part of the profile is computed.
register(
    "issues_placeholder",
    lambda s, d: flat(issues.placeholder_issues(profile.placeholder_profile(dirty_orders(s, d))).select(*ISSUE)),
    _with("dirty_orders", O.placeholder()),
)
register("issues_leakage", _issues(scored, lambda df, p: issues.leakage_issues(p, "o_totalprice")), _with("scored", O.leakage("o_totalprice")))
register("issues_imbalance", _issues(scored, lambda df, p: issues.imbalance_issues(df, "label")), _with("scored", O.imbalance("scored", "label")))
LABEL = ("label", "classification")
for source, table, target in (("dirty_orders", dirty_orders, STATUS), ("scored", scored, LABEL), ("doc_quality", doc_quality, ("quality", "classification"))):
    register(
        f"issues_all_{source}",
        _issues(table, lambda df, p, target=target: issues.detect_issues(df, p, *target), *target),
        _with(source, O.all_issues(source, *target), *target),
    )
SCORE = """SELECT critical_count, warning_count, info_count, (12.0 * critical_count + 5.0 * warning_count + 1.5 * info_count)::DOUBLE AS penalty,
    greatest(0.0, 100.0 - 12.0 * critical_count - 5.0 * warning_count - 1.5 * info_count)::DOUBLE AS score,
    critical_count + warning_count + info_count AS issue_count,
    CASE WHEN score >= 85 THEN 'Ready' WHEN score >= 65 THEN 'Needs Review' ELSE 'High Risk' END AS band
  FROM (SELECT count(CASE WHEN severity = 'critical' THEN 1 END) AS critical_count, count(CASE WHEN severity = 'warning' THEN 1 END) AS warning_count,
    count(CASE WHEN severity = 'info' THEN 1 END) AS info_count FROM iss)"""
for source, table, target in (("dirty_orders", dirty_orders, STATUS), ("scored", scored, LABEL), ("doc_quality", doc_quality, ("quality", "classification"))):
    register(
        f"readiness_{source}",
        lambda s, d, table=table, target=target: flat(issues.readiness_for_table(table(s, d), *target)),
        _with(source, f", iss AS ({O.all_issues(source, *target)}) {SCORE}", target[0], "unknown"),
    )


def _listed(severity=None, category=None):
    """Issues of a table with all three severities, in the order in which they are listed."""
    def run(s, d):
        df = scored(s, d)
        p = profile.profile_table(df, target="label", problem_type="classification")
        found = issues.issue_list(issues.detect_issues(df, p, "label", "classification"), severity, category)
        rows = [(i + 1, r["severity"], r["category"], r["title"]) for i, r in enumerate(found.collect())]  # one row for each issue
        return s.createDataFrame(rows, "place bigint, severity string, category string, title string")
    return run


SCORED_ISSUES = f"""iss AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS importance FROM ({O.all_issues('scored', *LABEL)}))"""
for name, pick in (("issue_list", {}), ("issue_list_warnings", {"severity": "warning"}), ("issue_list_leakage", {"category": "leakage"})):
    chosen = " AND ".join(f"{k} = '{v}'" for k, v in pick.items()) or "true"
    register(
        name, _listed(**pick),
        _with("scored", f""", {SCORED_ISSUES} SELECT row_number() OVER (ORDER BY importance, category, title, issue_id) AS place, severity, category, title
          FROM iss WHERE {chosen}""", *LABEL),
    )

# --- drift --------------------------------------------------------------------------------------

P = sql(*PAIR)
NUM, CAT = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]


def _numeric_shift_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, 'compared' AS status, round(tm, 4) AS train_mean, round(sm, 4) AS test_mean, round(ts, 4) AS train_std,
      round(abs(sm - tm) / CASE WHEN ts > 0 THEN ts ELSE greatest(abs(tm), 1) END, 4) AS standardized_mean_diff,
      abs(sm - tm) / CASE WHEN ts > 0 THEN ts ELSE greatest(abs(tm), 1) END >= 1 AS drift_flag
      FROM (SELECT avg({c}) AS tm, stddev_samp({c}) AS ts FROM train) a, (SELECT avg({c}) AS sm FROM test) b"""


register(
    "numeric_shift", lambda s, d: flat(drift.numeric_shift(*train_and_test(s, d), NUM), 4),
    f"WITH {P} " + " UNION ALL ".join(_numeric_shift_sql(c) for c in NUM),
)


def _category_shift_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM train) AS train_unique, (SELECT count(DISTINCT {c}) FROM test) AS test_unique,
      coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT v FROM u_{c} ORDER BY v LIMIT 25)), '') AS unseen_categories,
      (SELECT count(*) FROM u_{c}) AS unseen_category_count,
      round((SELECT coalesce(sum(n), 0) FROM u_{c}) / (SELECT count({c}) FROM test), 6) AS unseen_row_rate, (SELECT count(*) > 0 FROM u_{c}) AS drift_flag"""


def _unseen(c: str) -> str:
    return f"u_{c} AS (SELECT {c}::VARCHAR AS v, count(*) AS n FROM test WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM train WHERE {c} IS NOT NULL) GROUP BY 1)"


SHIFTED = [*CAT, "o_orderkey"]
register(
    "category_shift", lambda s, d: flat(drift.category_shift(*train_and_test(s, d), SHIFTED)),
    f"WITH {P},{','.join(_unseen(c) for c in SHIFTED)} " + " UNION ALL ".join(_category_shift_sql(c) for c in SHIFTED),
)
TARGET_SHIFT = """
shares AS (SELECT coalesce(a.v, b.v) AS class, coalesce(a.r, 0) AS train_rate, coalesce(b.r, 0) AS test_rate FROM
  (SELECT o_orderstatus AS v, count(*) / (SELECT count(o_orderstatus) FROM train) AS r FROM train WHERE o_orderstatus IS NOT NULL GROUP BY 1) a
  FULL JOIN (SELECT o_orderstatus AS v, count(*) / (SELECT count(o_orderstatus) FROM test) AS r FROM test WHERE o_orderstatus IS NOT NULL GROUP BY 1) b ON a.v = b.v)"""
register(
    "target_distribution", lambda s, d: flat(drift.target_distribution(*train_and_test(s, d), "o_orderstatus")),
    f"WITH {P},{TARGET_SHIFT} SELECT class, round(train_rate, 6) AS train_rate, round(test_rate, 6) AS test_rate FROM shares",
)
register(
    "target_shift", lambda s, d: flat(drift.target_shift(*train_and_test(s, d), "o_orderstatus")),
    f"""WITH {P},{TARGET_SHIFT} SELECT round(max(abs(train_rate - test_rate)), 6) AS max_class_rate_delta,
      max(abs(train_rate - test_rate)) >= 0.2 AS drift_flag FROM shares""",
)
SAME_ROW = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c, _ in O.COLUMNS["train"])
OVERLAP = f"(SELECT count(*) FROM test b WHERE EXISTS (SELECT 1 FROM train a WHERE {SAME_ROW}))"
register(
    "row_overlap", lambda s, d: flat(drift.row_overlap(*train_and_test(s, d))),
    f"""WITH {P} SELECT {OVERLAP} AS overlap_count, round({OVERLAP} / (SELECT count(*) FROM test), 6) AS overlap_rate,
      (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows""",
)


def _compared(s, d):
    train, test = train_and_test(s, d)
    test = test.withColumnRenamed("o_orderdate", "o_day")
    return train, test, drift.compare_tables(train, test, profile.profile_table(train, "train", *STATUS), "o_orderstatus")


# Without the renamed date column five columns are common.
COMMON = [c for c, _ in O.COLUMNS["train"] if c != "o_orderdate"]
SAME_COMMON = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in COMMON)
COMPARED = f"""{P},{TARGET_SHIFT},{','.join(_unseen(c) for c in CAT)},
num AS ({' UNION ALL '.join(_numeric_shift_sql(c) for c in NUM)}),
cat AS ({_category_shift_sql('o_orderpriority')}),
facts AS (SELECT (SELECT count(*) FROM num WHERE drift_flag) + (SELECT count(*) FROM cat WHERE drift_flag) AS flagged,
  (SELECT max(abs(train_rate - test_rate)) FROM shares) AS delta, (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows,
  (SELECT count(*) FROM test b WHERE EXISTS (SELECT 1 FROM train a WHERE {SAME_COMMON})) AS overlap),
score AS (SELECT least(100.0, 100.0 * (flagged + (delta >= 0.2)::INT + (overlap > 0)::INT) / {len(COMMON)})::DOUBLE AS drift_score, * FROM facts)"""
SUMMARY = ["drift_score", "train_rows", "test_rows", "flagged_columns", "max_class_rate_delta", "overlap_count",
           "overlap_rate", "missing_columns_in_test", "extra_columns_in_test"]
register(
    "drift_score", lambda s, d: flat(_compared(s, d)[2].summary.select(*SUMMARY), 4),
    f"""WITH {COMPARED} SELECT round(drift_score, 4) AS drift_score, train_rows, test_rows, flagged AS flagged_columns, round(delta, 4) AS max_class_rate_delta,
      overlap AS overlap_count, round(overlap / test_rows, 4) AS overlap_rate, 'o_orderdate' AS missing_columns_in_test, 'o_day' AS extra_columns_in_test FROM score""",
)
register(
    "drift_overview",
    lambda s, d: flat(_compared(s, d)[2].summary.select(
        "drift_score", "train_rows", "test_rows", "train_columns", "test_columns", "flagged_columns",
        "insufficient_data_columns", "schema_issue_count"), 4),
    f"""WITH {COMPARED} SELECT round(drift_score, 4) AS drift_score, train_rows, test_rows, 6::BIGINT AS train_columns, 6::BIGINT AS test_columns,
      flagged AS flagged_columns, 0::BIGINT AS insufficient_data_columns, 2::BIGINT AS schema_issue_count FROM score""",
)
DRIFT_ISSUES = """
drift_issues AS (
  SELECT 700000000::BIGINT AS issue_id, 'warning' AS severity, 'split' AS category, 'Train/test column mismatch' AS title,
    'Train and test datasets do not have identical columns.' AS explanation, 'o_orderdate|o_day' AS affected_columns
  UNION ALL SELECT 800000000 + 10 * CASE column_name WHEN 'o_orderkey' THEN 0 WHEN 'o_custkey' THEN 1 ELSE 3 END, 'warning', 'drift',
    'Numeric drift in ' || column_name, 'The test mean differs substantially from the train mean.', column_name FROM num WHERE drift_flag
  UNION ALL SELECT 800000050, 'warning', 'drift', 'Unseen categories in ' || column_name,
    'The test set contains categories that do not appear in train.', column_name FROM cat WHERE drift_flag
  UNION ALL SELECT 900000000, 'warning', 'target', 'Train/test target distribution shift',
    'The target distribution differs between train and test.', 'o_orderstatus' FROM facts WHERE delta >= 0.2
  UNION ALL SELECT 1000000000, CASE WHEN overlap / test_rows >= 0.1 THEN 'critical' ELSE 'warning' END, 'split',
    'Duplicate row overlap across train/test', 'Some test rows also appear in train.', '' FROM facts WHERE overlap > 0)"""
register(
    "drift_issues",
    lambda s, d: flat(_compared(s, d)[2].issues.select("issue_id", "severity", "category", "title", "explanation", "affected_columns")),
    f"WITH {COMPARED},{DRIFT_ISSUES} SELECT * FROM drift_issues",
)
register(
    "chart_drift",
    lambda s, d: flat((lambda r: charts.drift_rows(r.columns, r.summary))(_compared(s, d)[2]), 4),
    f"""WITH {COMPARED} SELECT -1::BIGINT AS ordinal, 'overall_drift_score' AS label, round(drift_score, 4) AS value FROM score
      UNION ALL SELECT CASE column_name WHEN 'o_orderkey' THEN 0 WHEN 'o_custkey' THEN 1 ELSE 3 END, column_name, round(standardized_mean_diff, 4) FROM num
      UNION ALL SELECT 5, column_name, round(unseen_row_rate, 4) FROM cat""",
)

# --- recommendations ----------------------------------------------------------------------------


def _found(table, target):
    def run(s, d):
        df = table(s, d)
        p = profile.profile_table(df, target=target[0], problem_type=target[1])
        return issues.detect_issues(df, p, *target), p
    return run


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _mapped(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_text(k)} THEN {_text(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


STEP_PARAMS = {op: json.dumps(v, sort_keys=True) for op, v in fixed.PARAMS.items()}
STEPS = f"""
steps AS (SELECT *, {_mapped(STEP_PARAMS, 'operation_type')} AS params_json,
    CASE WHEN operation_type = 'drop_columns' THEN CASE WHEN category = 'cardinality' THEN {_text(fixed.DROP_ID_REASON)} ELSE {_text(fixed.DROP_REASON)} END
      ELSE {_mapped(fixed.REASONS, 'operation_type')} END AS reason
  FROM (SELECT iss.*, CASE WHEN category = 'duplicate' THEN 'remove_duplicate_rows'
      WHEN category = 'missingness' AND contains(title, 'Placeholder values') THEN 'replace_placeholder_values'
      WHEN category = 'missingness' AND inferred_type = 'numeric' THEN 'numeric_imputation'
      WHEN category = 'missingness' AND inferred_type IN ('categorical', 'boolean') THEN 'categorical_imputation'
      WHEN category = 'missingness' AND inferred_type = 'text' THEN 'text_basic_features'
      WHEN category = 'missingness' THEN 'add_missing_indicator'
      WHEN category = 'outlier' THEN 'outlier_clipping'
      WHEN category = 'cardinality' AND NOT contains(title, 'ID-like') THEN 'rare_category_grouping'
      WHEN category IN ('cardinality', 'constant', 'leakage') THEN 'drop_columns' END AS operation_type
    FROM iss LEFT JOIN prof ON prof.column_name = iss.affected_columns))"""
for source, table, target in (("dirty_orders", dirty_orders, STATUS), ("doc_quality", doc_quality, ("quality", "classification")), ("scored", scored, LABEL)):
    base = f", iss AS ({O.all_issues(source, *target)}),{STEPS}"
    register(
        f"suggested_steps_{source}",
        lambda s, d, f=_found(table, target): flat(recommend.suggested_steps(*f(s, d)).select("issue_id", "title", "operation_type", "params_json", "reason", "step_columns")),
        _with(source, f"{base} SELECT issue_id, title, operation_type, params_json, reason, affected_columns AS step_columns FROM steps", *target),
    )
    register(
        f"suggested_order_{source}",
        lambda s, d, f=_found(table, target): flat(recommend.suggested_pipeline(*f(s, d)).select("step_order", "operation_type", "params_json", "columns", "reason")),
        _with(source, f"""{base}, gone AS (SELECT DISTINCT affected_columns AS c FROM steps WHERE operation_type = 'drop_columns'),
          kept AS (SELECT operation_type, params_json, affected_columns AS c, min(issue_id) AS i, arg_min(reason, issue_id) AS reason FROM steps
            WHERE operation_type IS NOT NULL AND (operation_type IN ('drop_columns', 'remove_duplicate_rows') OR affected_columns NOT IN (SELECT c FROM gone)) GROUP BY 1, 2, 3)
          SELECT {_mapped(fixed.STEP_ORDER, 'operation_type')}::BIGINT AS step_order, operation_type, params_json,
            string_agg(c, '|' ORDER BY i) AS columns, arg_min(reason, i) AS reason FROM kept GROUP BY 1, 2, 3""", *target),
    )
    register(
        f"recommendations_{source}",
        lambda s, d, f=_found(table, target): flat(recommend.recommendations(*f(s, d)).select("priority", "category", "title", "rationale", "affected_columns", "issue_ids", "operation_type", "params_json")),
        _with(source, f"""{base},
          ranked AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 3 END AS pr FROM steps)
          SELECT CASE min(pr) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS priority, category,
            CASE WHEN operation_type = 'drop_columns' THEN {_mapped(fixed.DROP_TITLES, 'category')} ELSE {_mapped(fixed.TITLES, 'operation_type')} END AS title,
            arg_min(reason, issue_id) AS rationale, string_agg(affected_columns, '|' ORDER BY issue_id) AS affected_columns,
            string_agg(issue_id::VARCHAR, '|' ORDER BY issue_id) AS issue_ids, operation_type, params_json FROM ranked
          WHERE operation_type IS NOT NULL GROUP BY category, operation_type, params_json
          UNION ALL SELECT CASE severity WHEN 'critical' THEN 'critical' WHEN 'warning' THEN 'high' ELSE 'low' END, category, title,
            explanation || ' ' || {_text(fixed.ADVICE['target'])}, affected_columns, issue_id::VARCHAR, NULL, NULL
          FROM ranked WHERE operation_type IS NULL AND category = 'target'""", *target),
    )


def _advised(s, d):
    train, _, report = _compared(s, d)
    p = profile.profile_table(train, "train", *STATUS)
    return flat(recommend.advisories(report.issues, p).select("priority", "category", "title", "rationale", "affected_columns"))


register(
    "advisories", _advised,
    f"""WITH {COMPARED},{DRIFT_ISSUES} SELECT CASE WHEN category = 'drift' THEN 'medium' WHEN severity = 'critical' THEN 'critical' ELSE 'high' END AS priority,
      category, title, explanation || ' ' || {_mapped(fixed.ADVICE, 'category')} AS rationale, affected_columns FROM drift_issues""",
)

# --- chart and report tables --------------------------------------------------------------------


def _chart(pick):
    def run(s, d):
        df = dirty_orders(s, d)
        p = profile.profile_table(df, target=STATUS[0], problem_type=STATUS[1])
        return flat(pick(p, lambda: issues.detect_issues(df, p, *STATUS)))
    return run


ISS = f", iss AS ({O.all_issues('dirty_orders', *STATUS)})"
register("chart_issue_severity", _chart(lambda p, i: charts.issues_by_severity(i())), _with("dirty_orders", ISS + " SELECT severity AS label, count(*) AS value FROM iss GROUP BY 1", *STATUS))
register("chart_issue_category", _chart(lambda p, i: charts.issues_by_category(i())), _with("dirty_orders", ISS + " SELECT category AS label, count(*) AS value FROM iss GROUP BY 1", *STATUS))
register("chart_column_types", _chart(lambda p, i: charts.columns_by_type(p)), _with("dirty_orders", "SELECT inferred_type AS label, count(*) AS value FROM prof GROUP BY 1", *STATUS))
register("chart_missing_rates", _chart(lambda p, i: charts.missing_rates(p)), _with("dirty_orders", "SELECT column_name AS label, round(missing_rate, 4) AS value, dataset_role, ordinal FROM prof ORDER BY 2 DESC, ordinal LIMIT 30", *STATUS))
register("chart_cardinality", _chart(lambda p, i: charts.cardinality_ratios(p)), _with("dirty_orders", "SELECT column_name AS label, round(cardinality_ratio, 4) AS value, dataset_role, ordinal FROM prof ORDER BY 2 DESC, ordinal LIMIT 30", *STATUS))
register("chart_missing_present", _chart(lambda p, i: charts.missing_vs_present(p)), _with("dirty_orders", "SELECT ordinal, column_name, 'missing' AS label, missing_count AS value FROM prof UNION ALL SELECT ordinal, column_name, 'present', present FROM prof", *STATUS))
register(
    "chart_numeric_points", _chart(lambda p, i: charts.numeric_points(p)),
    _with("dirty_orders", " UNION ALL ".join(f"SELECT ordinal, column_name, '{m}' AS label, round({m}, 4) AS value FROM prof WHERE inferred_type = 'numeric'" for m in ("min", "q1", "median", "q3", "max", "mean")), *STATUS),
)
register(
    "chart_top_values", _chart(lambda p, i: charts.top_value_rows(p)),
    _with("dirty_orders", "SELECT 5::BIGINT AS ordinal, 'o_orderpriority' AS column_name, r AS rank, v AS label, n AS value FROM prof_t5 WHERE r <= 10", *STATUS),
)
register(
    "chart_class_balance",
    lambda s, d: flat(charts.class_balance_rows(profile.class_balance(dirty_orders(s, d), "o_orderstatus"))),
    f"WITH {sql('dirty_orders')} SELECT o_orderstatus AS label, count(*) AS value FROM dirty_orders GROUP BY 1",
)
register(
    "report_worst_missing",
    lambda s, d: flat(charts.worst_missing_columns(profile.profile_table(doc_quality(s, d))).select("column_name", "missing_rate", "missing_count")),
    _with("doc_quality", "SELECT column_name, round(missing_rate, 6) AS missing_rate, missing_count FROM prof ORDER BY missing_rate DESC, missing_count DESC, ordinal LIMIT 10"),
)
register(
    "report_highest_cardinality",
    lambda s, d: flat(charts.highest_cardinality_columns(profile.profile_table(read(s, d, "lineitem"))).select("column_name", "cardinality_ratio")),
    _with("lineitem", "SELECT column_name, round(cardinality_ratio, 6) AS cardinality_ratio FROM prof ORDER BY cardinality_ratio DESC, ordinal LIMIT 10"),
)


def _roles(s, d):
    train, test = train_and_test(s, d)
    both = profile.profile_table(train, "train").unionByName(profile.profile_table(test, "test"))
    return flat(charts.columns_by_role(both).select("label", "value").unionByName(
        charts.warning_rows(both).select(F.concat_ws(":", "dataset_role", "column_name", "warning").alias("label"), F.lit(1).cast("bigint").alias("value"))))


register(
    "report_roles_and_warnings", _roles,
    f"""WITH {P},{O.profile('train', role='train', out='a')},{O.profile('test', role='test', out='b')}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
      SELECT dataset_role AS label, count(*) AS value FROM u GROUP BY 1
      UNION ALL SELECT dataset_role || ':' || column_name || ':contains_missing_values', 1 FROM u WHERE missing_count > 0
      UNION ALL SELECT dataset_role || ':' || column_name || ':constant_or_empty', 1 FROM u WHERE unique_count <= 1""",
)
register(
    "report_first_issues", _chart(lambda p, i: charts.first_issues(i()).select("issue_id", "severity", "title")),
    _with("dirty_orders", ISS + " SELECT issue_id, severity, title FROM iss ORDER BY issue_id LIMIT 25", *STATUS),
)
