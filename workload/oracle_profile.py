"""SQL statements of profiles and issues, written out per column."""

from __future__ import annotations

from tableprep.functions.text import WHITESPACE
from workload.fixed import BOOLEAN_TEXTS, LEAKAGE_TERMS, MISSING_TOKENS

COLUMNS = {
    "dirty_orders": [
        ("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "text"), ("o_totalprice", "double"),
        ("o_orderdate", "time"), ("o_orderpriority", "text"),
    ],
    "doc_quality": [
        ("doc_id", "long"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "long"),
        ("quality", "long"), ("toxic", "long"),
    ],
    "text_orders": [
        ("o_orderkey", "long"), ("price_text", "text"), ("date_text", "text"), ("done", "text"), ("free_text", "text"),
    ],
    "coded_customers": [
        ("cust_key", "long"), ("zip_code", "long"), ("branch", "text"), ("segment", "text"), ("balance", "double"),
        ("label", "text"),
    ],
    "scored": [
        ("o_orderkey", "long"), ("label", "text"), ("final_result", "text"), ("constant", "text"),
        ("o_totalprice", "double"),
    ],
    "lineitem": [
        ("l_orderkey", "long"), ("l_partkey", "long"), ("l_suppkey", "long"), ("l_linenumber", "long"),
        ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time"),
    ],
    "flags": [("l_returnflag", "text"), ("l_linestatus", "text"), ("l_linenumber", "long")],
    "events": [
        ("event_id", "long"), ("ts", "time"), ("user_id", "long"), ("event_type", "text"), ("value", "double"),
        ("props", "text"),
    ],
}
COLUMNS["train"] = COLUMNS["test"] = COLUMNS["dirty_orders"]

SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"


def strip(c: str) -> str:
    return f"trim({c}, '{WHITESPACE}')"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACES}]+'))"


def listed(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def profile(src: str, target: str | None = None, problem_type: str = "unknown", role: str = "single", out: str = "prof") -> str:
    """CTEs ending in ``out``: one row per column with type, counts and summaries."""
    ctes, union = [], []
    for i, (c, kind) in enumerate(COLUMNS[src]):
        number = kind in ("long", "double")
        x = f"{c}::DOUBLE" if number else (f"CASE WHEN regexp_full_match({strip(c)}, '{NUMBER}') THEN try_cast({strip(c)} AS DOUBLE) END" if kind == "text" else "NULL::DOUBLE")
        text = kind == "text"
        ctes.append(f"""
{out}_b{i} AS (
  SELECT {i}::BIGINT AS ordinal, '{c}' AS column_name, '{kind}' AS storage, count(*) AS row_count,
    count(*) - count({c}) AS missing_count, count({c}) AS present, count(DISTINCT {c}) AS unique_count,
    {f"count(CASE WHEN lower({strip(c)}) IN {listed(BOOLEAN_TEXTS)} THEN 1 END)" if text else "0::BIGINT"} AS booleans,
    {f"count(CASE WHEN {strip(c)} IN {listed(MISSING_TOKENS)} THEN 1 END)" if text else "0::BIGINT"} AS placeholder_count,
    {f"coalesce(bool_or(regexp_matches({c}, '^0[0-9]+')), false)" if text else "false"} AS has_leading_zero,
    {f"count(CASE WHEN regexp_full_match({c}, '{ISO_DATE}') THEN try_strptime({c}, '%Y-%m-%d') END)" if text else "0::BIGINT"} AS dates,
    {f"coalesce(avg(length({c})), 0)" if text else "0::DOUBLE"} AS mean_length,
    count({x}) AS numbers, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max,
    quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3,
    count(CASE WHEN {x} = 0 THEN 1 END) AS zero_count, count(CASE WHEN {x} < 0 THEN 1 END) AS negative_count,
    skewness({x}) AS skew
  FROM {src}),
{out}_o{i} AS (
  SELECT count(*) AS outliers FROM (SELECT {x} AS x FROM {src}) s, {out}_b{i} b
  WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)),
{out}_v{i} AS (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1),
{out}_t{i} AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS r FROM {out}_v{i}),
{out}_s{i} AS (
  SELECT count(CASE WHEN n <= greatest(1, floor(total * 0.01)) THEN 1 END) AS rare, max(n) AS most, min(n) AS least,
    max(CASE WHEN r = 1 THEN v END) AS dominant, max(CASE WHEN r = uniq THEN v END) AS scarcest,
    string_agg(CASE WHEN r <= 10 THEN v || '=' || n END, '|' ORDER BY r) AS top
  FROM {out}_t{i}, (SELECT count(*) AS uniq, coalesce(sum(n), 0) AS total FROM {out}_v{i}) w)""")
        union.append(f"SELECT b.*, o.outliers, s.* FROM {out}_b{i} b, {out}_o{i} o, {out}_s{i} s")
    ctes.append(f"""
{out}_raw AS ({' UNION ALL '.join(union)}),
{out}_typed AS (
  SELECT *, '{role}' AS dataset_role, {'column_name = ' + repr(target) if target else 'false'} AS is_target,
    CASE
      WHEN storage = 'time' THEN 'datetime'
      WHEN storage <> 'text' AND NOT is_target AND unique_count <= least(10, greatest(2, floor(row_count * 0.05))) THEN 'categorical'
      WHEN storage <> 'text' THEN 'numeric'
      WHEN unique_count BETWEEN 1 AND 4 AND booleans = present THEN 'boolean'
      WHEN present > 0 AND numbers / present >= 0.9 THEN 'numeric'
      WHEN present > 0 AND dates / present >= 0.85 THEN 'datetime'
      WHEN mean_length >= 40 OR (mean_length >= 20 AND unique_count / row_count > 0.5) THEN 'text'
      ELSE 'categorical' END AS inferred_type
  FROM {out}_raw),
{out} AS (
  SELECT *, missing_count / greatest(row_count, 1) AS missing_rate, unique_count / greatest(row_count, 1) AS cardinality_ratio,
    CASE WHEN is_target AND '{problem_type}' = 'classification' THEN 'class'
      WHEN inferred_type = 'boolean' THEN 'categorical' ELSE inferred_type END AS summary_kind,
    CASE WHEN summary_kind = 'numeric' AND numbers > 0 THEN outliers / numbers END AS outlier_rate,
    CASE WHEN summary_kind = 'categorical' THEN coalesce(most, 0) / greatest(present, 1) END AS dominant_rate
  FROM {out}_typed)""")
    return ",".join(ctes)


def percent(x: str) -> str:
    return f"printf('%.1f%%', {x} * 100)"


def _issue(rule: int, part: int, severity: str, category: str, title: str, text: str, columns: str, actions: list[str], ordinal: str = "ordinal") -> str:
    return (
        f"({rule} * 100000000 + {part} + {ordinal} * 10)::BIGINT AS issue_id, {severity} AS severity, "
        f"'{category}' AS category, {title} AS title, {text} AS explanation, {columns} AS affected_columns, "
        f"'{'|'.join(actions)}' AS suggested_actions"
    )


def missingness(p: str = "prof") -> str:
    body = _issue(
        1, 0, "CASE WHEN missing_rate >= 0.5 THEN 'critical' WHEN missing_rate >= 0.1 THEN 'warning' ELSE 'info' END",
        "missingness", "'Missing values in ' || column_name", f"{percent('missing_rate')} || ' of values are missing.'",
        "column_name",
        ["impute missing values", "add missingness indicator", "drop column if missingness is too high"],
    )
    return f"SELECT {body} FROM {p} WHERE missing_rate > 0"


def constant(p: str = "prof") -> str:
    whole = _issue(2, 1, "'critical'", "constant", "'Constant column ' || column_name",
                   "'The column has one or zero unique non-missing values.'", "column_name", ["drop column"])
    near = _issue(2, 1, "'warning'", "constant", "'Near-constant column ' || column_name",
                  f"'The dominant value covers ' || {percent('dominant_rate')} || ' of non-missing rows.'", "column_name",
                  ["drop column", "keep only with domain justification"])
    return (f"SELECT {whole} FROM {p} WHERE unique_count <= 1 UNION ALL "
            f"SELECT {near} FROM {p} WHERE unique_count > 1 AND dominant_rate >= 0.95")


def cardinality(p: str = "prof") -> str:
    body = _issue(2, 2, "'warning'", "cardinality", "'High-cardinality categorical column ' || column_name",
                  "'The column has many unique categories relative to row count.'", "column_name",
                  ["group rare categories", "frequency encode", "drop ID-like column"])
    return f"SELECT {body} FROM {p} WHERE inferred_type = 'categorical' AND unique_count > 50 AND cardinality_ratio > 0.2"


def id_like(p: str = "prof") -> str:
    body = _issue(2, 3, "'warning'", "cardinality", "'Possible ID-like column ' || column_name",
                  "'The column is nearly unique per row.'", "column_name",
                  ["drop ID-like column", "keep only with domain justification"])
    return f"SELECT {body} FROM {p} WHERE cardinality_ratio > 0.9 AND unique_count > 10"


def outlier(p: str = "prof") -> str:
    text = f"'IQR rule flags ' || {percent('outlier_rate')} || ' of numeric values as outliers.'"
    many = _issue(2, 4, "'warning'", "outlier", "'Outliers detected in ' || column_name", text, "column_name",
                  ["percentile clipping", "IQR clipping", "log1p transform", "leave unchanged if meaningful"])
    some = _issue(2, 4, "'info'", "outlier", "'Some outliers in ' || column_name", text, "column_name",
                  ["inspect outliers", "clip if appropriate"])
    return (f"SELECT {many} FROM {p} WHERE outlier_rate >= 0.05 UNION ALL "
            f"SELECT {some} FROM {p} WHERE outlier_rate > 0 AND outlier_rate < 0.05")


def duplicates(src: str) -> str:
    names = ", ".join(c for c, _ in COLUMNS[src])
    body = _issue(3, 0, "CASE WHEN d / greatest(t, 1) >= 0.1 THEN 'critical' ELSE 'warning' END", "duplicate",
                  "'Duplicate rows detected'", "d || ' duplicate rows were found.'", "''",
                  ["remove duplicate rows", "inspect whether duplicates are legitimate repeated observations"], "0")
    return (f"SELECT {body} FROM (SELECT sum(n)::BIGINT AS t, sum(n - 1)::BIGINT AS d FROM "
            f"(SELECT count(*) AS n FROM {src} GROUP BY {names})) WHERE d > 0")


def placeholder(p: str = "prof") -> str:
    body = _issue(4, 0, "'warning'", "missingness", "'Placeholder values in ' || column_name",
                  "placeholder_count || ' placeholder strings may represent missing values.'", "column_name",
                  ["replace placeholder values with missing", "impute missing values"])
    return f"SELECT {body} FROM {p} WHERE placeholder_count > 0"


def leakage(target: str, p: str = "prof") -> str:
    body = _issue(5, 0, "'warning'", "leakage", "'Possible leakage feature ' || column_name",
                  "'The column name looks related to the target or final outcome.'", "column_name",
                  ["inspect feature timing", "drop leakage-prone feature"])
    terms = " OR ".join(f"contains(lower(column_name), '{t}')" for t in LEAKAGE_TERMS)
    return f"SELECT {body} FROM {p} WHERE column_name <> '{target}' AND ({terms})"


def imbalance(src: str, target: str) -> str:
    body = _issue(6, 0, "'warning'", "target", "'Imbalanced target'",
                  f"'The majority class covers ' || {percent('rate')} || ' of labeled rows.'", f"'{target}'",
                  ["review class distribution", "use stratified split", "consider class weighting during modeling"], "0")
    return (f"SELECT {body} FROM (SELECT max(n) / sum(n) AS rate FROM (SELECT count(*) AS n FROM {src} "
            f"WHERE {target} IS NOT NULL GROUP BY {target})) WHERE rate >= 0.9")


def all_issues(src: str, target: str | None = None, problem_type: str = "unknown", p: str = "prof") -> str:
    parts = [missingness(p), constant(p), cardinality(p), id_like(p), outlier(p), duplicates(src), placeholder(p)]
    if target:
        parts.append(leakage(target, p))
        if problem_type == "classification":
            parts.append(imbalance(src, target))
    return " UNION ALL ".join(parts)
