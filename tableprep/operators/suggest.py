"""Setup suggestions from one profile pass: missing tokens, overrides, ignored columns, target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import col, families, visible
from tableprep.functions.rules import CODE_HINTS, ID_HINTS, MISSING_TOKENS, TARGET_HINTS
from tableprep.functions.text import is_one_of, strip
from tableprep.operators.profile import profile_table


def apply_missing_tokens(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Null out text cells whose stripped text is one of the tokens; blank tokens are ignored."""
    words = sorted({str(t).strip() for t in tokens if str(t).strip()})
    texts = [n for n, kind in families(df).items() if kind == "text" and n in visible(df)]
    if not words or not texts:
        return df
    return df.withColumns({n: F.when(is_one_of(strip(col(n)), words), None).otherwise(col(n)) for n in texts})


def drop_ignored(df: DataFrame, ignored: list[str]) -> DataFrame:
    return df.drop(*[n for n in ignored if n in df.columns])


def suggest_missing_tokens(df: DataFrame) -> DataFrame:
    """Candidate tokens that occur as a whole cell in any text column, in list order."""
    texts = [n for n, kind in families(df).items() if kind == "text" and n in visible(df)]
    tidy = df.select(*[strip(col(n)).alias(f"t{i}") for i, n in enumerate(texts)])
    counts = [
        reduce(Column.__add__, [F.count(F.when(F.col(f"t{i}") == token, 1)) for i in range(len(texts))] or [F.lit(0)])
        for token in MISSING_TOKENS
    ]
    row = tidy.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)])
    pairs = [
        F.struct(F.lit(i).alias("rank"), F.lit(t).alias("token"), F.col(f"n{i}").cast("bigint").alias("cells"))
        for i, t in enumerate(MISSING_TOKENS)
    ]
    return row.select(F.inline(F.array(*pairs))).filter("cells > 0")


def _name() -> Column:
    return F.regexp_replace(F.lower(strip(F.col("column_name"))), " ", "_")


def _has_hint(hints: list[str]) -> Column:
    return reduce(Column.__or__, [_name().contains(h) for h in hints])


def _is_id_named() -> Column:
    return reduce(Column.__or__, [(_name() == h) | _name().endswith(f"_{h}") for h in ID_HINTS])


def _type_as_target() -> Column:
    """Type a column would have as the target: numbers are never taken for categories."""
    return F.when(F.col("storage").isin("long", "double", "decimal"), "numeric").otherwise(F.col("inferred_type"))


def suggest_type_overrides(profiles: DataFrame) -> DataFrame:
    """Columns safer as categories: code-like numbers, leading zeros, id-like names."""
    code = _has_hint(CODE_HINTS) & (F.col("inferred_type") == "numeric")
    ids = _is_id_named() & (F.col("cardinality_ratio") > 0.75)
    found = profiles.filter(code | F.col("has_leading_zero") | ids)
    return found.select("ordinal", "column_name", F.lit("categorical").alias("suggested_type"))


def suggest_ignored_columns(profiles: DataFrame) -> DataFrame:
    return profiles.filter(_is_id_named() & (F.col("cardinality_ratio") > 0.90)).select("ordinal", "column_name")


def _few_classes() -> Column:
    return F.col("unique_count") <= F.greatest(F.lit(20), F.floor(F.greatest("row_count", F.lit(1)) * 0.10))


def target_candidates(profiles: DataFrame) -> DataFrame:
    """Up to five likely targets with score and reasons."""
    last = F.max("ordinal").over(Window.partitionBy("dataset_role"))
    kind = _type_as_target()
    clues = [
        (_has_hint(TARGET_HINTS), 0.55, "name looks target-like"),
        (F.col("ordinal") == F.col("last"), 0.25, "last column"),
        (kind.isin("categorical", "boolean"), 0.20, "discrete values"),
        ((kind == "numeric") & _few_classes(), 0.12, "low-cardinality numeric values"),
        (_has_hint(ID_HINTS), -0.40, "identifier-like name"),
        (kind == "text", -0.25, "free-text column"),
    ]
    score = sum((F.when(test, F.lit(points)).otherwise(F.lit(0.0)) for test, points, _ in clues), F.lit(0.0))
    reason = F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(why)) for test, _, why in clues])), ", ")
    scored = profiles.withColumn("last", last).filter("unique_count > 1 AND cardinality_ratio <= 0.95")
    return (
        scored.select(
            "ordinal", "column_name", F.round(F.least(score, F.lit(1.0)), 4).alias("score"),
            kind.alias("inferred_type"), "unique_count", reason.alias("reason"),
        )
        .filter("score > 0")
        .orderBy(F.desc("score"), "ordinal")
        .limit(5)
    )


def problem_type(profiles: DataFrame, target: str | None) -> DataFrame:
    """Classification, regression or unknown for a target column."""
    kind = _type_as_target()
    decided = (
        F.when(kind.isin("categorical", "boolean") | ((kind == "numeric") & _few_classes()), "classification")
        .when(kind == "numeric", "regression")
        .otherwise("unknown")
    )
    row = profiles.filter(F.col("column_name") == F.lit(target)).agg(F.first(decided).alias("found"))
    return row.select(F.lit(target).cast("string").alias("target_column"), F.coalesce("found", F.lit("unknown")).alias("problem_type"))


def suggest_setup(df: DataFrame) -> DataFrame:
    """Target, problem type, tokens, overrides, ignored columns and notes, in one row."""
    profiles = profile_table(df)
    candidates = target_candidates(profiles).collect()
    columns = visible(df)
    target = candidates[0]["column_name"] if candidates else (columns[-1] if columns else None)
    tokens = [r["token"] for r in suggest_missing_tokens(df).orderBy("rank").collect()]
    overrides = [r["column_name"] for r in suggest_type_overrides(profiles).orderBy("ordinal").collect()]
    ignored = [r["column_name"] for r in suggest_ignored_columns(profiles).orderBy("ordinal").collect()]
    notes = [
        f"Recommended target: {target}." if target else None,
        "Detected placeholder strings that commonly represent missing values." if tokens else None,
        "Detected code-like columns that are safer as categorical values." if overrides else None,
        "Detected ID-like columns that are usually excluded from modeling." if ignored else None,
    ]
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return problem_type(profiles, target).select(
        F.col("target_column").alias("recommended_target_column"),
        F.col("problem_type").alias("recommended_problem_type"),
        texts([c["column_name"] for c in candidates]).alias("target_candidates"),
        texts(tokens).alias("missing_value_tokens"),
        texts(overrides).alias("categorical_overrides"),
        texts(ignored).alias("ignored_columns"),
        texts([n for n in notes if n]).alias("notes"),
    )
