"""Column naming and type helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HIDDEN_PREFIX = "__tp_"
ROW_ORDER = "__tp_row"


class PrepError(ValueError):
    """A data-preparation request that cannot be carried out."""


def col(name: str) -> Column:
    """A column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def visible(df: DataFrame) -> list[str]:
    """Data columns of a frame: everything but the hidden helper columns."""
    return [name for name in df.columns if not name.startswith(HIDDEN_PREFIX)]


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise PrepError(f"Columns do not exist: {', '.join(missing)}")


def family_of(dtype: T.DataType) -> str:
    """Coarse storage family: text, long, double, decimal, bool, time or other."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.IntegralType):
        return "long"
    if isinstance(dtype, T.FractionalType):
        return "decimal" if isinstance(dtype, T.DecimalType) else "double"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def families(df: DataFrame) -> dict[str, str]:
    return {field.name: family_of(field.dataType) for field in df.schema.fields}


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: turn NaN into null in every floating-point column."""
    floating = [n for n, fam in families(df).items() if fam == "double" and not n.startswith(HIDDEN_PREFIX)]
    if not floating:
        return df
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floating})


def with_row_order(df: DataFrame, *order_by: str) -> DataFrame:
    """Attach the hidden row-order key that first/last, samples and previews use."""
    require_columns(df, list(order_by))
    key = col(order_by[0]) if len(order_by) == 1 else F.struct(*[col(n) for n in order_by])
    return df.withColumn(ROW_ORDER, key)


def order_keys(df: DataFrame) -> list[Column]:
    """Row-order key of a frame; all data columns when none was attached."""
    if ROW_ORDER in df.columns:
        return [F.col(ROW_ORDER)]
    kinds = families(df)
    plain = [col(n) for n in visible(df) if kinds[n] != "other"]
    return plain or [F.to_json(F.struct(col(n))) for n in visible(df)]


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def local_table(*parts: DataFrame) -> DataFrame:
    """Small result frames (one row per column or issue) computed once and kept as a local table."""
    import pyarrow as pa

    from tableprep.plans.jobs import side_by_side

    spark = parts[0].sparkSession
    tables = side_by_side(spark, *[part.toArrow for part in parts])
    # One chunk: rows after an empty chunk are lost when a chunked table becomes a DataFrame.
    return spark.createDataFrame(pa.concat_tables(tables, promote_options="permissive").combine_chunks())


def head_in_order(df: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows in row order.

    The cut-off of the leading key is found from that one column, so the wide
    columns are read only for the row groups at or below the cut-off.
    """
    kinds = families(df)
    lead = ROW_ORDER if ROW_ORDER in df.columns else next((n for n in visible(df) if kinds[n] != "other"), None)
    if lead is not None and kinds[lead] in ("long", "double", "decimal", "time", "text"):
        # Missing keys sort first, so a smallest key that is missing rules the cut-off out.
        keys = df.select(col(lead).alias("key")).orderBy("key").limit(limit)
        cut, missing = keys.agg(F.max("key"), count_if(F.col("key").isNull())).first()
        if cut is not None and not missing:
            df = df.filter(col(lead) <= F.lit(cut))
    return df.orderBy(*order_keys(df)).limit(limit)


