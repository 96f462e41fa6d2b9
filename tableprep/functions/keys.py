"""Row identity keys for duplicate and overlap work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import col, families
from tableprep.functions.text import as_text, row_digest


def row_keys(df: DataFrame, columns: list[str], as_texts: frozenset[str] = frozenset()) -> list[Column]:
    """Grouping keys equal exactly when the rows agree on ``columns`` (missing equals missing).

    Numbers, dates and flags group in their own type; all text columns share one
    SHA-256 key, so long texts are never shuffled or sorted. ``as_texts`` names
    columns to compare by their text form whatever their type.
    """
    kinds, plain, texts = families(df), [], []
    for name in columns:
        if name in as_texts or kinds[name] in ("text", "other"):
            texts.append(as_text(col(name), kinds[name]))
        else:
            # Adding zero makes -0.0 equal to 0.0, as grouping treats them.
            plain.append(col(name) + F.lit(0.0) if kinds[name] == "double" else col(name))
    keys = [c.alias(f"__tp_k{i}") for i, c in enumerate(plain)]
    if texts:
        keys.append(row_digest(texts).alias("__tp_kt"))
    return keys
