"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's turns in order; equal rows count once, turns of one number go by role and text.

    A null role is a user's, a null text is empty, a null number comes first, a null key is a conversation. Equal rows
    are removed before the grouping, in all tasks, so a conversation's cell holds and sorts different turns only.
    """
    said = turns.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("user")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return said.groupBy("key").agg(ordered.alias("all")).select(
        F.col("key").alias(key), F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def stale_reply_pairs(talks: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected) of conversations: up to the last answer; and the same with that answer exchanged.

    The exchanged answer is the assistant's previous one, else the last words of the user, else empty. A conversation
    without an answer is chosen and rejected alike.
    """
    turns = F.col("turns")
    from_end = F.array_position(F.reverse(F.transform(turns, lambda t: t["role"])), "assistant").cast("int")
    last = F.when(from_end > 0, F.size(turns) - from_end + 1).otherwise(F.size(turns))
    answered = from_end > 0
    head = F.slice(turns, F.lit(1), F.greatest(last - 1, F.lit(0)))
    said = lambda who: F.get(F.reverse(F.transform(F.filter(head, lambda t: t["role"] == who), lambda t: t["text"])), F.lit(0))
    other = F.struct(F.lit("assistant").alias("role"), F.coalesce(said("assistant"), said("user"), F.lit("")).alias("text"))
    chosen = F.slice(turns, F.lit(1), last)
    return talks.select(key, chosen.alias("chosen"), F.when(answered, F.concat(head, F.array(other))).otherwise(chosen).alias("rejected"))


def _safe(text: Column) -> Column:
    """Marks of the template inside a text are broken up, so that no text can open or close a turn."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def segments(turns: Column) -> Column:
    """Rendered turns as alternating pieces, array<struct<text, loss>>: heads without loss, the assistant's words with it."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit("<|"), _safe(t["role"]), F.lit("|>\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(F.concat(_safe(t["text"]), F.lit("<|end|>\n")).alias("text"), (t["role"] == "assistant").alias("loss")),
            ),
        )
    )


def rendered(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def mask(pieces: Column) -> Column:
    """Lengths of the pieces in code points, ``+`` after those with loss and ``-`` after the others."""
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.char_length(p["text"]).cast("string"), F.when(p["loss"], "+").otherwise("-"))), "")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Turns at the front that are alike in role and text."""
    alike = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(alike, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(alike))


def format_preferences(pairs: DataFrame, key: str = "conv_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Per pair: the longest common turn prefix rendered once as ``prompt``, the rest of either as masked completion.

    Columns ``key``, ``n_prompt_turns``, ``prompt``, ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``,
    ``usable`` (the completions differ). Masks are run lengths of the completion; the prompt bears no loss. Only
    DataFrame functions; a pair needs no other row. A null side is an empty conversation, a null turn one without
    words of the user; two equal sides leave empty completions; further columns are not read.
    """
    none = F.array().cast(f"array<{TURN}>")
    tidy = lambda c: F.transform(
        F.coalesce(F.col(f"`{c}`").cast(f"array<{TURN}>"), none),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    sides = pairs.select(F.col(f"`{key}`").alias("key"), tidy(chosen).alias("c"), tidy(rejected).alias("r"))
    sides = sides.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda c: segments(F.slice(c, F.col("n") + 1, F.size(c)))
    parts = sides.select("key", "n", segments(F.slice("c", F.lit(1), F.col("n"))).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"),
        (~F.col("c").eqNullSafe(F.col("r"))).alias("usable"),
    )
