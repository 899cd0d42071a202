"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns is rendered once as the prompt; what follows
on either side is a completion with a mask that says which characters are
trained on: the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require_columns

START, STOP = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def render(turn: Column) -> Column:
    """A turn as text; a null role or text counts as empty."""
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(f"{STOP}\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def _mask(turns: Column) -> Column:
    """Run lengths of the completion's mask, "characters:trained" by turn, joined by commas."""
    flag = lambda t: F.when(t["role"].eqNullSafe(F.lit(TRAINED_ROLE)), F.lit("1")).otherwise(F.lit("0"))
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", F.char_length(render(t)), flag(t))), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns, equal in role and text, that two arrays of turns share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def preference_pairs(turns: DataFrame, *, pair: Column, chosen: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each ``pair``: pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``pair`` numbers the pair of a turn's conversation, and ``chosen`` says on which side it stands.  Turns
    follow turn number, then role and text; repeated rows are repeated turns.  A pair of which one side is
    missing has a null id and an empty completion there, an empty prompt, and the other side as it is.  If a
    side holds more than one conversation they follow each other by id, and the smallest id is given.  Rows
    whose conversation is null are left out, since they belong to no pair; an empty table gives an empty
    result; other columns are ignored.
    """
    require_columns(turns, [conv_col, turn_col, role_col, text_col])
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        pair.alias("pair_id"),
        F.coalesce(chosen, F.lit(False)).alias("side"),
        F.struct(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"),
    )
    # One exchange brings both sides together.
    both = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("b"),
    )
    cut = both.withColumn("prompt_turns", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    cut = cut.withColumns({"ra": rest("a"), "rb": rest("b"), "p": F.slice("a", 1, F.col("prompt_turns"))})
    return cut.select(
        "pair_id",
        F.try_element_at("a", F.lit(1))["conv"].alias("chosen_id"),
        F.try_element_at("b", F.lit(1))["conv"].alias("rejected_id"),
        "prompt_turns",
        _joined(F.col("p")).alias("prompt"),
        _joined(F.col("ra")).alias("chosen"),
        _joined(F.col("rb")).alias("rejected"),
        _mask(F.col("ra")).alias("chosen_mask"),
        _mask(F.col("rb")).alias("rejected_mask"),
    )


def paired_by_number(turns: DataFrame) -> DataFrame:
    """The table has no preference marks: conversation 2k is taken as chosen and 2k + 1 as rejected."""
    conv = F.col("conv_id").cast("long")
    return preference_pairs(turns, pair=F.floor(conv / 2).cast("long"), chosen=F.pmod(conv, F.lit(2)) == 0)
