"""Preference formatting: the shared turns of two conversations once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def render_turn(t: Column) -> Column:
    """One turn of the template: a role line, the text, an end mark."""
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def _mask(turns: Column, role: str) -> Column:
    """Spans of the rendered completion that count for the loss, "start:end" in code points, end exclusive.

    They are the texts and end marks of the turns of ``role``; everything else is masked.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.char_length(render_turn(t))
        first = acc["at"] + F.char_length(t["role"]) + 5
        span = F.concat(first.cast("string"), F.lit(":"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """One row for each pair of conversations.

    ``turns``: (pair_id, chosen boolean, turn, role, text), a row a turn; more columns are ignored.
    Turns are ordered by turn, then role, then text; repeated rows are repeated turns. A null role or
    text counts as ''. Rows with a null pair_id or side belong to no pair and are left out. A side
    without turns gives an empty completion, and the prompt is then empty too. Returns
    (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask): the longest
    common prefix of turns (same role and text), rendered once, and each side's other turns.
    """
    entry = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    sides = (
        turns.where("pair_id is not null and chosen is not null")
        .groupBy("pair_id")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("chosen"), entry))).cast(_TURN).alias("yes"),
            F.sort_array(F.collect_list(F.when(~F.col("chosen"), entry))).cast(_TURN).alias("no"),
        )
    )
    same = F.zip_with("yes", "no", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    n = F.when(differs > 0, differs - 1).otherwise(F.size("yes"))
    after = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    cut = sides.withColumn("n", n).select("pair_id", "n", F.slice("yes", 1, F.col("n")).alias("shared"), after("yes").alias("yes"), after("no").alias("no"))
    return cut.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _rendered(F.col("shared")).alias("prompt"),
        _rendered(F.col("yes")).alias("chosen"),
        _rendered(F.col("no")).alias("rejected"),
        _mask(F.col("yes"), role).alias("chosen_mask"),
        _mask(F.col("no"), role).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of single conversations: the even conv_id is chosen, the odd one after it rejected."""
    return conversations.select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"
    )
