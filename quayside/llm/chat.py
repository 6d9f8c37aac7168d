"""Preference formatting: the longest common turn prefix once as prompt, and two masked completions.

DataFrame functions only. A conversation is its turns in order; a pair names a chosen and a rejected one.
The longest common prefix of the two turn lists (same role and text) becomes the prompt, rendered once and ending
with the head of an assistant turn when both go on with one; what follows it in either becomes its completion. Masks list the spans
(code points within the completion) that are trained on: the texts of assistant turns with their end marks.

A conversation is one output row, so its turns meet in one task; pairs join on conversation ids, which Spark splits where one is hot.

Defined cases: null text counts as empty, a null role as "user"; turns sort by number (null first), then role and text; turns that repeat are kept; turns without a
conversation id form one conversation, which no pair can name; a pair with a missing conversation treats
it as empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import text_of, written

START, END = "<|im_start|>", "<|im_end|>\n"
HEAD = f"{START}assistant\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as structs (role, text)."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), text_of(text_col).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return turns.groupBy(F.col(id_col).alias("conv")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the two lists share from the first on."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y)
    apart = F.array_position(same, False)
    return F.when(apart == 0, shorter.cast("long")).otherwise(apart - 1)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _rest(turns: Column, n: Column) -> Column:
    return F.slice(turns, (n + 1).cast("int"), F.greatest(F.size(turns) - n, F.lit(0)).cast("int"))


def _completion(rest: Column, headed: Column) -> Column:
    """Text of the turns after the prompt; the first head is left out where the prompt ends with it."""
    whole = render(rest)
    return F.when(headed, F.substring(whole, len(HEAD) + 1, F.length(whole))).otherwise(whole)


def _mask(rest: Column, headed: Column) -> Column:
    """Spans of the assistant texts and their end marks within the completion."""
    first = F.struct(F.when(headed, -len(HEAD)).otherwise(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(START) + F.length(t["role"]) + 1
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(rest, first, step, lambda acc: acc["spans"])


def preference_rows(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen, rejected)`` of turn lists, as (pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    full = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    split = full.withColumn("n_common", common_turns(F.col("c"), F.col("r")))
    split = split.select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common").cast("int")).alias("shared"), _rest(F.col("c"), F.col("n_common")).alias("c"), _rest(F.col("r"), F.col("n_common")).alias("r"))
    goes_on = lambda x: F.coalesce(F.get(F.col(x), F.lit(0))["role"] == "assistant", F.lit(False))
    split = split.withColumn("headed", goes_on("c") & goes_on("r"))
    headed = F.col("headed")
    return split.select(
        "pair_id", "n_common", F.concat(render(F.col("shared")), F.when(headed, HEAD).otherwise("")).alias("prompt"),
        _completion(F.col("c"), headed).alias("chosen"), _completion(F.col("r"), headed).alias("rejected"), _mask(F.col("c"), headed).alias("chosen_mask"), _mask(F.col("r"), headed).alias("rejected_mask"),
    )


def preferences(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format ``pairs(pair_id, chosen_id, rejected_id)`` of conversations of ``turns``."""
    talks = written(conversations(turns, id_col, turn_col, role_col, text_col), "conversations")
    chosen = pairs.join(talks.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id", "left")
    both = chosen.join(talks.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("rejected")), "rejected_id", "left")
    return preference_rows(both.select("pair_id", "chosen", "rejected"))


def swapped_answers(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs for ``preference_rows`` where none are given: every conversation is chosen, and rejected is the same one with its last
    assistant turn replaced by the last assistant turn of its partner (ids 2k and 2k+1 are partners). Without an assistant turn
    the conversation is cut at its end; without a partner, or one with no assistant turn, nothing follows the cut."""
    talks = written(conversations(turns, id_col, turn_col, role_col, text_col).where("conv IS NOT NULL"), "conversations")
    last = lambda c: F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == "assistant", i)))
    answers = talks.select(F.col("conv").bitwiseXOR(F.lit(1)).alias("conv"), F.slice("turns", last(F.col("turns")) + 1, 1).alias("answer"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = talks.join(answers, "conv", "left").withColumn("cut", F.coalesce(last(F.col("turns")), F.size("turns")))
    return both.select(F.col("conv").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("cut")), F.coalesce("answer", none)).alias("rejected"))
