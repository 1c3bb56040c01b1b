"""Preference formatting of conversations, by DataFrame functions alone.

A pair is a chosen and a rejected conversation, as rows (pair, side, turn, role, text). Turns that both
have in common from the start are the prompt and rendered once; what follows is each side's completion,
where assistants' turns are learned and other turns are masked. Conversations have no bound, so all is
done on turns and their spans; a whole string is only built where render() is asked for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the rendered form.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
BLOCK = 256  # turns that are summed up together before blocks are


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def common_prefix(turns: DataFrame) -> DataFrame:
    """(pair, prompt_turns): how many turns from the first on both sides share in role and text.

    Turns count by their number; a number that one side lacks, or has more than once with other
    contents, ends the prefix. Nulls equal nulls.
    """
    same = F.xxhash64(F.coalesce("role", F.lit("\u0000")), F.coalesce("text", F.lit("\u0000")), F.length("text"))
    sides = turns.groupBy("pair", "turn").agg(
        *(F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in ("chosen", "rejected")),
        *(f(F.when(F.col("side") == s, same)).alias(f"{n}_{s}") for s in ("chosen", "rejected") for n, f in (("lo", F.min), ("hi", F.max))),
        F.min(F.struct("role", "text")).alias("least"),
        F.max(F.struct("role", "text")).alias("most"),
    )
    agree = (F.col("n_chosen") == F.col("n_rejected")) & (F.col("lo_chosen") == F.col("lo_rejected")) & (F.col("hi_chosen") == F.col("hi_rejected")) & (F.col("lo_chosen") == F.col("hi_chosen")) & F.col("least").eqNullSafe(F.col("most"))
    ends = sides.groupBy("pair").agg(F.min(F.when(~agree, F.col("turn"))).alias("cut"), F.max("turn").alias("last"))
    return ends.select("pair", F.coalesce("cut", F.col("last") + 1).alias("cut"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row a turn of the output: (pair, part, turn, role, segment, learned, start, length).

    part is prompt, chosen or rejected; segment is the rendered turn; start is its place in code points
    within its part, and of a completion counts from the prompt's end. learned marks what a loss counts:
    assistants' turns of completions. Where both sides are equal, all is prompt and no completion follows.
    Null roles and texts are rendered as empty; rows without pair or turn are left out; repeated rows stand
    as often as they come, those of a like turn in the order of a hash. Other columns are left out. An empty
    table gives no rows.
    """
    turns = turns.select("pair", "side", "turn", "role", "text")
    cut = common_prefix(turns)
    rows = turns.join(cut, "pair").where((F.col("turn") >= F.col("cut")) | (F.col("side") == "chosen"))
    part = F.when(F.col("turn") < F.col("cut"), F.lit("prompt")).otherwise(F.col("side"))
    rows = rows.select("pair", part.alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("segment"))
    rows = rows.withColumn("learned", (F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))).withColumn("length", F.length("segment").cast("long"))
    # places: blocks of turns are summed first, so that a very long conversation is dealt over tasks
    block = F.floor(F.col("turn") / BLOCK)
    rows = rows.withColumn("block", block)
    sums = rows.groupBy("pair", "part", "block").agg(F.sum("length").alias("n"))
    ahead = Window.partitionBy("pair", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("pair", "part", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("pair", "part", "block").orderBy("turn", F.xxhash64("segment")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("length").over(within), F.lit(0))).join(base, ["pair", "part", "block"])
    return placed.select("pair", "part", "turn", "role", "segment", "learned", (F.col("own") + F.col("base")).alias("start"), "length")


def render(formatted: DataFrame) -> DataFrame:
    """(pair, prompt, chosen, rejected, chosen_spans, rejected_spans): whole strings and their learned spans, for pairs that fit a row."""
    text = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("start", "segment")))), lambda x: x["segment"]), "")
    spans = lambda p: F.array_sort(F.collect_list(F.when((F.col("part") == p) & F.col("learned"), F.struct("start", (F.col("start") + F.col("length")).alias("end")))))
    return formatted.groupBy("pair").agg(text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def pairs_from(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a table of conversations: each is the chosen side of a pair of its number.

    The rejected side is what the assistant would have got without its last answer: the same turns,
    with the last assistant turn replaced by its own text's second half. A conversation without an
    assistant turn has two equal sides. Rows without conv_id or turn are left out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair"), F.col("turn").cast("long").alias("turn"), "role", "text").where("pair IS NOT NULL AND turn IS NOT NULL")
    last = rows.where("role = 'assistant'").groupBy("pair").agg(F.max("turn").alias("last"))
    both = rows.join(last, "pair", "left")
    half = F.expr("substring(text, int(length(text) div 2) + 1)")
    changed = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), half).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), changed.alias("text")))
    return both.select("pair", "turn", "role", F.inline(sides)).select("pair", "side", "turn", "role", "text")
