"""Preference pairs: the shared turns once as prompt, then two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is written.
TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), F.coalesce(role, F.lit("")), F.lit(ROLE_END), F.coalesce(text, F.lit("")), F.lit(TURN_END))


def _turns(side: DataFrame, name: str, pair: str) -> DataFrame:
    """One row per pair and turn; turns in order, equal turn numbers by role and text."""
    order = Window.partitionBy(pair).orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return side.select(F.col(pair), F.row_number().over(order).alias("at"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias(name))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Formats pairs of conversations.

    Both inputs have ``pair``, turn, role, text: a pair's turns. One row per pair that occurs
    on both sides: ``pair``, prompt_turns, prompt, chosen, rejected (texts), and chosen_spans
    and rejected_spans: arrays of (start, end, train), code point spans that cover prompt plus
    completion; train marks the words of assistant turns after the prompt, all else is masked.

    The prompt is the longest common prefix of turns (same role and text), rendered once. Equal
    conversations have empty completions. Null roles and texts count as empty, null turn
    numbers come last, equal ones are ordered by role and text. Pairs with a null id or only
    one side give no row. Other columns are ignored.
    """
    both = _turns(chosen, "c", pair).join(_turns(rejected, "r", pair), [pair, "at"], "full_outer")
    first_split = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("at")))
    sides = both.groupBy(pair).agg(
        first_split.alias("split"),
        F.count("c").alias("n_c"),
        F.count("r").alias("n_r"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("at", F.col("c.role").alias("role"), F.col("c.text").alias("text"))))).alias("cs"),
        F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("at", F.col("r.role").alias("role"), F.col("r.text").alias("text"))))).alias("rs"),
    ).where((F.col("n_c") > 0) & (F.col("n_r") > 0))
    shared = F.coalesce(F.col("split") - 1, F.col("n_c")).cast("int")

    def text_of(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")

    def spans(turns: Column, prompt: Column) -> Column:
        state = "struct<at: bigint, out: array<struct<start: bigint, end: bigint, train: boolean>>>"
        n = F.length(prompt).cast("long")
        masked = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"), F.lit(False).alias("train")))
        start = F.struct(n.alias("at"), masked.alias("out")).cast(state)

        def step(acc: Column, t: Column) -> Column:
            head = acc["at"] + F.length(F.concat(F.lit(TURN_START), t["role"], F.lit(ROLE_END))).cast("long")
            end = head + F.length(F.concat(t["text"], F.lit(TURN_END))).cast("long")
            new = F.array(
                F.struct(acc["at"].alias("start"), head.alias("end"), F.lit(False).alias("train")),
                F.struct(head.alias("start"), end.alias("end"), (t["role"] == "assistant").alias("train")),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], new).alias("out")).cast(state)

        return F.aggregate(turns, start, step)["out"]

    rows = sides.select(pair, shared.alias("prompt_turns"), F.slice("cs", 1, F.greatest(shared, F.lit(0))).alias("p"), F.slice("cs", shared + 1, F.size("cs") + 1).alias("c"), F.slice("rs", shared + 1, F.size("rs") + 1).alias("r"))
    rows = rows.withColumn("prompt", text_of(F.col("p")))
    return rows.select(
        pair, "prompt_turns", "prompt", text_of(F.col("c")).alias("chosen"), text_of(F.col("r")).alias("rejected"),
        spans(F.col("c"), F.col("prompt")).alias("chosen_spans"), spans(F.col("r"), F.col("prompt")).alias("rejected_spans"),
    )


def swapped_replies(conversations: DataFrame, ranges: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from plain conversations.

    Chosen is each conversation with an assistant turn, up to its last one; rejected is the
    same with that turn's text taken from the next such conversation by id (after the last:
    the first). Ids are dealt in ranges; one number a range links them.
    """
    from foliant.llm.common import range_bounds, range_of

    turns = conversations.where(F.col("conv_id").isNotNull())
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = last.withColumn("reply", F.col("last.text"))
    bounds = sorted(set(range_bounds(last, "conv_id", "reply", 1 << 23))) if ranges is None else ranges
    dealt = last.select("conv_id", "last", range_of(F.col("conv_id"), F.col("reply"), bounds).alias("bucket"))
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("conv_id", "last")).alias("head"))
    order = heads.groupBy().agg(F.sort_array(F.collect_list("bucket")).alias("all"))
    after = order.select(F.explode(F.transform("all", lambda x, i: F.struct(x.alias("bucket"), F.element_at("all", F.when(i + 1 < F.size("all"), i + 2).otherwise(1)).alias("next")))).alias("p")).select("p.*")
    heads = after.join(heads.select(F.col("bucket").alias("next"), F.col("head.last.text").alias("head_text")), "next").select("bucket", "head_text")
    w = Window.partitionBy("bucket").orderBy("conv_id")
    replies = dealt.withColumn("reply", F.lead("last.text").over(w)).join(heads, "bucket")
    replies = replies.select("conv_id", F.col("last.turn").alias("last_turn"), F.coalesce("reply", "head_text").alias("reply"))
    kept = turns.join(replies, "conv_id").where(F.coalesce("turn", F.lit(-1)) <= F.col("last_turn"))
    is_last = (F.coalesce("turn", F.lit(-1)) == F.col("last_turn")) & (F.col("role") == "assistant")
    chosen = kept.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rejected = kept.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(is_last, F.col("reply")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected
