"""Conversations rebuilt from message rows.

Messages are range-partitioned and sorted by (conversation, time, role), so one
conversation with any share of all rows is spread over as many tasks as it
needs.  A finite-state automaton (start, after user, after assistant, broken)
runs over each sorted stretch; as its transitions compose, the summaries of the
stretches of one conversation are folded in order into its verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.session import Scratch

ROLES = ("system", "user", "assistant")  # also their order at equal times
_TURN = "conversation_id string, message_id string, role string, content string, created_at double, mark long, part int, stretch int, turn int, repeated boolean"


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s​-‏⁠﻿]")


def turns(messages: DataFrame, bodies: bool = True) -> DataFrame:
    """Non-blank messages in order, with the stretch each was sorted in.

    ``messages`` has id, conversation_id, role, content and created_at; other
    columns are ignored, repeated rows count once, rows without conversation
    are left out, a null time sorts first.  ``role`` is one of the three roles
    or ``other`` (a null role too).  ``turn`` numbers the rows within the
    stretch that are neither system rows nor repeats of the row before;
    ``repeated`` marks those repeats.  Without ``bodies`` the contents stay
    behind and their digests take their place in the order, which is enough for
    a verdict: of equal role and time only the number of contents counts.
    """
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))
    content = F.col("content") if bodies else F.lit(None).cast("string")
    rows = (
        messages.where(F.col("conversation_id").isNotNull() & ~blank(F.col("content")))
        .select("conversation_id", F.col("id").alias("message_id"), F.when(role.isin(*ROLES), role).otherwise("other").alias("role"), content.alias("content"), F.col("created_at").cast("double").alias("created_at"), F.xxhash64("content").alias("mark"))
        .distinct().withColumn("rank", F.expr("array_position(array('system','user','assistant','other'), role)"))
    )
    keys = ["conversation_id", "created_at", "rank", "content" if bodies else "mark", "message_id"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("rank").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, b in enumerate(batches):
            b["stretch"] = k
            real = b[b["role"] != "system"]
            same = (real["conversation_id"] == real["conversation_id"].shift()) & (real["role"] == real["role"].shift()) & (real["mark"] == real["mark"].shift())
            b["repeated"] = same.reindex(b.index, fill_value=False).astype(bool)
            counted = (b["role"] != "system") & ~b["repeated"]
            b["turn"] = counted.astype("int32").groupby(b["conversation_id"]).cumsum().where(counted)
            b["turn"] = b["turn"].astype("Int32")
            yield b[["conversation_id", "message_id", "role", "content", "created_at", "mark", "part", "stretch", "turn", "repeated"]]

    return rows.mapInPandas(number, _TURN)


def stretches(t: DataFrame) -> DataFrame:
    """Automaton summary of each stretch of each conversation: its first and last turn and whether all steps inside are legal."""
    place = F.struct("created_at", "turn")
    turn = F.struct("role", "mark")
    counted = F.col("turn").isNotNull()
    # Legal inside: roles alternate, so odd turns have one role and even turns the other.
    odd, even = counted & (F.col("turn") % 2 == 1), counted & (F.col("turn") % 2 == 0)
    one = lambda c: F.coalesce(F.min(F.when(c, F.col("role"))), F.lit("")), lambda c: F.coalesce(F.max(F.when(c, F.col("role"))), F.lit(""))
    return t.groupBy("conversation_id", "part", "stretch").agg(
        F.count(F.when(counted, 1)).alias("n"),
        F.max((F.col("role") == "other").cast("int")).alias("alien"),
        F.min_by(F.when(counted, turn), F.when(counted, F.col("turn"))).alias("first"),
        F.max_by(F.when(counted, turn), F.when(counted, F.col("turn"))).alias("last"),
        (
            (one[0](odd) == one[1](odd)) & (one[0](even) == one[1](even)) & (one[0](odd) != one[0](even))
        ).alias("legal"),
    )


def judge(summaries: DataFrame) -> DataFrame:
    """Per conversation: the folded automaton. ``verdict`` is kept, alien_role, empty or broken; ``n_turns`` counts turns."""
    item = F.struct("part", "stretch", "n", "alien", "first", "last", "legal")
    grouped = summaries.groupBy("conversation_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    first_of = "cast(null as struct<role:string,mark:bigint>)"
    state = f"named_struct('n', cast(0 as bigint), 'alien', 0, 'first', {first_of}, 'last', {first_of}, 'legal', true)"
    step = """(a, x) -> named_struct(
        'n', a.n + x.n - if(a.last <=> x.first and x.n > 0, 1, 0),
        'alien', greatest(a.alien, x.alien),
        'first', coalesce(a.first, x.first),
        'last', coalesce(x.last, a.last),
        'legal', a.legal and (x.n = 0 or (x.legal and (a.last is null or a.last <=> x.first or a.last.role <> x.first.role))))"""
    folded = grouped.select("conversation_id", F.expr(f"aggregate(s, {state}, {step})").alias("f"))
    verdict = (
        F.when(F.col("f.alien") == 1, "alien_role").when(F.col("f.n") == 0, "empty")
        .when(F.col("f.legal") & (F.col("f.first.role") == "user") & (F.col("f.last.role") == "assistant"), "kept").otherwise("broken")
    )
    return folded.select("conversation_id", verdict.alias("verdict"), F.col("f.n").alias("n_turns"))


def rebuild(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``turns``, ``verdicts``): ordered turns of the kept conversations, and the verdict on every conversation.

    turns: conversation_id, turn_no (from 1), role, content, created_at; system
    rows have turn_no 0.  A conversation without any non-blank message is in
    neither table.
    """
    work = Scratch(messages.sparkSession, "conversations")
    t = work.write(turns(messages), "turns")
    s = stretches(t)
    verdicts = judge(s)
    order = W.partitionBy("conversation_id").orderBy("part", "stretch")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    # A stretch that starts with a repeat of the last turn before it gives one turn less.
    s = s.withColumn("joint", F.coalesce((F.col("n") > 0) & (before == F.col("first")), F.lit(False)))
    gain = F.col("n") - F.col("joint").cast("int")
    s = s.withColumn("offset", F.coalesce(F.sum(gain).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("joint").cast("int"))
    kept = s.join(verdicts.where("verdict = 'kept'").select("conversation_id"), "conversation_id").select("conversation_id", "part", "stretch", "offset", "joint")
    out = (
        t.where("not repeated").join(kept, ["conversation_id", "part", "stretch"]).where("not (joint and turn <=> 1)")
        .select("conversation_id", F.when(F.col("turn").isNull(), 0).otherwise(F.col("turn") + F.col("offset")).cast("int").alias("turn_no"), "role", "content", "created_at")
    )
    return out, verdicts
