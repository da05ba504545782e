"""Use of the portal: conversations, quotas, rates and audit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.session import Scratch


def conversation_counts(conversations: DataFrame, messages: DataFrame, owner: str | None = None) -> DataFrame:
    """Conversations with their number of messages; with an ``owner`` that user's and those of nobody."""
    c = conversations if owner is None else conversations.where((F.col("user_id") == owner) | F.col("user_id").isNull())
    n = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.countDistinct("id").alias("n_messages"))
    return c.select("id", "user_id", "title", "created_at").distinct().join(n, "id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def daily_use(events: DataFrame, limit: float) -> DataFrame:
    """(user_id, day, used, remaining): sums per user and UTC day, and what is left of the limit."""
    g = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("used"))
    return g.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0.0)))


def token_bucket(events: DataFrame, capacity: float = 20.0, per_second: float = 20.0 / 60.0) -> DataFrame:
    """``events`` (event_id, user_id, ts) plus ``allowed``: a bucket per user, refilled over time, one token a request.

    The state after a request depends on those before it, but a bucket that
    rested long enough to be full again has forgotten them.  So the requests are
    sorted by range over all users, cut into stretches at such rests, and each
    stretch is folded by itself: a user with a third of all requests is spread
    over the tasks, and only requests without a rest stay together.  They are
    streamed through the fold, never held as one group.  Rows with a null time
    are left out; a null user is one user.
    """
    spark = events.sparkSession
    rest = int(capacity / per_second * 1e6)
    kind, who = events.schema["event_id"].dataType.simpleString(), events.schema["user_id"].dataType.simpleString()
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us is not null")
    rows = rows.repartitionByRange("user_id", "us", "event_id").sortWithinPartitions("user_id", "us", "event_id").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, at, n = object(), 0, 0
        for b in batches:
            local = []
            for u, t in zip(b["user_id"].where(b["user_id"].notna(), None).tolist(), b["us"].tolist()):
                if u != user or t - at >= rest:
                    n += 1
                user, at = u, t
                local.append(n)
            yield b.assign(local=local)

    work = Scratch(spark, "bucket")
    cuts = work.write(rows.mapInPandas(cut, f"event_id {kind}, user_id {who}, us bigint, part int, local int"), "cuts")
    ends = cuts.groupBy("part").agg(F.min(F.struct("local", "us", "user_id")).alias("a"), F.max(F.struct("local", "us", "user_id")).alias("z"))  # one row per partition
    w = W.orderBy("part")
    goes_on = F.lag("z.user_id").over(w).eqNullSafe(F.col("a.user_id")) & (F.col("a.us") - F.lag("z.us").over(w) < rest)
    before = F.coalesce(F.sum(F.col("z.local")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = F.sum(F.coalesce(goes_on, F.lit(False)).cast("int")).over(w)
    base = ends.select("part", (before - joined).alias("base"))
    whole = cuts.join(F.broadcast(base), "part").withColumn("stretch", F.col("base") + F.col("local")).select("event_id", "user_id", "us", "stretch")
    whole = whole.repartition("stretch").sortWithinPartitions("stretch", "us", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, level, at = None, capacity, 0
        for b in batches:
            allowed = []
            for s, t in zip(b["stretch"].tolist(), b["us"].tolist()):
                if s != stretch:
                    stretch, level, at = s, capacity, t
                level = min(capacity, level + (t - at) / 1e6 * per_second)
                at = t
                allowed.append(level >= 1)
                level -= level >= 1
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b["user_id"], "allowed": allowed})

    return whole.mapInPandas(fold, f"event_id {kind}, user_id {who}, allowed boolean")


def active_users(users: DataFrame, names: DataFrame) -> DataFrame:
    """Active users of the given names."""
    return users.where("active = 1").join(names.select("username").distinct(), "username", "left_semi")


def owned(conversations: DataFrame, user_id: str) -> DataFrame:
    """The conversations a user may read: that user's and those of nobody."""
    return conversations.where((F.col("user_id") == user_id) | F.col("user_id").isNull())


def without(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations ``gone`` (id) and their messages."""
    ids = gone.select("id").distinct()
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def appended(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows and the new ones; a row whose id is stored already is not added again, one with a null id is."""
    return stored.unionByName(new.join(stored.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def allowed(role: Column, roles: list[str]) -> Column:
    """Whether a role may act; no role may not."""
    return F.coalesce(role.isin(roles), F.lit(False))


def answer_language(role: Column, asked: Column, may_force: list[str]) -> Column:
    """The language asked for, if the role may force one; else ``auto``."""
    return F.when(allowed(role, may_force), F.coalesce(asked, F.lit("auto"))).otherwise("auto")
