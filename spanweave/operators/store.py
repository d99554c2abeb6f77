"""The registry of graphs and the conversations, as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_rows(df: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row per key: the latest by `latest`, else the smallest row; a partial aggregate."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    pick = F.max_by(row, F.struct(latest)) if latest else F.min(row)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("r")).select(key, "r.*")


def conversation_list(conversations: DataFrame) -> DataFrame:
    c = conversations.groupBy("conversation_id").agg(F.min("graph_id").alias("graph_id"), F.min("user_id").alias("user_id"), F.min("name").alias("name"), F.max("created_at").alias("created_at"), F.max(F.coalesce(F.size("history"), F.lit(0))).alias("n_turns"))
    return c.withColumn("n_turns", F.greatest(F.lit(0), "n_turns"))


def conversation_history(conversations: DataFrame) -> DataFrame:
    """Turns of every conversation by time, nulls first, then by place; repeated rows once."""
    c = conversations.where("history is not null").select("conversation_id", "history").groupBy("conversation_id").agg(F.min("history").alias("history"))
    turn = F.transform("history", lambda h, i: F.struct(h["timestamp"].alias("ts"), i.alias("i"), h["user"].alias("user"), h["assistant"].alias("assistant")))
    c = c.select("conversation_id", F.posexplode(F.array_sort(turn)).alias("pos", "t"))
    return c.select("conversation_id", F.col("pos").cast("long").alias("pos"), "t.ts", "t.user", "t.assistant")


def conversations_of(turns: DataFrame) -> DataFrame:
    """Conversations from an append-only table of turns (conversation_id, graph_id, user_id, name, user, assistant,
    timestamp, created_at); the history in order of time. A conversation is one row, as it is read by people."""
    t = F.struct("timestamp", "user", "assistant")
    c = turns.groupBy("conversation_id").agg(F.min("graph_id").alias("graph_id"), F.min("user_id").alias("user_id"), F.min("name").alias("name"), F.array_sort(F.collect_list(t)).alias("h"), F.min("created_at").alias("created_at"))
    history = F.transform("h", lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"), x["timestamp"].alias("timestamp")))
    return c.select("conversation_id", "graph_id", "user_id", "name", history.alias("history"), "created_at")


def append_turn(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """History with the turns of `new` (conversation_id, user, assistant, timestamp) at the end, in their order."""
    n = new.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "user", "assistant"))).alias("add"))
    n = n.select("conversation_id", F.transform("add", lambda t: F.struct(t["user"].alias("user"), t["assistant"].alias("assistant"), t["timestamp"].alias("timestamp"))).alias("add"))
    h = F.coalesce("history", F.from_json(F.lit("[]"), "array<struct<user:string,assistant:string,timestamp:string>>"))
    return conversations.join(n, "conversation_id", "left").withColumn("history", F.when(F.col("add").isNull(), F.col("history")).otherwise(F.concat(h, F.col("add")))).drop("add")


def graphs_of(graphs: DataFrame, user: str) -> DataFrame:
    return graphs.where(F.col("user_id") == user)


def accessible(conversations: DataFrame, graphs: DataFrame) -> DataFrame:
    """Conversations whose user owns the graph they are on."""
    g = graphs.select("graph_id", "user_id").where("user_id is not null")
    return conversations.join(g, ["graph_id", "user_id"], "left_semi")


def cascade_delete(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """A table without the rows of the graphs in `doomed`; rows without a graph stay."""
    return table.join(doomed.select("graph_id"), "graph_id", "left_anti")


def default_of(c: Column, value: str) -> Column:
    return F.coalesce(c, F.lit(value))
