"""Sessions and messages: ownership, listings, history windows, appends and deletes.

Tables are append-only; a delete is a tombstone that later reads leave out by an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import history_line

HISTORY = 10
ROLES = ("user", "assistant")
NO_HISTORY = "No prior conversation."


def owned_session(sessions: DataFrame, user_id: object) -> DataFrame:
    """The sessions of a user: what any read or delete of messages goes through."""
    return sessions.where(F.col("user_id") == F.lit(user_id))


def list_sessions(sessions: DataFrame, user_id: object, limit: int = 20) -> DataFrame:
    """A user's sessions, the last touched first."""
    return owned_session(sessions, user_id).orderBy(F.desc("updated_at"), "id").limit(limit)


def session_messages(messages: DataFrame, sessions: DataFrame, session_id: object, user_id: object, limit: int | None = None) -> DataFrame:
    """The earliest messages of an owned session, oldest first; limit 0 or none gives all."""
    owned = owned_session(sessions, user_id).where(F.col("id") == F.lit(session_id)).select(F.col("id").alias("session_id"))
    found = messages.where(F.col("session_id") == F.lit(session_id)).join(owned, "session_id", "left_semi").orderBy("created_at", "id")
    return found.limit(limit) if limit else found


def last_messages(messages: DataFrame, count: int | None = HISTORY) -> DataFrame:
    """The latest count messages of every session; 0 or none gives all."""
    if not count:
        return messages
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= count).drop("_back")


def history_blocks(messages: DataFrame, count: int | None = HISTORY) -> DataFrame:
    """(session_id, history): the lines Role: content of the latest messages, in order."""
    line = F.struct("created_at", "id", history_line(F.col("role"), F.col("content")).alias("line"))
    lines = last_messages(messages, count).groupBy("session_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.regexp_replace(F.array_join(F.col("lines.line"), "\n"), r"(?U)^\s+|\s+$", "")
    return lines.select("session_id", F.when(text == "", F.lit(NO_HISTORY)).otherwise(text).alias("history"))


def session_updates(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with updated_at as the later of their own time and their last message's."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("_last"))
    return sessions.join(last, sessions["id"] == last["session_id"], "left").select(
        *[c for c in sessions.columns if c != "updated_at"], F.greatest("updated_at", "_last").alias("updated_at")
    )


def new_session(session_id: Column, user_id: Column, title: Column, now: Column) -> list[Column]:
    """Columns of a session row; a missing title reads New chat."""
    return [session_id.alias("id"), user_id.alias("user_id"), F.coalesce(title, F.lit("New chat")).alias("title"), now.alias("created_at"), now.alias("updated_at")]


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages of a role that the store takes."""
    return messages.where(F.col("role").isin(*ROLES))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without the sessions (id, user_id) that their owners delete; messages go with theirs."""
    ids = sessions.join(gone, ["id", "user_id"], "left_semi").select("id")
    return sessions.join(ids, "id", "left_anti"), messages.join(ids.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def delete_messages(messages: DataFrame, sessions: DataFrame, gone: DataFrame, user_id: object) -> DataFrame:
    """Messages without those of gone (id, session_id), where the user owns the session."""
    owned = owned_session(sessions, user_id).select(F.col("id").alias("session_id"))
    return messages.join(gone.join(owned, "session_id", "left_semi").select("id", "session_id"), ["id", "session_id"], "left_anti")


def answer_prompt(question: str, hits: list[tuple[str, str]], history: str, instruction: str) -> str:
    """The prompt of an answer: instruction, history, numbered excerpts (label, text), question."""
    excerpts = "\n\n".join(f"[{i}] Source: {label}\n{text}" for i, (label, text) in enumerate(hits, 1))
    return f"{instruction}\n\nConversation history:\n{history or NO_HISTORY}\n\nSource excerpts:\n{excerpts}\n\nLatest question: {question}\nAnswer:"


def numbered_excerpts(hits: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The excerpt block of each group of hits (display_source, text), numbered in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    numbered = hits.withColumn("_n", F.row_number().over(w))
    part = F.format_string("[%d] Source: %s\n%s", F.col("_n"), F.col("display_source"), F.col("text"))
    return numbered.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_n", part.alias("part")))).alias("p")).select(*group, F.array_join(F.col("p.part"), "\n\n").alias("excerpts"))


def rewritten_query(answer: str) -> str:
    """A model's rewritten query without white space and quotes around it."""
    return answer.strip().strip('"')
