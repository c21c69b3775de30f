"""Conversations, messages and feedback.

conversations: id, user_email, title, created_at, updated_at. messages: id, conversation_id, role, content,
position. feedback: id, message_id, user_email, value ('up' or 'down').
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.functions.scan import join_by_slice, row_position


def conversation_list(conversations: DataFrame, user_email: str | None = None) -> DataFrame:
    if user_email is not None:
        conversations = conversations.where(F.col("user_email") == user_email)
    return conversations.select("user_email", "id", "title", "created_at", "updated_at").orderBy(
        "user_email", F.col("updated_at").desc_nulls_last(), "id"
    )


def transcript(conversations: DataFrame, messages: DataFrame, conversation_id: int | None = None) -> DataFrame:
    """Messages in order, as rows, so that a long conversation never has to fit one cell."""
    if conversation_id is not None:
        conversations = conversations.where(F.col("id") == conversation_id)
        messages = messages.where(F.col("conversation_id") == conversation_id)
    owner = conversations.select(F.col("id").alias("conversation_id"), "user_email")
    return messages.join(owner, "conversation_id").select(
        "conversation_id", "user_email", "position", "role", "content"
    ).orderBy("conversation_id", "position")


def append_messages(messages: DataFrame, incoming: DataFrame, block: int = 1000) -> DataFrame:
    """Incoming messages (conversation_id, sequence, role, content) with the next free positions.

    The first position of a conversation is 0. ``sequence`` orders the messages of one batch; it is cut into
    blocks so that a very large conversation is numbered by many tasks.
    """
    last = messages.groupBy("conversation_id").agg(F.max("position").alias("_last"))
    slice_by = F.floor(F.col("sequence") / block)
    numbered = row_position(incoming, ["conversation_id"], ["sequence"], slice_by, "_n")
    return join_by_slice(numbered, last, ["conversation_id"], slice_by, "left").select(
        "conversation_id", "sequence", "role", "content",
        (F.coalesce("_last", F.lit(-1).cast("long")) + F.col("_n")).alias("position"),
    )


def feedback_rollup(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Up and down votes per conversation. Votes are counted per message before the join."""
    votes = (
        feedback.groupBy("message_id").pivot("value", ["up", "down"]).agg(F.count(F.lit(1))).na.fill(0, ["up", "down"])
    )
    return (
        votes.join(messages.select(F.col("id").alias("message_id"), "conversation_id"), "message_id")
        .groupBy("conversation_id")
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    )


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, feedback: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains after deleting the conversations (column ``id``), their messages and the feedback on those."""
    gone = deleted.select("id")
    kept_conversations = conversations.join(gone, "id", "left_anti")
    by_conversation = gone.withColumnRenamed("id", "conversation_id")
    kept_messages = messages.join(by_conversation, "conversation_id", "left_anti")
    lost_messages = messages.join(by_conversation, "conversation_id", "left_semi").select(F.col("id").alias("message_id"))
    return kept_conversations, kept_messages, feedback.join(lost_messages, "message_id", "left_anti")
