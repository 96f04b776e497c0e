"""Conversations: prompts with history, transcripts, and replies with a fallback.

A conversation may be of any length, so it is never gathered into one row: prompts come as message
rows in order, transcripts in segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.responses import chat_content
from chalkline.functions.text import is_blank, strip

TURNS_PER_SEGMENT = 1024
NO_ANSWER = "no model answered"


def pending_turns(messages: DataFrame) -> DataFrame:
    """The last user turn of each conversation that is not blank: the one to be answered."""
    asked = messages.filter((F.col("role") == "user") & ~is_blank(F.col("text")))
    return asked.groupBy("conv_id").agg(F.max("turn").alias("asked_turn"))


def history_prompt(messages: DataFrame, system_prompt: str, asked: DataFrame | None = None) -> DataFrame:
    """Prompt rows ``conv_id, asked_turn, turn, role, content``, to be read in turn order.

    System rule first (turn -1), then what was said before the asked turn, and last the asked turn
    itself. Assistant turns count only when they are not empty; system turns of the conversation
    are replaced by the rule. ``asked`` may name other turns than the pending ones; a conversation
    may be asked about at several turns, and each prompt has its own rows.
    """
    asked = pending_turns(messages) if asked is None else asked
    spoken = messages.filter(
        (F.col("role") == "user")
        | ((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != ""))
    )
    said = spoken.join(asked, "conv_id").filter(
        (F.col("turn") < F.col("asked_turn"))
        | ((F.col("turn") == F.col("asked_turn")) & (F.col("role") == "user"))
    )
    rule = asked.select(
        "conv_id",
        "asked_turn",
        F.lit(-1).cast("long").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(system_prompt).alias("content"),
    )
    return rule.unionByName(
        said.select("conv_id", "asked_turn", "turn", "role", F.col("text").alias("content"))
    )


def exchanges(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, user_text, reply``: each user turn and the assistant turn right after it.

    The join key is unique on both sides, so a long conversation spreads over all tasks.
    """
    replies = messages.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    users = messages.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user_text")
    )
    return users.join(replies, ["conv_id", "turn"])


def transcript_segments(
    pairs: DataFrame,
    tutor: str,
    student: str = "Student",
    turns_per_segment: int = TURNS_PER_SEGMENT,
) -> DataFrame:
    """Transcript text per conversation and segment of turns; a null text is an empty line's text.

    Every pair is a quoted student line, a tutor line and an empty line, joined by blank lines; the
    segments of a conversation, in order, are joined the same way.
    """
    lines = F.concat(
        F.lit(f"> **{student}:** "),
        F.coalesce("user_text", F.lit("")),
        F.lit(f"\n\n**{tutor}:** "),
        F.coalesce("reply", F.lit("")),
        F.lit("\n\n"),
    )
    segment = F.floor(F.col("turn") / turns_per_segment).cast("long")
    in_order = F.sort_array(F.collect_list(F.struct("turn", lines.alias("lines"))))
    return (
        pairs.groupBy("conv_id", segment.alias("segment"))
        .agg(in_order.alias("pairs"))
        .select(
            "conv_id",
            "segment",
            F.size("pairs").alias("n_pairs"),
            F.array_join(F.transform("pairs", lambda pair: pair.lines), "\n\n").alias("text"),
        )
    )


def answered_or(transcript: DataFrame, conversations: DataFrame, sample: str) -> DataFrame:
    """The transcripts, and the sample text for each conversation without any exchange."""
    bare = (
        conversations.select("conv_id")
        .distinct()
        .join(transcript.select("conv_id").distinct(), "conv_id", "left_anti")
    )
    return transcript.unionByName(
        bare.select(
            "conv_id",
            F.lit(0).cast("long").alias("segment"),
            F.lit(0).alias("n_pairs"),
            F.lit(sample).alias("text"),
        )
    )


def with_fallback(
    requests: DataFrame, primary: DataFrame, secondary: DataFrame, names: tuple[str, str]
) -> DataFrame:
    """First model's answer, else the second's, and which of them answered.

    ``primary`` and ``secondary`` carry ``request_id, reply`` (JSON). A reply of another shape, or
    none at all, counts as a failure; when both fail, ``error`` says so.
    """

    def answers(replies: DataFrame, name: str) -> DataFrame:
        return replies.select("request_id", chat_content(F.col("reply")).alias(name))

    first, second = F.col("_first"), F.col("_second")
    model = F.when(first.isNotNull(), names[0]).when(second.isNotNull(), names[1])
    return (
        requests.join(answers(primary, "_first"), "request_id", "left")
        .join(answers(secondary, "_second"), "request_id", "left")
        .withColumns(
            {
                "answer": F.coalesce(first, second),
                "model": model,
                "error": F.when(model.isNull(), NO_ANSWER),
            }
        )
        .drop("_first", "_second")
    )


def reply_fields(reply: Column) -> dict[str, Column]:
    """Stripped content of a chat reply, or an error text where the reply has another shape."""
    content = strip(chat_content(reply))
    return {
        "content": content,
        "error": F.when(content.isNull(), F.concat(F.lit("unexpected reply: "), F.coalesce(reply, F.lit("null")))),
    }
