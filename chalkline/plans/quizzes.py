"""Quizzes over a library: topics to prompts, replies to stored quizzes, answers to scores.

A folder holds the prompts of the last run, every reply a model ever gave by the digest of its prompt, and the quizzes and
questions read from them. A prompt whose stored reply is a valid quiz is never sent again, whatever topic it belongs to;
one without, also after a run that broke off, is sent in the next run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.responses import chat_content
from chalkline.functions.text import is_blank
from chalkline.operators.embedding import HashedWords, ModelFactory
from chalkline.operators.prompts import quiz_prompts
from chalkline.operators.quiz import OTHER_ERROR, grade, question_rows, read_quizzes, score
from chalkline.operators.retrieval import QUIZ_K
from chalkline.plans.library import Library, search_library
from chalkline.sources.tables import write_if_absent, write_table

NO_REPLY = "the model gave no reply"

#: ``digest, messages``, one row per prompt, to ``digest, reply``: a chat reply as JSON text, or null.
Chat = Callable[[DataFrame], DataFrame]

_REPLIES = "digest binary, reply string"


@dataclass(frozen=True)
class QuizBook:
    """The tables of one set of quizzes below a folder."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def prompts(self) -> DataFrame:
        return self.spark.read.parquet(self.path("prompts"))

    def replies(self) -> DataFrame:
        """Every reply of every run; a prompt that was sent more than once has more than one."""
        return self.spark.read.schema(_REPLIES).parquet(self.path("replies"))

    def quizzes(self) -> DataFrame:
        return self.spark.read.parquet(self.path("quizzes"))

    def questions(self) -> DataFrame:
        return self.spark.read.parquet(self.path("questions"))


def topic_prompts(library: Library, topics: DataFrame, factory: ModelFactory = HashedWords, k: int = QUIZ_K) -> DataFrame:
    """Quiz prompts of ``query_id, topic, target_subject, target_class, difficulty, num_questions``, each on its best k
    chunks. A blank topic is not searched for; it and one without hits get an ``error`` and no messages."""
    asked = topics.where(~is_blank(F.col("topic"))).withColumnRenamed("topic", "question")
    return quiz_prompts(topics, search_library(library, asked, k, factory))


def _outcomes(replies: DataFrame) -> DataFrame:
    """``digest, n_asked, success, error, questions``: the outcome of each prompt's best reply.

    A valid quiz is better than none; of several, and of several failures, the greatest text is taken, so that the
    choice does not depend on the order of rows.
    """
    read = read_quizzes(replies.withColumn("content", chat_content(F.col("reply"))), "content")
    error = F.when(F.col("content").isNull(), OTHER_ERROR + NO_REPLY).otherwise(F.col("error"))
    best = F.max_by(F.struct("success", "error", "questions"), F.struct("success", "reply"))
    found = read.withColumn("error", error).groupBy("digest").agg(F.count("*").alias("n_asked"), best.alias("best"))
    return found.select("digest", "n_asked", "best.*")


def make_quizzes(prompts: DataFrame, folder: str, chat: Chat) -> QuizBook:
    """The quizzes of ``prompts`` (as ``topic_prompts`` gives them) below ``folder``; see ``complete_quizzes``."""
    book = QuizBook(prompts.sparkSession, folder)
    digest = F.when(F.col("messages").isNotNull(), F.unhex(F.sha2(F.to_json("messages"), 256)))
    write_table(prompts.withColumn("digest", digest), book.path("prompts"))
    write_if_absent(book.spark.createDataFrame([], _REPLIES), book.path("replies"))
    return complete_quizzes(book, chat)


def complete_quizzes(book: QuizBook, chat: Chat) -> QuizBook:
    """Sends the stored prompts that have no valid quiz yet, and reads all replies.

    ``quizzes`` has a row per prompt, with ``quiz_id`` for its ``query_id``: its columns but the messages, how often it was
    sent, ``success``, ``error`` and ``n_questions``. ``questions`` has a row per question of the valid ones. Replies are
    written before any is read, so a model is asked once per prompt and run, unless a task is run again.
    """
    prompts = book.prompts()
    settled = _outcomes(book.replies()).where("success").select("digest")
    unsettled = prompts.where(F.col("digest").isNotNull()).join(settled, "digest", "left_anti")
    once = unsettled.groupBy("digest").agg(F.first("messages").alias("messages"))  # equal digests, equal messages
    write_table(chat(once).select("digest", "reply"), book.path("replies"), mode="append")

    outcomes = _outcomes(book.replies()).withColumnsRenamed({"error": "fault", "success": "valid"})
    unanswered = F.when(F.col("valid").isNull(), OTHER_ERROR + NO_REPLY)
    read = (
        prompts.withColumnRenamed("query_id", "quiz_id")
        .drop("messages")
        .join(outcomes, "digest", "left")
        .withColumn("n_asked", F.coalesce("n_asked", F.lit(0)))
        .withColumn("success", F.coalesce("valid", F.lit(False)))
        .withColumn("error", F.coalesce("error", "fault", unanswered))
        .withColumn("n_questions", F.coalesce(F.array_size("questions"), F.lit(0)))
        .drop("digest", "fault", "valid")
    )
    write_table(read, book.path("read"))
    read = book.spark.read.parquet(book.path("read"))
    write_table(question_rows(read), book.path("questions"))
    write_table(read.drop("questions"), book.path("quizzes"))
    return book


def quiz_report(book: QuizBook, answers: DataFrame) -> DataFrame:
    """One row per valid quiz: what it is about and how its answers ``quiz_id, q_idx, answer`` score."""
    scores = score(book.quizzes(), grade(book.questions(), answers))
    about = book.quizzes().select("quiz_id", "topic", "target_subject", "target_class", "difficulty")
    return scores.join(about, "quiz_id")
