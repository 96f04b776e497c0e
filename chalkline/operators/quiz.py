"""Quiz replies to questions, grades and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.binding import let
from chalkline.functions.text import strip
from chalkline.schemas import QUESTION

# Number of options, error texts and the text for a missing answer.
OPTIONS = 4
PARSE_ERROR = "Failed to parse quiz questions. Please try again."
OTHER_ERROR = "Error generating quiz: "
NO_ARRAY = "No JSON array found in response"
MISSING_FIELDS = " is missing required fields"
WRONG_OPTIONS = " does not have exactly 4 options"
NOT_ANSWERED = "Not answered"

# JSON as a strict reader takes it.
_STRICT = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false"}


def json_slice(reply: Column) -> Column:
    """From the first ``[`` to the last ``]``; null when either is missing, empty when they are
    the wrong way round."""
    first = F.instr(reply, "[")
    from_end = F.instr(F.reverse(reply), "]")
    length = F.length(reply) - from_end + 2 - first
    return F.when((first > 0) & (from_end > 0), F.substr(reply, first, F.greatest(length, F.lit(0))))


def _elements(text: Column) -> Column:
    """Raw elements of a JSON array; null when the text is not one.

    The text is read inside one more array: whatever follows a complete array then breaks the
    outer one or adds a second element.
    """
    outer = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", _STRICT)
    return let(outer, lambda arrays: F.when(F.size(arrays) == 1, F.get(arrays, F.lit(0))))


def parse_questions(text: Column) -> Column:
    """Questions of a JSON array; null when the text is not one. An element that is no question
    comes out with null fields."""
    return F.transform(_elements(text), lambda element: F.from_json(element, QUESTION, _STRICT))


def _lacks_fields(question: Column) -> Column:
    needed = [question["question"], question["options"], question["correct_answer"]]
    missing = F.lit(False)
    for field in needed:
        missing = missing | field.isNull()
    return F.coalesce(missing, F.lit(True))


def _first_fault(questions: Column) -> Column:
    """Text about the first question that is not valid; null when all are."""

    def fault(question: Column, at: Column) -> Column:
        number = F.concat(F.lit("Question "), (at + 1).cast("string"))
        return F.when(_lacks_fields(question), F.concat(number, F.lit(MISSING_FIELDS))).when(
            F.size(question["options"]) != OPTIONS, F.concat(number, F.lit(WRONG_OPTIONS))
        )

    faults = F.transform(questions, fault)
    return F.get(F.filter(faults, lambda text: text.isNotNull()), F.lit(0))


def _outcome(text: Column, questions: Column, fault: Column) -> Column:
    error = (
        F.when(text.isNull(), OTHER_ERROR + NO_ARRAY)
        .when(questions.isNull(), PARSE_ERROR)
        .when(fault.isNotNull(), F.concat(F.lit(OTHER_ERROR), fault))
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), questions).alias("questions"))


def read_quizzes(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``success``, ``error`` and ``questions``; a faulty reply gives an error, not a failure.

    One faulty question fails its whole quiz. An empty array is a valid quiz without questions.
    """
    outcome = let(
        json_slice(F.col(reply)),
        lambda text: let(
            parse_questions(text),
            lambda questions: let(
                _first_fault(questions), lambda fault: _outcome(text, questions, fault)
            ),
        ),
    )
    return (
        replies.withColumn("_outcome", outcome)
        .withColumns({"error": F.col("_outcome.error"), "questions": F.col("_outcome.questions")})
        .withColumn("success", F.col("error").isNull())
        .drop("_outcome")
    )


def question_rows(quizzes: DataFrame) -> DataFrame:
    """One row per question of the valid quizzes; ``q_idx`` counts from 0.

    Only valid quizzes have questions. An expression, unlike a bare column, is not filtered ahead of
    the generator, which would parse every reply again.
    """
    questions = F.when(F.col("questions").isNotNull(), F.col("questions"))
    return quizzes.select("quiz_id", F.posexplode(questions).alias("q_idx", "q")).select(
        "quiz_id",
        "q_idx",
        "q.question",
        "q.options",
        "q.correct_answer",
        F.coalesce("q.explanation", F.lit("")).alias("explanation"),
    )


def option_rows(questions: DataFrame) -> DataFrame:
    """One row per option, with its letter, as a quiz is shown."""
    return questions.select(
        "quiz_id", "q_idx", "question", F.posexplode("options").alias("o_idx", "option")
    ).select(
        "quiz_id",
        (F.col("q_idx") + 1).alias("question_num"),
        "question",
        "o_idx",
        F.substring("option", 1, 1).alias("letter"),
        "option",
    )


def answer_key(questions: DataFrame) -> DataFrame:
    return questions.select(
        "quiz_id", (F.col("q_idx") + 1).alias("question_num"), "question", "correct_answer", "explanation"
    )



def _mark(answer: Column) -> Column:
    return F.upper(strip(F.coalesce(answer, F.lit(""))))


def grade(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question: the given answer against the right one, both stripped and upper case.

    ``answers`` has ``quiz_id, q_idx, answer``. Both sides are keyed by question, so the join
    spreads evenly however long a quiz is.
    """
    given, right = _mark(F.col("answer")), _mark(F.col("correct_answer"))
    return questions.join(answers, ["quiz_id", "q_idx"], "left").select(
        "quiz_id",
        (F.col("q_idx") + 1).alias("question_num"),
        "question",
        F.when(given == "", NOT_ANSWERED).otherwise(given).alias("user_answer"),
        right.alias("correct_answer"),
        (given == right).alias("is_correct"),
        "explanation",
    )


def score(quizzes: DataFrame, grades: DataFrame) -> DataFrame:
    """One row per valid quiz; the score of a quiz without questions is null."""
    counts = grades.groupBy("quiz_id").agg(
        F.count_if("is_correct").alias("correct_count"), F.count("*").alias("total_questions")
    )
    right, total = F.col("correct_count"), F.col("total_questions")
    return (
        quizzes.filter("success")
        .select("quiz_id")
        .join(counts, "quiz_id", "left")
        .select(
            "quiz_id",
            F.coalesce(right, F.lit(0)).cast("int").alias("correct_count"),
            F.coalesce(total, F.lit(0)).cast("int").alias("total_questions"),
            (right / total * 100).alias("score"),
        )
    )
