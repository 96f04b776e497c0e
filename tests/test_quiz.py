import json

import pytest
from pyspark.sql import functions as F

from chalkline.operators import quiz


def question(**changes):
    base = {"question": "q?", "options": ["A) a", "B) b", "C) c", "D) d"], "correct_answer": " b ", "explanation": "e"}
    return {key: val for key, val in (base | changes).items() if val is not ...}


def read(spark, *replies):
    frame = spark.createDataFrame(list(enumerate(replies)), "quiz_id long, reply string")
    return quiz.read_quizzes(frame).orderBy("quiz_id").collect()


OK = json.dumps([question()])


@pytest.mark.parametrize(
    "reply, error",
    [
        (OK, None),
        (f"Here:\n{OK}\nbye", None),
        ("[]", None),
        (json.dumps([question(explanation=...)]), None),
        ("none", "Error generating quiz: No JSON array found in response"),
        ("only [", "Error generating quiz: No JSON array found in response"),
        ("] [", quiz.PARSE_ERROR),
        ("[{", "Error generating quiz: No JSON array found in response"),
        ("[{]", quiz.PARSE_ERROR),
        (OK + OK, quiz.PARSE_ERROR),
        (OK + ', "x": [1]', quiz.PARSE_ERROR),
        ("[{'question': 1}]", quiz.PARSE_ERROR),
        ("[1]", "Error generating quiz: Question 1 is missing required fields"),
        ("[null]", "Error generating quiz: Question 1 is missing required fields"),
        (json.dumps([question(), question(question=...)]), "Error generating quiz: Question 2 is missing required fields"),
        (json.dumps([question(options="ABCD")]), "Error generating quiz: Question 1 is missing required fields"),
        (json.dumps([question(options=["A"]), question(question=...)]), "Error generating quiz: Question 1 does not have exactly 4 options"),
    ],
)
def test_read_quizzes(spark, reply, error):
    (row,) = read(spark, reply)
    assert (row["error"], row["success"]) == (error, error is None)
    assert (row["questions"] is None) == (error is not None)


def test_null_reply(spark):
    assert read(spark, None)[0]["success"] is False


def test_grades_and_scores(spark):
    replies = [json.dumps([question(), question(explanation=...), question(correct_answer="C")]), "[]", "bad"]
    frame = spark.createDataFrame(list(enumerate(replies)), "quiz_id long, reply string")
    quizzes = quiz.read_quizzes(frame)
    questions = quiz.question_rows(quizzes)
    answers = spark.createDataFrame(
        [(0, 0, " B\n"), (0, 2, "a"), (0, 9, "A"), (7, 0, "A")], "quiz_id long, q_idx int, answer string"
    )
    grades = quiz.grade(questions, answers)
    assert [tuple(r) for r in grades.orderBy("question_num").collect()] == [
        (0, 1, "q?", "B", "B", True, "e"),
        (0, 2, "q?", "Not answered", "B", False, ""),
        (0, 3, "q?", "A", "C", False, "e"),
    ]
    scores = quiz.score(quizzes, grades).orderBy("quiz_id").collect()
    assert [tuple(r) for r in scores] == [(0, 1, 3, pytest.approx(100 / 3)), (1, 0, 0, None)]


def test_option_rows_and_answer_key(spark):
    frame = spark.createDataFrame([(5, json.dumps([question(), question()]))], "quiz_id long, reply string")
    questions = quiz.question_rows(quiz.read_quizzes(frame))
    options = quiz.option_rows(questions).orderBy("question_num", "o_idx").collect()
    assert [r["letter"] for r in options] == list("ABCD") * 2
    assert [r["question_num"] for r in quiz.answer_key(questions).orderBy("question_num").collect()] == [1, 2]


@pytest.mark.parametrize("reply, expected", [("a[b]c]d", "[b]c]"), ("] [", ""), ("x", None), ("[é]", "[é]")])
def test_json_slice(spark, reply, expected):
    row = spark.createDataFrame([(reply,)], "x string").select(quiz.json_slice(F.col("x")).alias("out"))
    assert row.first()["out"] == expected
