import json

import pytest
from pyspark.sql import functions as F

from chalkline.operators import prompts, quiz
from chalkline.plans import quizzes
from chalkline.plans.library import build_library
from chalkline.schemas import RAW_PAGES

TOPICS = "query_id long, topic string, target_subject string, target_class string, difficulty string, num_questions int"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    texts = {"1": "Green leaves make sugar from light.", "2": "Magnets have a north pole and a south pole."}
    rows = [(f"class6_science_ch{n}.pdf", "6", "science", n, 1, text) for n, text in texts.items()]
    return build_library(spark.createDataFrame(rows, RAW_PAGES), str(tmp_path_factory.mktemp("library")))


def topics(spark, *rows):
    return spark.createDataFrame([(n, topic, "science", class_, "Easy", 2) for n, topic, class_ in rows], TOPICS)


def reply(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def questions(*answers):
    options = ["A) a", "B) b", "C) c", "D) d"]
    return json.dumps([{"question": f"q{n}", "options": options, "correct_answer": a} for n, a in enumerate(answers)])


class Model:
    """Gives one reply to all prompts whose request holds a word, and counts what it is asked."""

    def __init__(self, **replies):
        self.replies, self.asked = replies, []

    def __call__(self, sent):
        request = F.get("messages", F.lit(1))["content"]
        self.asked.append(sorted(r[0] for r in sent.select(F.regexp_extract(request, "^Topic: (.*)", 1)).collect()))
        given = F.lit(None).cast("string")
        for word, text in self.replies.items():
            given = F.when(request.startswith(f"Topic: {word}"), F.lit(text)).otherwise(given)
        return sent.select("digest", given.alias("reply"))


def outcomes(book):
    return {r["quiz_id"]: (r["success"], r["error"], r["n_asked"], r["n_questions"]) for r in book.quizzes().collect()}


def test_a_prompt_is_sent_until_its_quiz_is_valid(spark, library, tmp_path):
    asked = topics(
        spark, (1, "leaves", "6"), (2, "magnets", "6"), (3, " \n", "6"), (4, "leaves", "9"), (5, "poles", "6"), (6, "leaves", "6"), (7, None, "6")
    )
    found = quizzes.topic_prompts(library, asked)
    first = Model(leaves=reply(questions("A", "b")), magnets=reply("sorry"), poles='{"error": "busy"}')
    book = quizzes.make_quizzes(found, str(tmp_path / "book"), first)
    # Equal prompts go out once; blank topics and those without hits never.
    assert first.asked == [["leaves", "magnets", "poles"]]
    nothing = "Could not find content about 'leaves' in Class 9 science textbook."
    assert outcomes(book) == {
        1: (True, None, 1, 2),
        2: (False, quiz.OTHER_ERROR + quiz.NO_ARRAY, 1, 0),
        3: (False, prompts.QUIZ_BLANK_TOPIC, 0, 0),
        4: (False, nothing, 0, 0),
        5: (False, quiz.OTHER_ERROR + quizzes.NO_REPLY, 1, 0),
        6: (True, None, 1, 2),
        7: (False, prompts.QUIZ_BLANK_TOPIC, 0, 0),
    }
    second = Model(leaves=reply(questions("D")), magnets=reply(questions("C")))
    quizzes.complete_quizzes(book, second)
    assert second.asked == [["magnets", "poles"]]
    assert outcomes(book)[2] == (True, None, 2, 1) and outcomes(book)[1] == (True, None, 1, 2)
    assert outcomes(book)[5] == (False, quiz.OTHER_ERROR + quizzes.NO_REPLY, 2, 0)
    # A new set of topics takes over what is there.
    third = Model(poles=reply("[]"))
    book = quizzes.make_quizzes(quizzes.topic_prompts(library, topics(spark, (8, "magnets", "6"), (9, "poles", "6"))), book.folder, third)
    assert third.asked == [["poles"]]
    assert outcomes(book) == {8: (True, None, 2, 1), 9: (True, None, 3, 0)}


def test_report_scores_answers(spark, library, tmp_path):
    found = quizzes.topic_prompts(library, topics(spark, (1, "leaves", "6"), (2, "magnets", "6"), (3, "poles", "6")))
    model = Model(leaves=reply(questions("A", "b", "C")), magnets=reply("[]"), poles=reply("none"))
    book = quizzes.make_quizzes(found, str(tmp_path / "book"), model)
    answers = spark.createDataFrame([(1, 0, " a "), (1, 1, "C"), (3, 0, "A")], "quiz_id long, q_idx int, answer string")
    rows = {r["quiz_id"]: r for r in quizzes.quiz_report(book, answers).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1]["correct_count"], rows[1]["total_questions"], round(rows[1]["score"], 3)) == (1, 3, 33.333)
    assert (rows[2]["total_questions"], rows[2]["score"], rows[2]["topic"]) == (0, None, "magnets")


def test_a_run_that_broke_off_before_its_replies_is_taken_up(spark, library, tmp_path):
    found = quizzes.topic_prompts(library, topics(spark, (1, "leaves", "6")))

    def broken(sent):
        raise RuntimeError("no connection")

    with pytest.raises(RuntimeError):
        quizzes.make_quizzes(found, str(tmp_path / "book"), broken)
    book = quizzes.complete_quizzes(quizzes.QuizBook(spark, str(tmp_path / "book")), Model(leaves=reply(questions("A"))))
    assert outcomes(book) == {1: (True, None, 1, 1)}


def test_no_topics(spark, library, tmp_path):
    book = quizzes.make_quizzes(quizzes.topic_prompts(library, topics(spark).limit(0)), str(tmp_path / "book"), Model())
    assert book.quizzes().count() == book.questions().count() == 0
