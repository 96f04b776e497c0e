import pytest
from pyspark.sql import functions as F

from chalkline.operators import conversation, prompts


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(
        [(1, 4, "second"), (1, 0, "first"), (2, 1, "only")], "query_id long, rank int, text string"
    )


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(
        [(1, "why {context}?", "s", "6", "Hindi"), (3, "who?", "t", "7", "English")],
        "query_id long, question string, target_subject string, target_class string, language string",
    )


def test_answer_prompts(questions, hits):
    found, missing = prompts.answer_prompts(questions, hits, "Ada").orderBy("query_id").collect()
    system, user = found["messages"]
    assert system["role"] == "system" and system["content"].startswith("You are Ada, ")
    assert user["content"] == "Textbook Context:\nfirst\n\nsecond\n\nStudent Question: why {context}?"
    assert (found["n_hits"], found["error"]) == (2, None)
    assert (missing["n_hits"], missing["messages"]) == (0, None)
    assert missing["error"] == "I couldn't find any information in the Class 7 t textbook for that."


def test_spoken_prompts_as_rows(questions, hits):
    rows = prompts.message_rows(prompts.spoken_prompts(questions, hits)).orderBy("position").collect()
    assert [(r["query_id"], r["role"]) for r in rows] == [(1, "system"), (1, "user")]
    assert "Answer in Hindi." in rows[0]["content"]


def test_quiz_prompts(spark, hits):
    topics = spark.createDataFrame(
        [(1, "tides", "s", "6", "Odd", 4), (2, " ", "s", "6", "Easy", 4), (3, "x", "s", "6", "Hard", 4)],
        "query_id long, topic string, target_subject string, target_class string, difficulty string, num_questions int",
    )
    good, blank, missing = prompts.quiz_prompts(topics, hits).orderBy("query_id").collect()
    system, user = [m["content"] for m in good["messages"]]
    assert prompts.DIFFICULTY_RULES["Medium"] in system and '"options": ["A) First' in system
    assert user.startswith("Topic: tides\nClass: 6\nSubject: s\nDifficulty: Odd\nNumber of questions: 4\n\n")
    assert user.endswith("Generate 4 multiple choice questions as a JSON array.")
    assert blank["error"] == prompts.QUIZ_BLANK_TOPIC and blank["messages"] is None
    assert missing["error"] == "Could not find content about 'x' in Class 6 s textbook."


def test_rag_user_message(spark):
    row = spark.createDataFrame([([" a\n", None, " ", "b"], "q")], "c array<string>, q string")
    out = row.select(prompts.rag_user_message(F.col("c"), F.col("q")).alias("out")).first()["out"]
    assert out == "Context:\na\n\nb\n\nQuestion: q"


@pytest.fixture
def messages(spark):
    return spark.createDataFrame(
        [
            (1, 0, "system", "rule"),
            (1, 1, "user", "u1"),
            (1, 2, "assistant", ""),
            (1, 3, "user", "u2"),
            (1, 4, "assistant", "a2"),
            (1, 5, "user", "u3"),
            (1, 6, "assistant", "later"),
            (1, 7, "user", "  "),
            (2, 0, "assistant", "alone"),
        ],
        "conv_id long, turn long, role string, text string",
    )


def test_history_prompt(messages):
    rows = conversation.history_prompt(messages, "be kind").orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["content"]) for r in rows] == [
        (-1, "system", "be kind"),
        (1, "user", "u1"),
        (3, "user", "u2"),
        (4, "assistant", "a2"),
        (5, "user", "u3"),
    ]


def test_history_of_chosen_turns(spark, messages):
    asked = spark.createDataFrame([(1, 1), (1, 3)], "conv_id long, asked_turn long")
    rows = conversation.history_prompt(messages, "r", asked).orderBy("asked_turn", "turn").collect()
    assert [(r["asked_turn"], r["content"]) for r in rows] == [(1, "r"), (1, "u1"), (3, "r"), (3, "u1"), (3, "u2")]


@pytest.mark.parametrize("turns", [1, 4, 1000])
def test_transcript(messages, turns):
    pairs = conversation.exchanges(messages).filter("reply <> ''")
    parts = conversation.transcript_segments(pairs, "Ada", turns_per_segment=turns)
    text = "\n\n".join(r["text"] for r in parts.orderBy("segment").collect())
    lines = []
    for user, reply in (("u2", "a2"), ("u3", "later")):
        lines += [f"> **Student:** {user}", f"**Ada:** {reply}", ""]
    assert text == "\n\n".join(lines)
    shown = conversation.answered_or(parts, messages, "sample").filter("conv_id = 2").collect()
    assert [(r["n_pairs"], r["text"]) for r in shown] == [(0, "sample")]


def test_fallback(spark):
    def reply(text):
        return '{"choices": [{"message": {"content": "%s"}}]}' % text

    requests = spark.createDataFrame([(n,) for n in range(4)], "request_id long")
    schema = "request_id long, reply string"
    first = spark.createDataFrame([(0, reply("one")), (1, "{}"), (3, None)], schema)
    second = spark.createDataFrame([(0, reply("two")), (1, reply("two")), (2, reply("two"))], schema)
    rows = conversation.with_fallback(requests, first, second, ("m1", "m2")).orderBy("request_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "one", "m1", None),
        (1, "two", "m2", None),
        (2, "two", "m2", None),
        (3, None, None, conversation.NO_ANSWER),
    ]


def test_reply_fields(spark):
    row = spark.createDataFrame([('{"choices": [{"message": {"content": " x "}}]}',), ("{}",), (None,)], "r string")
    rows = row.select(*[c.alias(n) for n, c in conversation.reply_fields(F.col("r")).items()]).collect()
    assert [tuple(r) for r in rows] == [("x", None), (None, "unexpected reply: {}"), (None, "unexpected reply: null")]
