"""Prompt tables for questions and quizzes.

The name of the tutor is a parameter. Prompts come as ``messages``, an array of role and content;
a question gathers at most k chunks, so the array is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import is_blank, strip

TUTOR = "the class tutor"

# Prompt texts. {tutor} and the other names in braces are filled in.
ANSWER_RULE = (
    "You are {tutor}, a helpful Indian school tutor. "
    "Answer the student's question using ONLY the provided textbook context. "
    "If the answer isn't in the context, say so clearly."
)
ANSWER_REQUEST = "Textbook Context:\n{context}\n\nStudent Question: {question}"
ANSWER_NOT_FOUND = (
    "I couldn't find any information in the Class {class} {subject} textbook for that."
)
SPOKEN_RULE = (
    "You are {tutor}, a helpful Indian school tutor. "
    "Answer in {language}. Use ONLY the provided textbook context. "
    "If not found, say you don't know."
)
SPOKEN_REQUEST = "Context:\n{context}\n\nQuestion: {question}"
SPOKEN_NOT_FOUND = "No relevant textbook content found."
CHAT_RULE = (
    "You are {tutor}, a friendly, encouraging, and highly accurate educational tutor for Indian "
    "school students.\n"
    "Respond in the SAME language the user speaks (Hindi, English, Tamil, Telugu, Hinglish etc.).\n"
    "Be concise but highly instructive (3-4 sentences max for voice-friendly responses).\n"
    "Help with: explaining textbook concepts (Science, Math, History, Geography), answering "
    "curriculum questions, and providing study tips.\n"
    "Break down complex topics into simple, easy-to-understand parts. Do not just give the answer; "
    "explain the 'why'."
)
CHAT_SAMPLE = (
    "*Start learning! Try asking a question in Hindi, English, Tamil, or any Indian language.*\n\n"
    "**Example queries:**\n"
    '- "Explain the process of photosynthesis."\n'
    '- "What were the main causes of the 1857 revolt?"\n'
    '- "Solve this: If a car travels 60km in 2 hours, what is its speed?"\n'
)
DIFFICULTY_RULES = {
    "Easy": "Create straightforward questions that test basic understanding and recall of key facts.",
    "Medium": "Create questions that require understanding of concepts and ability to apply knowledge.",
    "Hard": (
        "Create challenging questions that require critical thinking, analysis, and synthesis of "
        "information."
    ),
}
DEFAULT_DIFFICULTY = "Medium"
QUIZ_RULE = (
    "You are an expert teacher creating quiz questions for Indian school students. "
    "Generate ONLY multiple choice questions (MCQs) based on the provided textbook content. "
    "{difficulty_rule}\n\n"
    "IMPORTANT: Return your response as a valid JSON array with this EXACT structure:\n"
    "[\n"
    "  {\n"
    '    "question": "Question text here?",\n'
    '    "options": ["A) First option", "B) Second option", "C) Third option", "D) Fourth option"],\n'
    '    "correct_answer": "A",\n'
    '    "explanation": "Brief explanation of why this is correct"\n'
    "  }\n"
    "]\n\n"
    "Rules:\n"
    "- Return ONLY the JSON array, no other text\n"
    "- Each question must have exactly 4 options labeled A, B, C, D\n"
    "- The correct_answer must be ONLY the letter (A, B, C, or D)\n"
    "- All questions must be based on the provided textbook content\n"
    "- Make questions age-appropriate and clear"
)
QUIZ_REQUEST = (
    "Topic: {topic}\n"
    "Class: {class}\n"
    "Subject: {subject}\n"
    "Difficulty: {difficulty}\n"
    "Number of questions: {num_questions}\n\n"
    "Textbook Content:\n{context}\n\n"
    "Generate {num_questions} multiple choice questions as a JSON array."
)
QUIZ_NOT_FOUND = "Could not find content about '{topic}' in Class {class} {subject} textbook."
QUIZ_BLANK_TOPIC = "Please enter a topic for the quiz."


def fill(template: str, **values: Column | str) -> Column:
    """The template with each ``{name}`` replaced by its value, null by nothing; other braces stay."""
    parts: list[Column | str] = [template]
    for name, value in values.items():
        mark = "{" + name + "}"
        parts = [
            piece
            for part in parts
            for piece in (_interleave(part.split(mark), value) if isinstance(part, str) else [part])
        ]
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _interleave(texts: list[str], value: Column | str) -> list[Column | str]:
    filler = F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))
    out: list[Column | str] = [texts[0]]
    for text in texts[1:]:
        out += [filler, text]
    return out


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def contexts(hits: DataFrame) -> DataFrame:
    """``query_id, n_hits, context``: hit texts in rank order, joined by a blank line."""
    in_order = F.sort_array(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))
    return (
        hits.groupBy("query_id")
        .agg(in_order.alias("hits"))
        .select(
            "query_id",
            F.size("hits").alias("n_hits"),
            F.array_join(F.transform("hits", lambda hit: hit.text), "\n\n").alias("context"),
        )
    )


def _with_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Every question with its context; ``n_hits`` is 0 where nothing was found."""
    return questions.join(contexts(hits), "query_id", "left").withColumn(
        "n_hits", F.coalesce("n_hits", F.lit(0))
    )


def _prompt(found: DataFrame, rule: Column, request: Column, failure: Column) -> DataFrame:
    """Adds ``messages`` where there is no ``error``."""
    return (
        found.withColumn("error", failure)
        .withColumn(
            "messages",
            F.when(F.col("error").isNull(), F.array(message("system", rule), message("user", request))),
        )
        .drop("context")
    )


def answer_prompts(questions: DataFrame, hits: DataFrame, tutor: str = TUTOR) -> DataFrame:
    """Two-message prompts; ``questions`` has ``query_id, question, target_subject, target_class``.

    A question without hits gets the not-found text as ``error`` and no messages.
    """
    not_found = fill(
        ANSWER_NOT_FOUND, **{"class": F.col("target_class"), "subject": F.col("target_subject")}
    )
    return _prompt(
        _with_context(questions, hits),
        F.lit(ANSWER_RULE.replace("{tutor}", tutor)),
        fill(ANSWER_REQUEST, context=F.col("context"), question=F.col("question")),
        F.when(F.col("n_hits") == 0, not_found),
    )


def spoken_prompts(questions: DataFrame, hits: DataFrame, tutor: str = TUTOR) -> DataFrame:
    """As :func:`answer_prompts`, answered in the question's ``language``."""
    return _prompt(
        _with_context(questions, hits),
        fill(SPOKEN_RULE.replace("{tutor}", tutor), language=F.col("language")),
        fill(SPOKEN_REQUEST, context=F.col("context"), question=F.col("question")),
        F.when(F.col("n_hits") == 0, SPOKEN_NOT_FOUND),
    )


def quiz_prompts(topics: DataFrame, hits: DataFrame) -> DataFrame:
    """Quiz prompts; ``topics`` has ``query_id, topic, target_subject, target_class, difficulty,
    num_questions``. A blank topic, or one without hits, gets an ``error``."""
    rules = F.create_map(*[F.lit(part) for pair in DIFFICULTY_RULES.items() for part in pair])
    rule = F.coalesce(
        F.try_element_at(rules, F.col("difficulty")), F.lit(DIFFICULTY_RULES[DEFAULT_DIFFICULTY])
    )
    about = {
        "topic": F.col("topic"),
        "class": F.col("target_class"),
        "subject": F.col("target_subject"),
    }
    failure = F.when(is_blank(F.col("topic")), QUIZ_BLANK_TOPIC).when(
        F.col("n_hits") == 0, fill(QUIZ_NOT_FOUND, **about)
    )
    return _prompt(
        _with_context(topics, hits),
        fill(QUIZ_RULE, difficulty_rule=rule),
        fill(
            QUIZ_REQUEST,
            **about,
            difficulty=F.coalesce(F.col("difficulty"), F.lit(DEFAULT_DIFFICULTY)),
            num_questions=F.col("num_questions"),
            context=F.col("context"),
        ),
        failure,
    )


def rag_user_message(context_chunks: Column, question: Column) -> Column:
    """Context and question in one text; chunks are stripped, and null or blank ones left out."""
    kept = F.filter(F.transform(context_chunks, strip), lambda chunk: chunk != "")
    return fill(SPOKEN_REQUEST, context=F.array_join(kept, "\n\n"), question=question)


def message_rows(prompts: DataFrame) -> DataFrame:
    """One row per message: ``query_id, position, role, content``; none for a question with an error."""
    # An expression, unlike a bare column, is not filtered ahead of the generator and so built once.
    messages = F.when(F.col("messages").isNotNull(), F.col("messages"))
    return prompts.select("query_id", F.posexplode(messages).alias("position", "message")).select(
        "query_id", "position", "message.role", "message.content"
    )
