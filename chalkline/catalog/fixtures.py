"""The library's input tables, derived from whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.filename import filename_fields
from chalkline.operators.ingest import clean_pages
from chalkline.schemas import RAW_PAGES
from chalkline.session import checkpoint_root


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one page of a textbook file."""
    subject = (
        F.when(F.col("lang") == "en", "social_science")
        .when(F.col("lang") == "fr", "science")
        .otherwise("english")
    )
    filename = F.format_string(
        "class%d_%s_ch%s.pdf",
        F.col("doc_id") % 4 + 5,
        subject,
        F.regexp_extract("source", "[0-9]+", 0),
    )
    return table(spark, folder, "documents").select(
        filename.alias("filename"),
        (F.col("doc_id") + 1).cast("int").alias("page_num"),
        F.col("text").alias("page_text"),
    )


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    files = page_files(spark, folder)
    return files.withColumns(filename_fields(F.col("filename"))).select(*RAW_PAGES.fieldNames())


def cleaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    return clean_pages(raw_pages(spark, folder))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("faiss_id"), "embedding")


def corpus_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A chunk row for each vector whose id is also a document's; the other vectors have none."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    return (
        table(spark, folder, "embeddings")
        .drop("embedding")
        .join(documents, "vec_id")
        .select(
            F.col("vec_id").alias("faiss_id"),
            F.concat(F.lit("k"), "vec_id").alias("chunk_id"),
            "text",
            F.concat(F.lit("s"), "label").alias("subject"),
            (F.col("vec_id") % 4 + 5).cast("string").alias("class"),
            F.regexp_extract("source", "[0-9]+", 0).alias("chapter"),
        )
    )


def label_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per label and class: the mean of all their vectors, with varied targets.

    The few rows are checkpointed, so that a query that names them often reads the vectors once.
    """
    checkpoint_root(spark)
    label, class_ = F.col("label"), F.col("class")
    means = (
        table(spark, folder, "embeddings")
        .select(label, (F.col("vec_id") % 4 + 5).alias("class"), F.posexplode("embedding").alias("axis", "x"))
        .groupBy("label", "class", "axis")
        .agg(F.avg(F.col("x").cast("double")).cast("float").alias("x"))
        .groupBy("label", "class")
        .agg(F.sort_array(F.collect_list(F.struct("axis", "x"))).alias("parts"))
    )
    subject = F.when(label % 3 == 0, "All").when(label % 3 == 1, F.concat(F.lit("S"), label))
    wanted = F.when(class_ == 5, None).when(class_ == 6, "").otherwise(class_.cast("string"))
    return means.select(
        (label * 10 + class_).alias("query_id"),
        F.concat(F.lit("Which passages belong to label "), label, F.lit("?")).alias("question"),
        F.transform("parts", lambda part: part.x).alias("embedding"),
        subject.otherwise(F.concat(F.lit("s"), label)).alias("target_subject"),
        wanted.alias("target_class"),
    ).checkpoint()


def text_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item as a question to the textbook library."""
    item = F.col("item_id")
    return table(spark, folder, "benchmark").select(
        item.alias("query_id"),
        F.col("text").alias("question"),
        F.when(item % 3 == 0, "All").when(item % 3 == 1, "Social").otherwise("english").alias("target_subject"),
        F.when(item % 2 == 0, "All").otherwise((item % 4 + 5).cast("string")).alias("target_class"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def _reply_json(content: Column) -> Column:
    choice = F.struct(F.struct(content.alias("content")).alias("message"))
    return F.to_json(F.struct(F.array(choice).alias("choices")))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Every assistant turn as a chat reply. Some think first; some have another shape."""
    number = F.col("conv_id") + F.col("turn")
    thought = F.concat(F.lit("<think> about\n"), "role", F.lit(" </think>\n\n"))
    content = F.when(number % 3 == 0, F.concat(thought, "text", thought)).otherwise(F.col("text"))
    return (
        messages(spark, folder)
        .filter(F.col("role") == "assistant")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
            F.when(number % 5 == 0, F.lit('{"error": "busy"}')).otherwise(_reply_json(content)).alias("reply"),
        )
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return replies(spark, folder).select("request_id")


def second_replies(spark: SparkSession, folder: str) -> DataFrame:
    """What a second model says to every third request; none is made for the others."""
    return requests(spark, folder).select(
        "request_id",
        F.when(
            F.col("request_id") % 3 == 0,
            _reply_json(F.concat(F.lit("second answer to "), F.col("request_id").cast("string"))),
        ).alias("reply"),
    )


def quiz_replies(spark: SparkSession, folder: str) -> DataFrame:
    """A quiz reply about every benchmark item; the kinds of fault go round by item."""
    item, text = F.col("item_id"), F.col("text")
    letters = F.array(*[F.lit(letter) for letter in "ABCD"])

    def options(at: Column) -> Column:
        return F.transform(
            letters, lambda letter, i: F.concat(letter, F.lit(") choice "), (item + at + i).cast("string"))
        )

    def question(at: Column, kept_options: Column) -> Column:
        return F.struct(
            F.concat((at + 1).cast("string"), F.lit(". "), text).alias("question"),
            kept_options.alias("options"),
            F.concat(F.lit(" "), F.lower(F.get(letters, ((item + at) % 4).cast("int")))).alias("correct_answer"),
            F.when(item % 11 != 6, F.concat(F.lit("because of item "), item.cast("string"))).alias("explanation"),
        )

    numbers = F.sequence(F.lit(0), (item % 4).cast("int"))
    good = F.to_json(F.transform(numbers, lambda at: question(at, options(at))))
    short = F.to_json(F.transform(numbers, lambda at: question(at, F.slice(options(at), 1, 3))))
    kind = item % 11
    array = (
        F.when(kind == 0, "no quiz today")
        .when(kind == 1, '[{"question": "open"]')
        .when(kind == 2, "] turned round [")
        .when(kind == 3, "[]")
        .when(kind == 4, short)
        .when(kind == 5, '[{"question": "q", "options": "ABCD", "correct_answer": "A"}]')
        .when(kind == 7, "[1]")
        .when(kind == 8, F.concat(good, F.lit(" and [2]")))
        .otherwise(good)
    )
    return table(spark, folder, "benchmark").select(
        item.alias("quiz_id"),
        F.concat(F.lit("Here is your quiz:\n"), array, F.lit("\nGood luck!")).alias("reply"),
    )


def quiz_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the first questions of each quiz: right, padded, wrong, or null."""
    item, at = F.col("quiz_id"), F.col("q_idx")
    letters = F.array(*[F.lit(letter) for letter in "ABCD"])
    right = F.get(letters, ((item + at) % 4).cast("int"))
    given = (
        F.when((item + at) % 5 == 1, F.concat(F.lit("  "), F.lower(right), F.lit("\n")))
        .when((item + at) % 5 == 2, F.lit("Z"))
        .when((item + at) % 5 != 0, right)
    )
    answered = F.explode(F.sequence(F.lit(0), (F.col("item_id") % 3).cast("int")))
    return (
        table(spark, folder, "benchmark")
        .select(F.col("item_id").alias("quiz_id"), answered.alias("q_idx"))
        .withColumn("answer", given)
    )


def quiz_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item as the topic of a quiz; some are blank, some ask for what no book has."""
    item = F.col("query_id")
    levels = F.array(*[F.lit(name) for name in ("Easy", "Medium", "Hard", "Odd")])
    return text_questions(spark, folder).select(
        "query_id",
        F.when(item % 10 == 8, " \n").otherwise(F.col("question")).alias("topic"),
        "target_subject",
        F.when(item % 10 == 6, "12").otherwise(F.col("target_class")).alias("target_class"),
        F.get(levels, (item % 4).cast("int")).alias("difficulty"),
        (item % 7 + 1).cast("int").alias("num_questions"),
    )


def quiz_writer(faulty: bool):
    """Stands for a model: as many questions as a prompt asks for, out of the prompt's own text. A faulty one is
    busy for a fifth of the prompts and says something else for another."""
    request = F.get("messages", F.lit(1))["content"]
    size = F.length(request)
    letters = F.array(*[F.lit(letter) for letter in "ABCD"])
    count = F.regexp_extract(request, "\nNumber of questions: ([0-9]+)\n", 1).cast("int")

    def question(at: Column) -> Column:
        return F.struct(
            F.concat((at + 1).cast("string"), F.lit(". "), F.substr(request, at * 10 + 30, F.lit(20))).alias("question"),
            F.transform(letters, lambda letter, i: F.concat(letter, F.lit(") "), F.substr(request, at + i * 7 + 40, F.lit(5)))).alias("options"),
            F.get(letters, (size + at) % 4).alias("correct_answer"),
        )

    good = _reply_json(F.concat(F.lit("Here:\n"), F.to_json(F.transform(F.sequence(F.lit(0), count - 1), question))))
    busy, other = F.lit('{"error": "busy"}'), _reply_json(F.lit("no quiz today"))
    reply = F.when(size % 5 == 0, busy).when(size % 5 == 1, other).otherwise(good) if faulty else good
    return lambda prompts: prompts.select("digest", reply.alias("reply"))


def letter_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One letter, in turn, for the first seven questions of every item's quiz; every third is left out."""
    letter = F.get(F.array(*[F.lit(x) for x in "abcd"]), ((F.col("quiz_id") + F.col("q_idx")) % 4).cast("int"))
    return (
        table(spark, folder, "benchmark")
        .select(F.col("item_id").alias("quiz_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("q_idx"))
        .withColumn("answer", F.when(F.col("q_idx") % 3 != 2, letter))
    )


# A word in each script the language detection knows, one in a script it does not know, and none.
SCRIPT_WORDS = ["नमस्ते", "வணக்கம்", "నమస్కారం", "ನಮಸ್ಕಾರ", "നമസ്കാരം", "নমস্কার", "привет", ""]
