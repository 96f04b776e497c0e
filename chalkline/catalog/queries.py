"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.catalog import fixtures as fx
from chalkline.functions import language, responses, text, vectors
from chalkline.operators import chunking, conversation, embedding, index, ingest, joins, prompts
from chalkline.operators import quiz, retrieval, search, vector_blocks
from chalkline.plans.incremental import update_library
from chalkline.plans.library import Library, ask, build_library
from chalkline.plans import quizzes as quiz_plan
from chalkline.session import scratch_path, sparing_disk
from chalkline.sources import tables
from chalkline.sources import manifest as manifest_source

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

TUTOR = "Asha"
CREATED_AT = "2024-01-01 00:00:00"


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# Pages and files


@query
def scan_pages(spark, folder):
    path = scratch_path(spark, "raw_pages")
    tables.write_table(fx.raw_pages(spark, folder), path)
    return tables.read_pages(spark, path)


@query
def page_counts(spark, folder):
    return fx.raw_pages(spark, folder).groupBy("class_num", "subject").agg(F.count("*").alias("n_pages"))


@query
def page_preview(spark, folder):
    return fx.raw_pages(spark, folder).orderBy("filename", "page_num").limit(5)


@query
def filename_metadata(spark, folder):
    """Also over shorter names: a file without a subject, and one with a single part."""
    files = fx.page_files(spark, folder).select("page_num", "filename")
    shorter = F.array(
        F.col("filename"),
        F.regexp_replace("filename", "_.*_", "_"),
        F.concat(F.lit("page"), "page_num", F.lit(".pdf")),
    )
    return ingest.with_filename_fields(files.select("page_num", F.explode(shorter).alias("filename")))


@query
def page_clean(spark, folder):
    """Documents set apart with tabs, runs of blanks and empty lines."""
    ragged = F.concat(F.lit(" \t"), F.replace("page_text", F.lit("\n"), F.lit(" \n\n\n\t \n")), F.lit("\n\n"))
    return ingest.clean_pages(fx.raw_pages(spark, folder).withColumn("page_text", ragged))


@query
def page_numbers(spark, folder):
    """Documents as files whose pages are their lines."""
    files = fx.page_files(spark, folder).select("filename", "page_num", F.split("page_text", "\n").alias("pages"))
    return ingest.number_pages(files.withColumnRenamed("page_num", "file_num"))


# Chapters and chunks


@query
def chapter_text(spark, folder):
    return ingest.chapter_segments(fx.cleaned_pages(spark, folder))


@query
def chunk_text(spark, folder):
    return chunking.split_chapters(fx.cleaned_pages(spark, folder))


@query
def chunk_rows(spark, folder):
    return chunking.chunk_table(fx.cleaned_pages(spark, folder))


def _stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "chunks")
    tables.write_chunks(chunking.chunk_table(fx.cleaned_pages(spark, folder)), path)
    return tables.read_chunks(spark, path)


@query
def chunks_partitioned_roundtrip(spark, folder):
    return _stored_chunks(spark, folder)


@query
def scan_chunks_pruned(spark, folder):
    """The class and subject filters reach the folders, so the others are not read."""
    return _stored_chunks(spark, folder).filter("class_num = '6' AND subject = 'social_science'")


# Index


@query
def embeddings_table(spark, folder):
    path = scratch_path(spark, "embeddings")
    given = fx.table(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding"
    )
    tables.write_table(given, path)
    return tables.read_embeddings(spark, path).select("chunk_id", F.posexplode("embedding").alias("axis", "x")).select(
        "chunk_id", "axis", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def index_table(spark, folder):
    return index.index_table(_stored_chunks(spark, folder))


@query
def sanitize_columns(spark, folder):
    events = fx.table(spark, folder, "events")
    value = F.col("value")
    return index.sanitized(
        events.select(
            "event_id",
            "ts",
            "event_type",
            "value",
            (value * 1e6).alias("large"),
            (value * 1e14).alias("huge"),
            (value / 1e6).alias("small"),
            F.when(F.col("event_type") != "error", value).alias("gaps"),
            F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(value).alias("holes"),
            (value > 100).alias("above"),
        )
    )


@query
def alignment_check(spark, folder):
    """Documents as chunks against vectors: some ids are on one side only."""
    chunks = fx.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    found = fx.table(spark, folder, "embeddings").select(
        F.when(F.col("vec_id") % 10 == 9, -F.col("vec_id"))
        .otherwise(F.col("vec_id") - F.col("vec_id") % 50 % 2)
        .cast("string")
        .alias("chunk_id")
    )
    return index.alignment(chunks, found)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return index.manifest(
        fx.table(spark, folder, "embeddings"),
        embedding_model="given",
        catalog="local",
        schema="default",
        source_table="embeddings",
        created_at=F.lit(CREATED_AT).cast("timestamp"),
    )


@query
def manifest(spark, folder):
    return _manifest(spark, folder)


@query
def manifest_read(spark, folder):
    """Written with an unknown field and without the two that have defaults."""
    path = scratch_path(spark, "manifest")
    other = _manifest(spark, folder).withColumn("written_by", F.lit("test")).drop("normalize_embeddings", "metric")
    manifest_source.write_manifest(other, path)
    return manifest_source.read_manifest(spark, path)


@query
def manifest_files(spark, folder):
    """A good manifest, one with an unknown field, one without its model, and one that is broken off."""
    good = F.to_json(F.struct("*"))
    kinds = {
        "good": good,
        "extended": F.concat(F.lit('{"written_by":"test",'), F.substring(good, 2, 1 << 20)),
        "nameless": F.regexp_replace(good, '"embedding_model":"[^"]*",', ""),
        "truncated": F.left(good, F.length(good) - 9),
    }
    described, path = _manifest(spark, folder), scratch_path(spark, "manifests")
    for kind, content in kinds.items():
        described.select(content.alias("value")).coalesce(1).write.text(f"{path}/{kind}")
    found = manifest_source.read_manifests(spark, f"{path}/*")
    return found.withColumn("kind", F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1)).drop("path")


@query
def positional_alignment(spark, folder):
    """Documents as chunks in the order of their texts' lengths, against vectors in the order of their ids."""
    path = scratch_path(spark, "positions")
    chunks = fx.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "n_chars", "doc_id")
    chunks.repartitionByRange(5, "n_chars", "doc_id").sortWithinPartitions("n_chars", "doc_id").write.parquet(f"{path}/chunks")
    found = fx.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")
    found.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").write.parquet(f"{path}/vectors")
    return index.positional_alignment(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"))


@query
def corpus_vectors(spark, folder):
    """Vectors of a stored table, of twice the length, given to documents by chunk id and scaled to length one."""
    path = scratch_path(spark, "embeddings")
    longer = F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding")
    tables.write_table(fx.table(spark, folder, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), longer), path)
    ids = fx.table(spark, folder, "documents").select(F.col("doc_id").alias("faiss_id"), F.concat(F.lit("v"), "doc_id").alias("chunk_id"))
    found = index.corpus_vectors(ids, tables.read_embeddings(spark, path))
    return found.select("faiss_id", F.posexplode("embedding").alias("axis", "x")).select(
        "faiss_id", "axis", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def library_rebuild(spark, folder):
    """Three versions of one library: of all pages, after every seventh page was revised, and unchanged again."""
    root = scratch_path(spark, "versions")
    first = fx.raw_pages(spark, folder)
    revised = F.when(F.col("page_num") % 7 == 3, F.concat("page_text", F.lit(" Revised."))).otherwise(F.col("page_text"))
    second = first.withColumn("page_text", revised)
    rows = []
    with sparing_disk(spark):
        for pages in (first, second, second):
            made = update_library(ingest.clean_pages(pages), root, created_at=F.lit(CREATED_AT).cast("timestamp"))
            counts = made.library.index().agg(F.count_distinct(index.content_digest(F.col("text")))).first()[0]
            rows.append((made.version, made.n_chunks, counts, made.n_encoded, made.library.vectors().count()))
    return spark.createDataFrame(rows, "version int, n_chunks long, n_contents long, n_encoded long, n_vectors long")


@query
def iso_timestamps(spark, folder):
    return fx.table(spark, folder, "events").select("event_id", text.utc_text(F.col("ts")).alias("ts_text"))


# Vectors and search


@query
def l2_normalize(spark, folder):
    """Vectors stretched by a factor that is zero for some."""
    stretched = F.transform("embedding", lambda x: (x * (F.col("vec_id") % 7)).cast("float"))
    table = fx.table(spark, folder, "embeddings").withColumn("embedding", stretched)
    return index.normalized(table).select("vec_id", F.posexplode("embedding").alias("axis", "x")).select(
        "vec_id", "axis", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def cosine_pairs(spark, folder):
    """Every vector against the mean of its label and class."""
    means = fx.label_questions(spark, folder).select("query_id", F.col("embedding").alias("mean"))
    own = (F.col("label") * 10 + F.col("vec_id") % 4 + 5).alias("query_id")
    table = fx.table(spark, folder, "embeddings").select("vec_id", "embedding", own)
    unit = vectors.l2_normalize
    product = vectors.inner_product(unit(F.col("embedding")), unit(F.col("mean")))
    distance = vectors.squared_distance(F.col("embedding"), F.col("mean"))
    return joins.join_small(table, means, "query_id").select(
        "vec_id", "query_id", F.round(product, 6).alias("cosine"), F.round(distance, 6).alias("distance")
    )


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


@query
def vector_search(spark, folder):
    hits = search.top_k(fx.label_questions(spark, folder), fx.vectors(spark, folder), k=100)
    return _rounded(search.with_chunk_rows(hits, fx.corpus_chunks(spark, folder)))


@query
def vector_search_l2(spark, folder):
    return _rounded(
        search.top_k(fx.label_questions(spark, folder), fx.vectors(spark, folder), k=5, metric=search.L2).frame
    )


def _stored_blocks(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "vector-blocks")
    tables.write_table(vector_blocks.vector_blocks(fx.vectors(spark, folder), 64), path)
    return spark.read.schema(vector_blocks.BLOCKS).parquet(path)


@query
def vector_block_search(spark, folder):
    """The hits of vector_search and vector_search_l2, from stored blocks."""
    blocks, questions = _stored_blocks(spark, folder), fx.label_questions(spark, folder)
    found = [
        vector_blocks.top_k_blocks(questions, blocks, k, metric).frame.withColumn("metric", F.lit(metric))
        for k, metric in ((100, search.INNER_PRODUCT), (5, search.L2))
    ]
    return _rounded(found[0].unionByName(found[1]))


@query
def vector_block_bounds(spark, folder):
    """Every vector against what its block says of it, and the pairs that a search by length of hits has to cover."""
    blocks = _stored_blocks(spark, folder)
    held = blocks.select("mean", "radius", "shortest", "longest", F.posexplode("ids").alias("at", "faiss_id")).join(
        fx.vectors(spark, folder), "faiss_id"
    )
    length = F.sqrt(vectors.inner_product(F.col("embedding"), F.col("embedding")))
    distance = F.sqrt(vectors.squared_distance(F.col("embedding"), F.col("mean")))
    return held.select(
        "faiss_id",
        (distance <= F.col("radius") + 1e-9).alias("within_radius"),
        ((length >= F.col("shortest") - 1e-9) & (length <= F.col("longest") + 1e-9)).alias("within_lengths"),
    )


@query
def metadata_filter(spark, folder):
    questions = fx.label_questions(spark, folder)
    hits = search.top_k(questions, fx.vectors(spark, folder), k=retrieval.NET)
    rows = search.with_chunk_rows(hits, fx.corpus_chunks(spark, folder).drop("text"))
    targets = questions.select("query_id", "target_subject", "target_class")
    return _rounded(retrieval.filter_hits(rows.join(targets, "query_id")))


def _label_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return retrieval.retrieve(
        fx.label_questions(spark, folder), fx.vectors(spark, folder), fx.corpus_chunks(spark, folder), k
    )


@query
def retrieve(spark, folder):
    return _rounded(_label_hits(spark, folder, retrieval.ANSWER_K))


@query
def embed_chunks(spark, folder):
    """Per chunk: dimensions, filled positions, and two sums that depend on value and position."""
    chunks = chunking.chunk_table(fx.cleaned_pages(spark, folder))
    filled = F.posexplode("embedding").alias("axis", "x")
    value = F.col("x").cast("double")
    return (
        embedding.embed(chunks)
        .select("chunk_id", F.size("embedding").alias("dim"), filled)
        # Zeros add nothing; the first position stays, so that a vector of zeros has its row.
        .where((F.col("x") != 0) | (F.col("axis") == 0))
        .groupBy("chunk_id", "dim")
        .agg(
            F.count_if(F.col("x") > 0).alias("filled"),
            F.round(F.sum(value), 4).alias("total"),
            F.round(F.sum(value * F.col("axis")), 4).alias("weighted"),
        )
    )


def _library(spark: SparkSession, folder: str) -> Library:
    return build_library(
        fx.cleaned_pages(spark, folder),
        scratch_path(spark, "library"),
        created_at=F.lit(CREATED_AT).cast("timestamp"),
    )


@query
def ask_questions(spark, folder):
    """Pages to prompts: chunk, embed and index every document, then ask every benchmark item."""
    return _flat(ask(_library(spark, folder), fx.text_questions(spark, folder)))


# Prompts


def _flat(table: DataFrame) -> DataFrame:
    """Both messages side by side, as plain columns."""
    return table.drop("embedding").withColumns(
        {
            "system_content": F.get("messages", F.lit(0))["content"],
            "user_content": F.get("messages", F.lit(1))["content"],
        }
    ).drop("messages")


@query
def rag_prompt(spark, folder):
    return _flat(
        prompts.answer_prompts(
            fx.label_questions(spark, folder), _label_hits(spark, folder, retrieval.ANSWER_K), TUTOR
        )
    )


@query
def spoken_prompt(spark, folder):
    """The same questions, answered in a language each."""
    names = F.array(*[F.lit(name) for name in language.DISPLAY_NAMES.values()])
    language_of = F.get(names, (F.col("query_id") % len(language.DISPLAY_NAMES)).cast("int"))
    questions = fx.label_questions(spark, folder).withColumn("language", language_of)
    rows = prompts.message_rows(
        prompts.spoken_prompts(questions, _label_hits(spark, folder, retrieval.ANSWER_K), TUTOR)
    )
    return rows


@query
def rag_user_message(spark, folder):
    """Lines of each document as context, some blank, some null."""
    padded = F.transform(
        F.split("text", "\n"),
        lambda line, at: F.when(at % 5 == 3, None).when(at % 5 == 4, " \t").otherwise(F.concat(F.lit("  "), line, F.lit("\n"))),
    )
    question = F.concat(F.lit("What does "), "source", F.lit(" say?"))
    return fx.table(spark, folder, "documents").select(
        "doc_id", prompts.rag_user_message(padded, question).alias("message")
    )


@query
def quiz_prompt(spark, folder):
    levels = F.array(*[F.lit(name) for name in ("Easy", "Medium", "Hard", "Odd")])
    number = F.col("query_id")
    topics = fx.label_questions(spark, folder).select(
        "query_id",
        F.when(number % 10 == 8, " \n").otherwise(F.col("question")).alias("topic"),
        "target_subject",
        "target_class",
        F.get(levels, (number % 4).cast("int")).alias("difficulty"),
        (number % 7 + 1).cast("int").alias("num_questions"),
    )
    return _flat(prompts.quiz_prompts(topics, _label_hits(spark, folder, retrieval.QUIZ_K)))


@query
def chat_history(spark, folder):
    return conversation.history_prompt(
        fx.messages(spark, folder), prompts.CHAT_RULE.replace("{tutor}", TUTOR)
    )


@query
def transcript(spark, folder):
    messages = fx.messages(spark, folder)
    found = conversation.transcript_segments(conversation.exchanges(messages), TUTOR)
    return conversation.answered_or(found, messages, prompts.CHAT_SAMPLE)


# Replies


@query
def answer_fallback(spark, folder):
    return conversation.with_fallback(
        fx.requests(spark, folder),
        fx.replies(spark, folder),
        fx.second_replies(spark, folder),
        ("first", "second"),
    )


@query
def parse_think(spark, folder):
    content = responses.chat_content(F.col("reply"))
    return (
        fx.replies(spark, folder)
        .select("request_id", content.alias("content"))
        .filter(F.col("content").isNotNull())
        .select(
            "request_id",
            responses.thinking(F.col("content")).alias("thinking"),
            responses.answer(F.col("content")).alias("answer"),
            responses.without_thinking(F.col("content")).alias("spoken"),
        )
    )


@query
def response_content(spark, folder):
    return fx.replies(spark, folder).select(
        "request_id", *[value.alias(name) for name, value in conversation.reply_fields(F.col("reply")).items()]
    )


@query
def translation_text(spark, folder):
    """Every message as a translation reply, in one of the shapes a reply may have."""
    said, blank = F.col("text"), F.lit(" \n")
    number = F.col("conv_id") + F.col("turn")
    reply = (
        F.when(number % 5 == 0, F.to_json(F.struct(said.alias("translated_text"), blank.alias("output"))))
        .when(number % 5 == 1, F.to_json(F.struct(blank.alias("translated_text"), F.concat(blank, said).alias("output"))))
        .when(number % 5 == 2, F.to_json(F.struct(said.alias("text"))))
        .when(number % 5 == 3, F.to_json(F.struct(F.col("turn").alias("output"))))
        .otherwise(F.to_json(F.struct(said.alias("other"))))
    )
    return fx.messages(spark, folder).select("conv_id", "turn", responses.translation(reply).alias("translated"))


@query
def transcript_fields(spark, folder):
    said = F.col("text").alias("transcript")
    number = F.col("conv_id") + F.col("turn")
    code = F.when(number % 2 == 0, "hi-IN").otherwise("ta").alias("language_code")
    reply = (
        F.when(number % 3 == 0, F.to_json(F.struct(said)))
        .when(number % 3 == 1, F.to_json(F.struct(code)))
        .otherwise(F.to_json(F.struct(said, code)))
    )
    return fx.messages(spark, folder).select(
        "conv_id",
        "turn",
        responses.transcript_text(reply).alias("transcript"),
        responses.transcript_language(reply).alias("language_code"),
    )


@query
def payload_decode(spark, folder):
    """Every message as the payload of a data URL, of a bare text, and of an audio reply."""
    encoded = F.base64(F.encode("text", "UTF-8"))
    url = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data:audio/webm;base64,"), encoded)).otherwise(encoded)
    reply = F.to_json(F.struct(F.array(encoded, F.lit("AAAA")).alias("audios")))
    recorded, spoken = responses.data_url_bytes(url), responses.first_audio_bytes(reply)
    return fx.messages(spark, folder).select(
        "conv_id",
        "turn",
        F.octet_length(recorded).alias("n_bytes"),
        F.decode(recorded, "UTF-8").alias("recorded"),
        F.decode(spoken, "UTF-8").alias("spoken"),
    )


# Quizzes


def _quizzes(spark: SparkSession, folder: str) -> DataFrame:
    return quiz.read_quizzes(fx.quiz_replies(spark, folder))


@query
def quiz_json_slice(spark, folder):
    return fx.quiz_replies(spark, folder).select("quiz_id", quiz.json_slice(F.col("reply")).alias("slice"))


@query
def quiz_validate(spark, folder):
    return _quizzes(spark, folder).select(
        "quiz_id", "success", "error", F.coalesce(F.array_size("questions"), F.lit(0)).alias("n_questions")
    )


@query
def quiz_questions(spark, folder):
    rows = quiz.question_rows(_quizzes(spark, folder))
    return rows.withColumn("options", F.array_join("options", "|"))


@query
def quiz_render_rows(spark, folder):
    """Options as shown, under the quiz's heading."""
    heading = fx.page_files(spark, folder).select(
        (F.col("page_num") - 1).cast("long").alias("quiz_id"),
        text.title(ingest.filename_fields(F.col("filename"))["subject"]).alias("subject_title"),
    )
    return quiz.option_rows(quiz.question_rows(_quizzes(spark, folder))).join(heading, "quiz_id")


@query
def quiz_answer_key(spark, folder):
    return quiz.answer_key(quiz.question_rows(_quizzes(spark, folder)))


def _grades(spark: SparkSession, folder: str) -> DataFrame:
    return quiz.grade(quiz.question_rows(_quizzes(spark, folder)), fx.quiz_answers(spark, folder))


@query
def quiz_grade(spark, folder):
    return _grades(spark, folder)


@query
def quiz_score(spark, folder):
    return quiz.score(_quizzes(spark, folder), _grades(spark, folder)).withColumn("score", F.round("score", 6))


def _quiz_book(spark: SparkSession, folder: str) -> quiz_plan.QuizBook:
    """Pages to quizzes: a model that fails for some prompts, and then another one for those only."""
    found = quiz_plan.topic_prompts(_library(spark, folder), fx.quiz_topics(spark, folder))
    book = quiz_plan.make_quizzes(found, scratch_path(spark, "quizzes"), fx.quiz_writer(faulty=True))
    return quiz_plan.complete_quizzes(book, fx.quiz_writer(faulty=False))


@query
def quiz_library(spark, folder):
    return _quiz_book(spark, folder).quizzes()


@query
def quiz_report(spark, folder):
    found = quiz_plan.quiz_report(_quiz_book(spark, folder), fx.letter_answers(spark, folder))
    return found.withColumn("score", F.round("score", 6))


# Language and speech


@query
def detect_language(spark, folder):
    """Every message behind a word in one of the scripts, or in none."""
    words = F.array(*[F.lit(word) for word in fx.SCRIPT_WORDS])
    said = F.concat(F.get(words, ((F.col("conv_id") + F.col("turn")) % len(fx.SCRIPT_WORDS)).cast("int")), F.lit(" "), "text")
    return fx.messages(spark, folder).select("conv_id", "turn", language.detect_language(said).alias("language"))


@query
def language_codes(spark, folder):
    """The language of every document, in short and long form, and some that have no code."""
    number = F.col("doc_id") % 5
    code = (
        F.when(number == 0, F.col("lang"))
        .when(number == 1, F.concat("lang", F.lit("-XX")))
        .when(number == 2, "")
        .when(number == 3, "hi-IN")
    )
    return fx.table(spark, folder, "documents").select(
        "doc_id",
        language.speech_code(code).alias("speech_code"),
        language.language_name(code).alias("language_name"),
    )


def _marked_up() -> Column:
    """A document dressed up with every kind of mark the speech clean-up knows."""
    return F.concat(
        F.lit("## **Notes** on [*"), "source", F.lit("*](http://x.example/1)\n> __quoted__ "), "text",
        F.lit("\n - first ~~old~~ | `code` <b>bold</b>\n12. "), F.replace("text", F.lit(". "), F.lit("_ *")),
        F.lit("\n-----\n```\nblock\n``` * end_ "),
    )


@query
def clean_speech_a(spark, folder):
    spoken = text.speech_text(_marked_up())
    return fx.table(spark, folder, "documents").select(
        "doc_id",
        spoken.alias("spoken"),
        text.truncate(spoken, text.SPEECH_CUT).alias("cut"),
        text.truncate(spoken, text.SPEECH_REQUEST_CUT).alias("request_cut"),
    )


@query
def clean_speech_b(spark, folder):
    return fx.table(spark, folder, "documents").select(
        "doc_id", text.plain_speech_text(_marked_up()).alias("spoken")
    )
