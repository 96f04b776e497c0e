"""The registered queries as DuckDB SQL, written apart from the Spark code.

Shared table expressions come first; each statement names the ones it needs.
"""

from __future__ import annotations

from chalkline.catalog.fixtures import SCRIPT_WORDS
from chalkline.functions.language import DISPLAY_NAMES, SCRIPTS, SPEECH_CODES
from chalkline.functions.text import PLAIN_SPEECH_RULES, SPEECH_RULES
from chalkline.operators import prompts, quiz
from chalkline.schemas import BOOL, INT, LONG, MANIFEST

TUTOR = "Asha"
_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(expression: str) -> str:
    return f"trim({expression}, {_BLANKS})"


def _fill(template: str, **values: str) -> str:
    """A SQL concatenation of the template with SQL expressions in place of its names."""
    out = _text(template)
    for name, expression in values.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return out


def _with(*names: str, select: str) -> str:
    """The statement behind the table expressions it names, and those they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        uses, _ = _TABLES[name]
        for use in uses:
            add(use)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    recursive = "RECURSIVE " if any("_rec" in name for name in needed) else ""
    parts = ",\n".join(f"{name} AS ({_TABLES[name][1]})" for name in needed)
    return f"WITH {recursive}{parts}\n{select}"


_TOPIC = {"topic": "topic", "class": "target_class", "subject": "target_subject"}
_TOPIC_REQUEST = _fill(prompts.QUIZ_REQUEST, **_TOPIC, difficulty="difficulty", num_questions="num_questions", context="context")
_TOPIC_MISSING = _fill(prompts.QUIZ_NOT_FOUND, **_TOPIC)


def _clean(expression: str) -> str:
    fewer = f"regexp_replace({expression}, '\\n{{3,}}', chr(10)||chr(10), 'g')"
    return _strip(f"regexp_replace({fewer}, '[ \\t]+', ' ', 'g')")


_FILENAME = """
    replace(split_part(replace(filename, '.pdf', ''), '_', 1), 'class', '') AS class_num,
    array_to_string(list_slice(string_split(replace(filename, '.pdf', ''), '_'), 2,
        len(string_split(replace(filename, '.pdf', ''), '_')) - 1), '_') AS subject,
    replace(string_split(replace(filename, '.pdf', ''), '_')[-1], 'ch', '') AS chapter"""


def _cut(source: str, separator: str) -> str:
    """Pieces of 400 characters or more, cut before every separator; order kept by a number list."""
    return f"""
    SELECT filename, list_append(pos, generate_subscripts(parts, 1)) AS pos, unnest(parts) AS piece
    FROM (SELECT filename, pos, CASE WHEN length(piece) >= 400
                THEN string_split(replace(piece, {separator}, chr(1) || {separator}), chr(1))
                ELSE [piece] END AS parts
          FROM {source})"""


_KEY = "class_num, subject, chapter, filename"
_MARKED = """'## **Notes** on [*' || source || '*](http://x.example/1)' || chr(10) || '> __quoted__ ' || text
    || chr(10) || ' - first ~~old~~ | `code` <b>bold</b>' || chr(10) || '12. ' || replace(text, '. ', '_ *')
    || chr(10) || '-----' || chr(10) || '```' || chr(10) || 'block' || chr(10) || '``` * end_ '"""


def _speech(rules) -> str:
    out = _MARKED
    for flag, pattern, replacement, _ in rules:
        pattern = f"(?{flag}-s)" + pattern.replace("\\s", "[\\s\\x0b]") if flag else "(?-s)" + pattern
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(replacement.replace('$', chr(92)))}, 'g')"
    return _strip(out)


_REPLY_NUMBER = "(conv_id + turn)"

_TABLES: dict[str, tuple[list[str], str]] = {
    "page_files": (
        [],
        """SELECT 'class' || (doc_id % 4 + 5) || '_' || CASE lang WHEN 'en' THEN 'social_science'
            WHEN 'fr' THEN 'science' ELSE 'english' END || '_ch' || regexp_extract(source, '[0-9]+') || '.pdf'
            AS filename, CAST(doc_id + 1 AS INTEGER) AS page_num, text AS page_text FROM documents""",
    ),
    "raw_pages": (["page_files"], f"SELECT filename, {_FILENAME}, page_num, page_text FROM page_files"),
    "pages": (
        ["raw_pages"],
        f"""SELECT * FROM (SELECT * REPLACE ({_clean('page_text')} AS page_text) FROM raw_pages)
            WHERE length(page_text) > 100""",
    ),
    # Chunks. Pieces first, then the start that follows each start, then the starts that are reached.
    "chapters": (
        ["pages"],
        f"SELECT {_KEY}, string_agg(page_text, chr(10)||chr(10) ORDER BY page_num) AS text FROM pages GROUP BY ALL",
    ),
    "cut0": (["chapters"], "SELECT filename, CAST([] AS BIGINT[]) AS pos, text AS piece FROM chapters"),
    "cut1": (["cut0"], _cut("cut0", "chr(10)||chr(10)")),
    "cut2": (["cut1"], _cut("cut1", "chr(10)")),
    "cut3": (["cut2"], _cut("cut2", "'. '")),
    "cut4": (["cut3"], _cut("cut3", "' '")),
    "pieces": (
        ["cut4"],
        """SELECT filename, piece, length(piece) AS len,
                row_number() OVER w AS n, sum(length(piece)) OVER w AS upto
            FROM cut4 WHERE piece <> '' WINDOW w AS (PARTITION BY filename ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    # The first piece after n that no longer fits a chunk that starts at n.
    "overflow": (
        ["pieces"],
        """SELECT s.filename, s.n, s.upto - s.len AS start_at, min(j.n) AS stop
            FROM pieces s LEFT JOIN pieces j ON j.filename = s.filename
                AND j.n > s.n AND j.n <= s.n + 401 AND j.upto - (s.upto - s.len) > 400
            GROUP BY ALL""",
    ),
    # The start after an overflow at j: what is kept has at most 50 characters and fits with j.
    "restart": (
        ["pieces"],
        """SELECT j.filename, j.n AS stop, coalesce(min(t.n), j.n) AS following
            FROM pieces j LEFT JOIN pieces t ON t.filename = j.filename
                AND t.n < j.n AND t.n >= j.n - 51
                AND (j.upto - j.len) - (t.upto - t.len) <= 50 AND j.upto - (t.upto - t.len) <= 400
            GROUP BY j.filename, j.n""",
    ),
    "jumps": (
        ["overflow", "restart"],
        """SELECT o.filename, o.n, o.stop, o.start_at, r.following
            FROM overflow o LEFT JOIN restart r ON r.filename = o.filename AND r.stop = o.stop""",
    ),
    "walk_rec": (
        ["jumps"],
        """SELECT filename, n, stop, start_at, following FROM jumps WHERE n = 1
            UNION ALL
            SELECT j.filename, j.n, j.stop, j.start_at, j.following
            FROM walk_rec w JOIN jumps j ON j.filename = w.filename AND j.n = w.following""",
    ),
    "cut_chunks": (
        ["walk_rec", "chapters"],
        f"""SELECT w.filename, w.n, {_strip('''substr(c.text, CAST(w.start_at + 1 AS BIGINT),
                CAST(coalesce(e.upto - e.len, length(c.text)) - w.start_at AS BIGINT))''')} AS content
            FROM walk_rec w JOIN chapters c USING (filename)
            LEFT JOIN pieces e ON e.filename = w.filename AND e.n = w.stop""",
    ),
    "split": (
        ["cut_chunks"],
        f"""SELECT {_KEY}, CAST(row_number() OVER (PARTITION BY filename ORDER BY n) - 1 AS INTEGER)
                AS chunk_sequence, content
            FROM cut_chunks JOIN chapters USING (filename) WHERE content <> ''""",
    ),
    "chunks": (
        ["split"],
        """SELECT 'c' || class_num || '_' || subject || '_ch' || chapter || '_' || chunk_sequence AS chunk_id,
                content, class_num, subject, chapter, chunk_sequence, filename AS source_file,
                CAST(len(regexp_extract_all(content, '[^ \\n\\t]+')) AS INTEGER) AS word_count
            FROM split""",
    ),
    "index_rows": (
        ["chunks"],
        """SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS faiss_id, chunk_id, content AS text,
                class_num AS class, subject, chapter, chunk_sequence, source_file, word_count FROM chunks""",
    ),
    # Hashed words.
    "words": (
        ["chunks"],
        """SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS word FROM chunks""",
    ),
    "chunk_counts": (
        ["words"],
        """SELECT chunk_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 512 AS axis, count(*) AS n
            FROM words GROUP BY ALL""",
    ),
    "chunk_vectors": (
        ["chunk_counts"],
        """SELECT chunk_id, axis, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS FLOAT) AS x
            FROM chunk_counts""",
    ),
    "text_questions": (
        [],
        """SELECT item_id AS query_id, text AS question,
                CASE item_id % 3 WHEN 0 THEN 'All' WHEN 1 THEN 'Social' ELSE 'english' END AS target_subject,
                CASE item_id % 2 WHEN 0 THEN 'All' ELSE CAST(item_id % 4 + 5 AS VARCHAR) END AS target_class
            FROM benchmark""",
    ),
    "question_vectors": (
        ["text_questions"],
        """SELECT query_id, axis, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS FLOAT) AS x
            FROM (SELECT query_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 512 AS axis, count(*) AS n
                FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+')) AS word
                    FROM text_questions) GROUP BY ALL)""",
    ),
    "text_scores": (
        ["question_vectors", "chunk_vectors"],
        """SELECT query_id, chunk_id, CAST(sum(q.x::DOUBLE * c.x::DOUBLE) AS FLOAT) AS score
            FROM question_vectors q JOIN chunk_vectors c USING (axis) GROUP BY ALL""",
    ),
    "text_net": (
        ["text_scores", "index_rows"],
        """SELECT * FROM (SELECT q.query_id, i.faiss_id, row_number() OVER (PARTITION BY q.query_id
                ORDER BY coalesce(s.score, 0) DESC, i.faiss_id) AS place
            FROM text_questions q CROSS JOIN index_rows i
            LEFT JOIN text_scores s ON s.query_id = q.query_id AND s.chunk_id = i.chunk_id) WHERE place <= 100""",
    ),
    "text_hits": (
        ["text_net"],
        """SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k
            FROM text_net JOIN index_rows USING (faiss_id) JOIN text_questions USING (query_id)
            WHERE (target_subject = 'All' OR starts_with(lower(subject), lower(target_subject)))
                AND (target_class = 'All' OR class = target_class)""",
    ),
    "quiz_topics": (
        ["text_questions"],
        """SELECT query_id AS quiz_id, CASE WHEN query_id % 10 = 8 THEN ' ' || chr(10) ELSE question END AS topic, target_subject,
                CASE WHEN query_id % 10 = 6 THEN '12' ELSE target_class END AS target_class,
                ['Easy', 'Medium', 'Hard', 'Odd'][query_id % 4 + 1] AS difficulty, CAST(query_id % 7 + 1 AS INTEGER) AS num_questions
            FROM text_questions""",
    ),
    "topic_hits": (
        ["text_net", "quiz_topics"],
        """SELECT quiz_id, CAST(count(*) AS INTEGER) AS n_hits, string_agg(text, chr(10)||chr(10) ORDER BY k) AS context
            FROM (SELECT quiz_id, text, row_number() OVER (PARTITION BY quiz_id ORDER BY place) AS k
                FROM text_net JOIN index_rows USING (faiss_id) JOIN quiz_topics ON quiz_id = query_id
                WHERE quiz_id % 10 <> 8 AND (target_subject = 'All' OR starts_with(lower(subject), lower(target_subject)))
                    AND (target_class = 'All' OR class = target_class)) WHERE k <= 5 GROUP BY quiz_id""",
    ),
    "quiz_sent": (
        ["topic_hits"],
        f"""SELECT *, CASE WHEN n_hits IS NOT NULL THEN {_TOPIC_REQUEST} END AS request
            FROM quiz_topics LEFT JOIN topic_hits USING (quiz_id)""",
    ),
    "quiz_library": (
        ["quiz_sent"],
        f"""SELECT quiz_id, topic, target_subject, target_class, difficulty, num_questions, coalesce(n_hits, 0) AS n_hits,
                CASE WHEN request IS NULL THEN 0 WHEN length(request) % 5 < 2 THEN 2 ELSE 1 END::BIGINT AS n_asked,
                request IS NOT NULL AS success, CASE WHEN quiz_id % 10 = 8 THEN {_text(prompts.QUIZ_BLANK_TOPIC)}
                    WHEN request IS NULL THEN {_TOPIC_MISSING} END AS error,
                CASE WHEN request IS NULL THEN 0 ELSE num_questions END AS n_questions FROM quiz_sent""",
    ),
    # Vectors of the embeddings table.
    "corpus_chunks": (
        [],
        """SELECT vec_id AS faiss_id, 'k' || vec_id AS chunk_id, text, 's' || label AS subject,
                CAST(vec_id % 4 + 5 AS VARCHAR) AS class, regexp_extract(source, '[0-9]+') AS chapter
            FROM embeddings JOIN documents ON doc_id = vec_id""",
    ),
    "label_questions": (
        [],
        """SELECT CAST(label * 10 + class AS BIGINT) AS query_id,
                'Which passages belong to label ' || label || '?' AS question,
                list(x ORDER BY axis) AS embedding,
                CASE label % 3 WHEN 0 THEN 'All' WHEN 1 THEN 'S' || label ELSE 's' || label END AS target_subject,
                CASE class WHEN 5 THEN NULL WHEN 6 THEN '' ELSE CAST(class AS VARCHAR) END AS target_class
            FROM (SELECT label, class, axis, CAST(avg(x::DOUBLE) AS FLOAT) AS x
                FROM (SELECT label, vec_id % 4 + 5 AS class, generate_subscripts(embedding, 1) AS axis,
                        unnest(embedding) AS x FROM embeddings) GROUP BY ALL)
            GROUP BY label, class""",
    ),
    "asked": (
        ["label_questions"],
        """SELECT * REPLACE (CASE WHEN norm > 0 THEN list_transform(embedding, lambda x: CAST(x::DOUBLE / norm AS FLOAT))
                ELSE embedding END AS embedding)
            FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
                FROM label_questions)""",
    ),
    "net": (
        ["asked"],
        """SELECT query_id, vec_id AS faiss_id, CAST(score AS DOUBLE) AS score, place - 1 AS rank
            FROM (SELECT query_id, vec_id, score,
                    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
                FROM (SELECT query_id, vec_id, CAST(list_inner_product(q.embedding::DOUBLE[],
                        e.embedding::DOUBLE[]) AS FLOAT) AS score FROM asked q CROSS JOIN embeddings e))
            WHERE place <= 100""",
    ),
    "filtered": (
        ["net", "corpus_chunks"],
        """SELECT n.query_id, c.*, n.score, n.rank, q.target_subject, q.target_class,
                row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank) AS k
            FROM net n JOIN corpus_chunks c USING (faiss_id) JOIN asked q USING (query_id)
            WHERE (coalesce(q.target_subject, '') IN ('', 'All')
                    OR starts_with(lower(c.subject), lower(q.target_subject)))
                AND (coalesce(q.target_class, '') IN ('', 'All') OR c.class = q.target_class)""",
    ),
    "contexts": (
        ["filtered"],
        """SELECT query_id, CAST(count(*) FILTER (k <= 3) AS INTEGER) AS n3, CAST(count(*) FILTER (k <= 5) AS INTEGER)
                AS n5, string_agg(text, chr(10)||chr(10) ORDER BY rank) FILTER (k <= 3) AS context3,
                string_agg(text, chr(10)||chr(10) ORDER BY rank) FILTER (k <= 5) AS context5
            FROM filtered GROUP BY query_id""",
    ),
    # Conversations and replies.
    "replies": (
        [],
        f"""SELECT conv_id * 1000 + turn AS request_id, {_REPLY_NUMBER} % 3 = 0 AS thinks,
                {_REPLY_NUMBER} % 5 <> 0 AS answered, text, CASE WHEN {_REPLY_NUMBER} % 5 <> 0 THEN
                CASE WHEN {_REPLY_NUMBER} % 3 = 0 THEN '<think> about' || chr(10) || 'assistant </think>' || chr(10)
                    || chr(10) || text || '<think> about' || chr(10) || 'assistant </think>' || chr(10) || chr(10)
                ELSE text END END AS content FROM conversations WHERE role = 'assistant'""",
    ),
    "asked_turns": (
        [],
        f"""SELECT conv_id, max(turn) AS asked_turn FROM conversations
            WHERE role = 'user' AND {_strip('text')} <> '' GROUP BY conv_id""",
    ),
    # Quizzes, as texts built and read by DuckDB's own JSON functions.
    "quiz_items": (
        [],
        """SELECT item_id AS quiz_id, item_id % 11 AS kind, CAST(to_json(list_transform(range(item_id % 4 + 1), lambda k: {
                'question': (k + 1) || '. ' || text,
                'options': list_transform(range(CASE WHEN item_id % 11 = 4 THEN 3 ELSE 4 END),
                    lambda i: substr('ABCD', CAST(i + 1 AS BIGINT), 1) || ') choice ' || (item_id + k + i)),
                'correct_answer': ' ' || lower(substr('ABCD', CAST((item_id + k) % 4 + 1 AS BIGINT), 1)),
                'explanation': CASE WHEN item_id % 11 <> 6 THEN 'because of item ' || item_id END})) AS VARCHAR).replace(
                ',"explanation":null', '') AS good FROM benchmark""",
    ),
    "quiz_replies": (
        ["quiz_items"],
        """SELECT quiz_id, 'Here is your quiz:' || chr(10) || CASE kind WHEN 0 THEN 'no quiz today'
                WHEN 1 THEN '[{"question": "open"]' WHEN 2 THEN '] turned round [' WHEN 3 THEN '[]'
                WHEN 5 THEN '[{"question": "q", "options": "ABCD", "correct_answer": "A"}]'
                WHEN 7 THEN '[1]' WHEN 8 THEN good || ' and [2]' ELSE good END || chr(10) || 'Good luck!' AS reply
            FROM quiz_items""",
    ),
    "slices": (
        ["quiz_replies"],
        """SELECT quiz_id, CASE WHEN first > 0 AND last > 0 THEN
                CASE WHEN last >= first THEN substr(reply, first, last - first + 1) ELSE '' END END AS slice
            FROM (SELECT *, instr(reply, '[') AS first, CASE WHEN contains(reply, ']')
                THEN length(reply) - instr(reverse(reply), ']') + 1 ELSE 0 END AS last FROM quiz_replies)""",
    ),
    "elements": (
        ["slices"],
        """SELECT quiz_id, i - 1 AS q_idx, json_extract(slice, '$[' || (i - 1) || ']') AS q
            FROM (SELECT quiz_id, slice, unnest(range(1, CAST(json_array_length(slice) AS BIGINT) + 1)) AS i
                FROM slices WHERE slice <> '' AND json_valid(slice))""",
    ),
    "faults": (
        ["elements"],
        f"""SELECT quiz_id, min_by(fault, q_idx) AS fault FROM (SELECT quiz_id, q_idx, 'Question ' || (q_idx + 1) ||
                CASE WHEN json_extract_string(q, '$.question') IS NULL
                    OR json_extract_string(q, '$.correct_answer') IS NULL
                    OR coalesce(json_type(q, '$.options'), '') <> 'ARRAY' THEN {_text(quiz.MISSING_FIELDS)}
                WHEN json_array_length(q, '$.options') <> 4 THEN {_text(quiz.WRONG_OPTIONS)} END AS fault
                FROM elements) WHERE fault IS NOT NULL GROUP BY quiz_id""",
    ),
    "quizzes": (
        ["faults"],
        f"""SELECT quiz_id, error IS NULL AS success, error,
                CASE WHEN error IS NULL THEN CAST(json_array_length(slice) AS INTEGER) ELSE 0 END AS n_questions
            FROM (SELECT s.quiz_id, s.slice, CASE WHEN slice IS NULL THEN {_text(quiz.OTHER_ERROR + quiz.NO_ARRAY)}
                WHEN slice = '' OR NOT json_valid(slice) THEN {_text(quiz.PARSE_ERROR)}
                WHEN fault IS NOT NULL THEN {_text(quiz.OTHER_ERROR)} || fault END AS error
                FROM slices s LEFT JOIN faults USING (quiz_id))""",
    ),
    "questions": (
        ["quizzes"],
        """SELECT quiz_id, CAST(q_idx AS INTEGER) AS q_idx, json_extract_string(q, '$.question') AS question,
                CAST(json_extract(q, '$.options') AS VARCHAR[]) AS options,
                json_extract_string(q, '$.correct_answer') AS correct_answer,
                coalesce(json_extract_string(q, '$.explanation'), '') AS explanation
            FROM elements JOIN quizzes USING (quiz_id) WHERE success""",
    ),
    "grades": (
        ["questions"],
        f"""SELECT quiz_id, q_idx + 1 AS question_num, question, CASE
                WHEN (quiz_id + q_idx) % 5 = 0 OR q_idx > quiz_id % 3 THEN {_text(quiz.NOT_ANSWERED)}
                WHEN (quiz_id + q_idx) % 5 = 2 THEN 'Z' ELSE upper({_strip('correct_answer')}) END AS user_answer,
                upper({_strip('correct_answer')}) AS correct_answer,
                (quiz_id + q_idx) % 5 NOT IN (0, 2) AND q_idx <= quiz_id % 3 AS is_correct, explanation FROM questions""",
    ),
}


def _case(mapping: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in mapping.items()) + " END"


def _message_pair(rule: str, request: str, error: str) -> str:
    return f"""CASE WHEN ({error}) IS NULL THEN {rule} END AS system_content,
        CASE WHEN ({error}) IS NULL THEN {request} END AS user_content, {error} AS error"""


def statements() -> dict[str, str]:
    code = "CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang || '-XX' WHEN 2 THEN '' WHEN 3 THEN 'hi-IN' END"
    number = "(conv_id + turn)"
    not_found = _fill(prompts.ANSWER_NOT_FOUND, **{"class": "target_class", "subject": "target_subject"})
    topic = "CASE WHEN query_id % 10 = 8 THEN ' ' || chr(10) ELSE question END"
    level = "['Easy', 'Medium', 'Hard', 'Odd'][query_id % 4 + 1]"
    level_rule = f"coalesce({_case(prompts.DIFFICULTY_RULES, level)}, {_text(prompts.DIFFICULTY_RULES['Medium'])})"
    about = {"topic": topic, "class": "coalesce(target_class, '')", "subject": "coalesce(target_subject, '')"}
    quiz_error = f"""CASE WHEN query_id % 10 = 8 THEN {_text(prompts.QUIZ_BLANK_TOPIC)}
        WHEN n5 IS NULL THEN {_fill(prompts.QUIZ_NOT_FOUND, **about)} END"""
    names = "[" + ", ".join(_text(name) for name in DISPLAY_NAMES.values()) + "]"
    words = "[" + ", ".join(_text(word) for word in SCRIPT_WORDS) + "]"
    said = f"{words}[{number} % {len(SCRIPT_WORDS)} + 1] || ' ' || text"
    scripts = " ".join(
        f"WHEN regexp_matches(said, '[\\x{{{ord(first):x}}}-\\x{{{ord(last):x}}}]') THEN '{code}'"
        for code, first, last in SCRIPTS
    )
    title = """array_to_string(list_transform(string_split(replace(subject, '_', ' '), ' '),
        lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"""
    unit = """list_transform(e.embedding, lambda x: CAST(x::DOUBLE / sqrt(list_sum(list_transform(e.embedding,
        lambda y: y::DOUBLE * y::DOUBLE))) AS FLOAT))::DOUBLE[]"""
    stretched = """list_transform(embedding, lambda x: CAST(x * (vec_id % 7) AS FLOAT))"""
    spoken_a = f"SELECT doc_id, {_speech(SPEECH_RULES)} AS spoken FROM documents"
    manifest = """SELECT 'given' AS embedding_model, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim,
        'corpus.faiss' AS faiss_index_file, 'chunks.parquet' AS chunks_parquet_file, count(*) AS num_vectors,
        'local' AS catalog, 'default' AS schema, 'embeddings' AS source_table,
        '2024-01-01T00:00:00Z' AS created_at_utc, true AS normalize_embeddings, 'inner_product' AS metric
        FROM embeddings"""
    fields = ", ".join(name for name in MANIFEST.fieldNames())
    no_fields = ", ".join(f"NULL::{'INTEGER' if f.dataType == INT else 'BIGINT' if f.dataType == LONG else 'BOOLEAN' if f.dataType == BOOL else 'VARCHAR'} AS {f.name}" for f in MANIFEST)
    content = _with("chunks", select="SELECT content FROM chunks")
    page = "text AS page_text FROM documents"
    assert content.count(page) == 1
    revised = content.replace(page, "CASE WHEN (doc_id + 1) % 7 = 3 THEN text || ' Revised.' ELSE text END AS page_text FROM documents")
    l2_hits = """SELECT query_id, vec_id AS faiss_id, round(CAST(distance AS DOUBLE), 6) AS score,
                    CAST(place - 1 AS INTEGER) AS rank
                FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place
                    FROM (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(q.embedding, e.embedding),
                        lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))) AS FLOAT) AS distance
                        FROM label_questions q CROSS JOIN embeddings e)) WHERE place <= 5"""
    return {
        "scan_pages": _with("raw_pages", select="SELECT * FROM raw_pages"),
        "page_counts": _with(
            "raw_pages", select="SELECT class_num, subject, count(*) AS n_pages FROM raw_pages GROUP BY ALL"
        ),
        "page_preview": _with("raw_pages", select="SELECT * FROM raw_pages ORDER BY filename, page_num LIMIT 5"),
        "filename_metadata": _with(
            "page_files",
            select=f"""SELECT page_num, filename, {_FILENAME} FROM (SELECT page_num, unnest([filename,
                regexp_replace(filename, '_.*_', '_'), 'page' || page_num || '.pdf']) AS filename FROM page_files)""",
        ),
        "page_clean": _with(
            "raw_pages",
            select=f"""SELECT * FROM (SELECT * REPLACE ({_clean('''(' ' || chr(9) || replace(page_text, chr(10),
                ' ' || chr(10) || chr(10) || chr(10) || chr(9) || ' ' || chr(10)) || chr(10) || chr(10))''')}
                AS page_text) FROM raw_pages) WHERE length(page_text) > 100""",
        ),
        "page_numbers": _with(
            "page_files",
            select="""SELECT filename, page_num AS file_num, CAST(generate_subscripts(lines, 1) AS INTEGER) AS page_num,
                unnest(lines) AS page_text
                FROM (SELECT filename, page_num, string_split(page_text, chr(10)) AS lines FROM page_files)""",
        ),
        "chapter_text": _with(
            "pages",
            select=f"""SELECT {_KEY}, CAST(page_num // 256 AS INTEGER) AS segment, CAST(count(*) AS INTEGER) AS n_pages,
                string_agg(page_text, chr(10)||chr(10) ORDER BY page_num) AS text FROM pages GROUP BY ALL""",
        ),
        "chunk_text": _with("split", select="SELECT * FROM split"),
        "chunk_rows": _with("chunks", select="SELECT * FROM chunks"),
        "chunks_partitioned_roundtrip": _with("chunks", select="SELECT * FROM chunks"),
        "scan_chunks_pruned": _with(
            "chunks", select="SELECT * FROM chunks WHERE class_num = '6' AND subject = 'social_science'"
        ),
        "embeddings_table": """SELECT 'v' || vec_id AS chunk_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER)
            AS axis, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM embeddings""",
        "index_table": _with("index_rows", select="SELECT * FROM index_rows"),
        "sanitize_columns": """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN microsecond(ts) % 1000000 = 0
                THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts,
                coalesce(event_type, '') AS event_type, coalesce(CAST(value AS VARCHAR), '') AS value,
                coalesce(CAST(value * 1e6 AS VARCHAR), '') AS large, coalesce(CAST(value * 1e14 AS VARCHAR), '') AS huge,
                coalesce(CAST(value / 1e6 AS VARCHAR), '') AS small,
                CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) ELSE '' END AS gaps,
                CASE WHEN event_type = 'view' THEN '' ELSE CAST(value AS VARCHAR) END AS holes,
                CASE WHEN value > 100 THEN 'True' ELSE 'False' END AS above FROM events""",
        "alignment_check": """WITH given AS (SELECT CASE WHEN vec_id % 10 = 9 THEN -vec_id
                    ELSE vec_id - vec_id % 50 % 2 END AS id FROM embeddings),
                both_sides AS (SELECT id, c.doc_id, count(*) AS n FROM given LEFT JOIN documents c ON doc_id = id GROUP BY ALL)
            SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM given) AS n_vectors,
                (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM given)) AS chunks_without_vector,
                (SELECT count(*) FROM both_sides WHERE doc_id IS NULL) AS vectors_without_chunk,
                (SELECT count(*) FROM both_sides WHERE n > 1) AS repeated_ids, false AS aligned""",
        "manifest": manifest,
        "manifest_read": manifest,
        "manifest_files": f"""WITH given AS ({manifest})
            SELECT {fields}, NULL::VARCHAR AS error, unnest(['good', 'extended']) AS kind FROM given
            UNION ALL SELECT {no_fields}, 'the manifest names no embedding model', 'nameless'
            UNION ALL SELECT {no_fields}, 'the manifest is not a whole JSON object', 'truncated'""",
        "positional_alignment": """WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents),
                v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings)
            SELECT count(*) FILTER (doc_id IS NOT NULL AND vec_id IS NOT NULL) AS n_positions,
                count(*) FILTER (doc_id = vec_id) AS same_id, count(*) FILTER (doc_id <> vec_id) AS other_id,
                count(*) FILTER (doc_id IS NULL OR vec_id IS NULL) AS without_partner,
                (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS matched_by_id
            FROM c FULL JOIN v ON c.place = v.place""",
        "corpus_vectors": """SELECT doc_id AS faiss_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS axis,
                round(CAST(unnest(list_transform(v, lambda x: CAST(x::DOUBLE / norm AS FLOAT))) AS DOUBLE), 6) AS x
            FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
                FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)) AS v FROM embeddings))
            JOIN documents ON doc_id = vec_id""",
        "library_rebuild": f"""WITH first AS ({content}), second AS ({revised})
            SELECT 1 AS version, count(*) AS n_chunks, count(DISTINCT content) AS n_contents, count(DISTINCT content) AS n_encoded,
                count(*) AS n_vectors FROM first
            UNION ALL SELECT 2, count(*), count(DISTINCT content),
                count(DISTINCT content) FILTER (content NOT IN (SELECT content FROM first)), count(*) FROM second
            UNION ALL SELECT 3, count(*), count(DISTINCT content), 0, count(*) FROM second""",
        "iso_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text FROM events",
        "l2_normalize": f"""SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS axis,
                round(CAST(unnest(CASE WHEN norm > 0 THEN list_transform(v, lambda x: CAST(x::DOUBLE / norm AS FLOAT)) ELSE v END)
                    AS DOUBLE), 6) AS x
            FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
                FROM (SELECT vec_id, {stretched} AS v FROM embeddings))""",
        "cosine_pairs": _with(
            "asked",
            select=f"""SELECT vec_id, query_id, round(list_inner_product({unit}, q.embedding::DOUBLE[]), 6) AS cosine,
                round(pow(list_distance(e.embedding::DOUBLE[], l.embedding::DOUBLE[]), 2), 6) AS distance
                FROM embeddings e JOIN asked q ON q.query_id = label * 10 + vec_id % 4 + 5
                JOIN label_questions l USING (query_id)""",
        ),
        "vector_search": _with(
            "net",
            "corpus_chunks",
            select="""SELECT query_id, c.*, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
                FROM net JOIN corpus_chunks c USING (faiss_id)""",
        ),
        "vector_search_l2": _with("label_questions", select=l2_hits),
        "vector_block_search": _with(
            "net",
            "label_questions",
            select=f"""SELECT query_id, faiss_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'inner_product' AS metric
                FROM net UNION ALL SELECT *, 'l2' AS metric FROM ({l2_hits})""",
        ),
        "vector_block_bounds": "SELECT vec_id AS faiss_id, true AS within_radius, true AS within_lengths FROM embeddings",
        "metadata_filter": _with(
            "filtered",
            select="""SELECT query_id, faiss_id, chunk_id, subject, class, chapter, round(score, 6) AS score,
                CAST(rank AS INTEGER) AS rank, target_subject, target_class FROM filtered WHERE k <= 7""",
        ),
        "retrieve": _with(
            "filtered",
            select="""SELECT query_id, faiss_id, chunk_id, text, subject, class, chapter, round(score, 6) AS score,
                CAST(rank AS INTEGER) AS rank, target_subject, target_class FROM filtered WHERE k <= 3""",
        ),
        "embed_chunks": _with(
            "chunk_vectors",
            select="""SELECT chunk_id, 512 AS dim, count(*) AS filled, round(sum(x::DOUBLE), 4) AS total,
                round(sum(x::DOUBLE * axis), 4) AS weighted FROM chunk_vectors GROUP BY chunk_id""",
        ),
        "ask_questions": _with(
            "text_hits",
            select=f"""SELECT query_id, question, target_subject, target_class, coalesce(n_hits, 0) AS n_hits,
                {_message_pair(
                    _text(prompts.ANSWER_RULE.replace("{tutor}", prompts.TUTOR)),
                    _fill(prompts.ANSWER_REQUEST, context="context", question="question"),
                    f"CASE WHEN n_hits IS NULL THEN {not_found} END")}
                FROM text_questions LEFT JOIN (SELECT query_id, CAST(count(*) AS INTEGER) AS n_hits,
                    string_agg(text, chr(10)||chr(10) ORDER BY k) AS context
                    FROM text_hits WHERE k <= 3 GROUP BY query_id) USING (query_id)""",
        ),
        "rag_prompt": _with(
            "contexts",
            select=f"""SELECT query_id, question, target_subject, target_class, coalesce(n3, 0) AS n_hits,
                {_message_pair(
                    _text(prompts.ANSWER_RULE.replace("{tutor}", TUTOR)),
                    _fill(prompts.ANSWER_REQUEST, context="context3", question="question"),
                    f"CASE WHEN n3 IS NULL THEN {not_found} END")}
                FROM label_questions LEFT JOIN contexts USING (query_id)""",
        ),
        "spoken_prompt": _with(
            "contexts",
            select=f"""SELECT query_id, unnest([0, 1]) AS position, unnest(['system', 'user']) AS role, unnest([
                {_fill(prompts.SPOKEN_RULE.replace("{tutor}", TUTOR), language=f"{names}[query_id % 11 + 1]")},
                {_fill(prompts.SPOKEN_REQUEST, context="context3", question="question")}]) AS content
                FROM label_questions JOIN contexts USING (query_id)""",
        ),
        "rag_user_message": f"""SELECT doc_id, 'Context:' || chr(10) || array_to_string(list_filter(list_transform(
                string_split(text, chr(10)), lambda line, i: CASE WHEN (i - 1) % 5 < 3 THEN {_strip('line')} END),
                lambda line: line <> ''), chr(10)||chr(10)) || chr(10) || chr(10) || 'Question: What does ' || source || ' say?'
            AS message FROM documents""",
        "quiz_prompt": _with(
            "contexts",
            select=f"""SELECT query_id, {topic} AS topic, target_subject, target_class, {level} AS difficulty,
                CAST(query_id % 7 + 1 AS INTEGER) AS num_questions, coalesce(n5, 0) AS n_hits,
                {_message_pair(
                    _fill(prompts.QUIZ_RULE, difficulty_rule=level_rule),
                    _fill(prompts.QUIZ_REQUEST, **about, difficulty=f"coalesce({level}, 'Medium')", num_questions="(query_id % 7 + 1)",
                          context="context5"),
                    quiz_error)}
                FROM label_questions LEFT JOIN contexts USING (query_id)""",
        ),
        "chat_history": _with(
            "asked_turns",
            select=f"""SELECT conv_id, asked_turn, CAST(-1 AS BIGINT) AS turn, 'system' AS role,
                    {_text(prompts.CHAT_RULE.replace("{tutor}", TUTOR))} AS content FROM asked_turns
                UNION ALL SELECT conv_id, asked_turn, turn, role, text FROM conversations JOIN asked_turns USING (conv_id)
                WHERE (turn < asked_turn AND (role = 'user' OR (role = 'assistant' AND text <> '')))
                    OR (turn = asked_turn AND role = 'user')""",
        ),
        "transcript": f"""SELECT conv_id, CAST(0 AS BIGINT) AS segment, CAST(coalesce(n, 0) AS INTEGER) AS n_pairs,
                coalesce(said, {_text(prompts.CHAT_SAMPLE)}) AS text
            FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT u.conv_id, count(*) AS n,
                string_agg('> **Student:** ' || u.text || chr(10) || chr(10) || '**{TUTOR}:** ' || a.text
                    || chr(10) || chr(10), chr(10)||chr(10) ORDER BY u.turn) AS said
                FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
                WHERE u.role = 'user' AND a.role = 'assistant' GROUP BY u.conv_id) USING (conv_id)""",
        "answer_fallback": _with(
            "replies",
            select=f"""SELECT request_id, coalesce(content, second) AS answer, CASE WHEN content IS NOT NULL THEN 'first'
                    WHEN second IS NOT NULL THEN 'second' END AS model, CASE WHEN content IS NULL AND second IS NULL
                    THEN 'no model answered' END AS error
                FROM (SELECT *, CASE WHEN request_id % 3 = 0 THEN 'second answer to ' || request_id END AS second FROM replies)""",
        ),
        "parse_think": _with(
            "replies",
            select=f"""SELECT request_id, CASE WHEN thinks THEN 'about' || chr(10) || 'assistant' END AS thinking,
                CASE WHEN thinks THEN {_strip('text')} ELSE text END AS answer, {_strip('text')} AS spoken
                FROM replies WHERE answered""",
        ),
        "response_content": _with(
            "replies",
            select=f"""SELECT request_id, {_strip('content')} AS content,
                CASE WHEN NOT answered THEN 'unexpected reply: {{"error": "busy"}}' END AS error FROM replies""",
        ),
        "translation_text": f"""SELECT conv_id, turn, CASE WHEN {number} % 5 < 3 THEN nullif({_strip('text')}, '')
            WHEN {number} % 5 = 3 THEN CAST(turn AS VARCHAR) END AS translated FROM conversations""",
        "transcript_fields": f"""SELECT conv_id, turn, CASE WHEN {number} % 3 = 1 THEN '' ELSE text END AS transcript,
            CASE WHEN {number} % 3 = 0 THEN 'en' WHEN {number} % 2 = 0 THEN 'hi-IN' ELSE 'ta' END AS language_code
            FROM conversations""",
        "payload_decode": """SELECT conv_id, turn, CAST(strlen(text) AS INTEGER) AS n_bytes, text AS recorded, text AS spoken
            FROM conversations""",
        "quiz_json_slice": _with("slices", select="SELECT quiz_id, slice FROM slices"),
        "quiz_validate": _with("quizzes", select="SELECT * FROM quizzes"),
        "quiz_questions": _with(
            "questions", select="SELECT * REPLACE (array_to_string(options, '|') AS options) FROM questions"
        ),
        "quiz_render_rows": _with(
            "questions",
            "page_files",
            select=f"""SELECT quiz_id, q_idx + 1 AS question_num, question, CAST(generate_subscripts(options, 1) - 1 AS INTEGER)
                    AS o_idx, substr(unnest(options), 1, 1) AS letter, unnest(options) AS option, subject_title
                FROM questions JOIN (SELECT page_num - 1 AS quiz_id, {title} AS subject_title
                    FROM (SELECT page_num, {_FILENAME} FROM page_files)) USING (quiz_id)""",
        ),
        "quiz_answer_key": _with(
            "questions",
            select="SELECT quiz_id, q_idx + 1 AS question_num, question, correct_answer, explanation FROM questions",
        ),
        "quiz_grade": _with("grades", select="SELECT * FROM grades"),
        "quiz_score": _with(
            "grades",
            select="""SELECT quiz_id, CAST(coalesce(good, 0) AS INTEGER) AS correct_count,
                    CAST(coalesce(n, 0) AS INTEGER) AS total_questions, round(good / n * 100, 6) AS score
                FROM quizzes LEFT JOIN (SELECT quiz_id, count(*) FILTER (is_correct) AS good, count(*) AS n
                    FROM grades GROUP BY quiz_id) USING (quiz_id) WHERE success""",
        ),
        "quiz_library": _with("quiz_library", select="SELECT * FROM quiz_library"),
        "quiz_report": _with(
            "quiz_sent",
            select="""SELECT quiz_id, topic, target_subject, target_class, difficulty, CAST(good AS INTEGER) AS correct_count,
                    num_questions AS total_questions, round(good / num_questions * 100, 6) AS score
                FROM (SELECT *, len(list_filter(range(num_questions),
                        lambda k: k % 3 <> 2 AND (quiz_id + k) % 4 = (length(request) + k) % 4)) AS good
                    FROM quiz_sent WHERE request IS NOT NULL)""",
        ),
        "detect_language": f"""SELECT conv_id, turn, CASE {scripts} ELSE 'en' END AS language
            FROM (SELECT conv_id, turn, {said} AS said FROM conversations)""",
        "language_codes": f"""SELECT doc_id, coalesce({_case(SPEECH_CODES, "substr(CASE WHEN coalesce(code, '') = '' THEN 'en' ELSE code END, 1, 2)")},
            'en-IN') AS speech_code, coalesce({_case(DISPLAY_NAMES, 'substr(code, 1, 2)')}, code) AS language_name
            FROM (SELECT doc_id, {code} AS code FROM documents)""",
        "clean_speech_a": f"""SELECT doc_id, spoken, substr(spoken, 1, 500) AS cut, substr(spoken, 1, 2500) AS request_cut
            FROM ({spoken_a})""",
        "clean_speech_b": f"""SELECT doc_id, substr({_speech(PLAIN_SPEECH_RULES)}, 1, 2400) AS spoken FROM documents""",
    }
