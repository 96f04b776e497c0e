"""Fixed schemas of the tables the jobs read and write."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRING, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
VECTOR = T.ArrayType(T.FloatType())

CHAPTER_KEYS = ["class_num", "subject", "chapter", "filename"]

RAW_PAGES = _struct(
    ("filename", STRING),
    ("class_num", STRING),
    ("subject", STRING),
    ("chapter", STRING),
    ("page_num", INT),
    ("page_text", STRING),
)

CHUNKS = _struct(
    ("chunk_id", STRING),
    ("content", STRING),
    ("class_num", STRING),
    ("subject", STRING),
    ("chapter", STRING),
    ("chunk_sequence", INT),
    ("source_file", STRING),
    ("word_count", INT),
)

EMBEDDINGS = _struct(("chunk_id", STRING), ("embedding", VECTOR))

MANIFEST = _struct(
    ("embedding_model", STRING),
    ("embedding_dim", INT),
    ("faiss_index_file", STRING),
    ("chunks_parquet_file", STRING),
    ("num_vectors", LONG),
    ("catalog", STRING),
    ("schema", STRING),
    ("source_table", STRING),
    ("created_at_utc", STRING),
    ("normalize_embeddings", BOOL),
    ("metric", STRING),
)

MESSAGE = _struct(("role", STRING), ("content", STRING))

QUESTION = _struct(
    ("question", STRING),
    ("options", T.ArrayType(STRING)),
    ("correct_answer", STRING),
    ("explanation", STRING),
)
