"""The index table, its vectors and its manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.text import safe_text, utc_text
from chalkline.functions.vectors import l2_normalize
from chalkline.operators.search import INNER_PRODUCT, L2
from chalkline.schemas import MANIFEST
from chalkline.session import checkpoint_root

# Names of the chunk table's columns in the index table.
INDEX_NAMES = {"class_num": "class", "content": "text"}

INDEX_FILE, CHUNKS_FILE = "corpus.faiss", "chunks.parquet"


def with_dense_id(
    table: DataFrame, key: str | list[str], name: str = "faiss_id", partitions: int | None = None
) -> DataFrame:
    """``name`` = 0..n-1 in the order of ``key``, as the first column; the key is unique.

    A window without partitions would number the whole table in one task. Here the keys alone
    are range partitioned and numbered inside their partition; the partition sizes, one row per
    partition, give the offsets. The numbered keys are checkpointed, so both uses, and a rerun
    after a lost executor, see the same ranges.
    """
    spark = table.sparkSession
    checkpoint_root(spark)
    key = [key] if isinstance(key, str) else key
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    keys = (
        table.select(*key)
        .repartitionByRange(parts, *key)
        .sortWithinPartitions(*key)
        .select(
            *key,
            F.shiftright(row, 33).alias("_part"),
            row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
        .checkpoint()
    )
    # One row per range partition, so one task can add them up and every task can hold the sums.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keys.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    numbered = keys.join(F.broadcast(offsets), "_part").select(
        *key, (F.col("_offset") + F.col("_place")).alias(name)
    )
    # Null-safe, so a row whose key is partly null is numbered, too.
    sides = numbered.withColumnsRenamed({column: f"_{column}" for column in key})
    same = reduce(Column.__and__, [F.col(column).eqNullSafe(F.col(f"_{column}")) for column in key])
    return table.join(sides, same).select(name, *table.columns)


def index_table(chunks: DataFrame) -> DataFrame:
    """The chunk table under its index names, with a dense id in front.

    A chunk id repeats only when two files claim the same chapter, so the file completes the key.
    """
    return with_dense_id(chunks.withColumnsRenamed(INDEX_NAMES), ["chunk_id", "source_file"])


def sanitized(table: DataFrame) -> DataFrame:
    """Every column as text; null and NaN become the empty string."""
    return table.select(
        *[safe_text(F.col(f.name), f.dataType.typeName()).alias(f.name) for f in table.schema]
    )


def normalized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, l2_normalize(F.col(column)))


def corpus_vectors(
    index: DataFrame, embeddings: DataFrame, normalize: bool = True
) -> DataFrame:
    """``faiss_id, embedding`` of every chunk that has a vector; the two are matched by chunk id."""
    matched = index.select("faiss_id", "chunk_id").join(embeddings, "chunk_id")
    matched = matched.select("faiss_id", "embedding")
    return normalized(matched) if normalize else matched


def content_digest(text: Column) -> Column:
    """What a vector is made from, in 32 bytes; null counts as empty, as it does to a model."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_position(stored: DataFrame, name: str = "position") -> DataFrame:
    """``stored``, rows read from files, numbered 0..n-1 in the order of their files' names and their places in them."""
    file, row = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    return with_dense_id(stored.select("*", file, row), ["_file", "_row"], name).drop("_file", "_row")


def positional_alignment(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row of counts of what goes wrong if stored vectors are given to stored chunks by position.

    Positions both tables have, those whose chunk ids agree and differ, positions only one table has, and the chunks
    that get a vector by their id, which is how ``corpus_vectors`` joins them.
    """
    left = with_position(chunks.select("chunk_id", "_metadata"))
    right = with_position(embeddings.select(F.col("chunk_id").alias("vector_id"), "_metadata"))
    both = left.drop("_metadata").join(right.drop("_metadata"), "position", "full")
    met = F.col("chunk_id").isNotNull() & F.col("vector_id").isNotNull()
    by_id = chunks.select("chunk_id").join(embeddings.select("chunk_id").distinct(), "chunk_id").agg(F.count("*").alias("matched_by_id"))
    counts = both.agg(
        F.count_if(met).alias("n_positions"),
        F.count_if(met & (F.col("chunk_id") == F.col("vector_id"))).alias("same_id"),
        F.count_if(met & (F.col("chunk_id") != F.col("vector_id"))).alias("other_id"),
        F.count_if(~met).alias("without_partner"),
    )
    return counts.join(F.broadcast(by_id))  # one row each


def alignment(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row of counts: chunks, vectors, and the chunk ids that only one side has.

    Both sides are counted down to one row per id before they meet, on the map side first, so
    repeated ids cost nothing.
    """
    sides = chunks.select("chunk_id", F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(
        embeddings.select("chunk_id", F.lit(0).alias("c"), F.lit(1).alias("v"))
    )
    per_id = sides.groupBy("chunk_id").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    return per_id.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_vectors"),
        F.count_if(F.col("v") == 0).alias("chunks_without_vector"),
        F.count_if(F.col("c") == 0).alias("vectors_without_chunk"),
        F.count_if((F.col("c") > 1) | (F.col("v") > 1)).alias("repeated_ids"),
    ).withColumn(
        "aligned",
        (F.col("chunks_without_vector") == 0)
        & (F.col("vectors_without_chunk") == 0)
        & (F.col("repeated_ids") == 0),
    )


def manifest(
    embeddings: DataFrame,
    embedding_model: str,
    catalog: str,
    schema: str,
    source_table: str,
    normalize: bool = True,
    created_at: Column | None = None,
    index_file: str = INDEX_FILE,
    chunks_file: str = CHUNKS_FILE,
) -> DataFrame:
    """One row that describes the index built from ``embeddings``, which all have one dimension.

    The number of vectors needs no column and comes from the files' footers; one row gives the dimension.
    """
    created_at = F.current_timestamp() if created_at is None else created_at
    fixed = {
        "embedding_model": embedding_model,
        "faiss_index_file": index_file,
        "chunks_parquet_file": chunks_file,
        "catalog": catalog,
        "schema": schema,
        "source_table": source_table,
        "normalize_embeddings": normalize,
        "metric": INNER_PRODUCT if normalize else L2,
    }
    one = embeddings.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    dimension = F.lit(one[0] if one else None).cast("int")
    return (
        embeddings.agg(F.count("*").alias("num_vectors"))
        .withColumn("embedding_dim", dimension)
        .withColumns({name: F.lit(value) for name, value in fixed.items()})
        .withColumn("created_at_utc", utc_text(created_at))
        .select(*MANIFEST.fieldNames())
    )
