import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import embedding, index
from chalkline.operators.search import L2
from chalkline.plans.library import ask, build_library
from chalkline.schemas import CHUNKS, MANIFEST, RAW_PAGES
from chalkline.sources import listing, manifest, tables


def chunk_frame(spark, rows):
    full = [(f"k{n}", text, class_, subject, "1", n, "f", 1) for n, (text, class_, subject) in enumerate(rows)]
    return spark.createDataFrame(full, CHUNKS)


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_dense_ids(spark, partitions):
    keys = [f"k{(n * 7919) % 1000:04d}{n}" for n in range(400)]
    frame = spark.createDataFrame([(key, n) for n, key in enumerate(keys)], "key string, n int")
    rows = index.with_dense_id(frame, "key", "id", partitions)
    assert rows.columns == ["id", "key", "n"]
    assert [r["key"] for r in sorted(rows.collect(), key=lambda r: r["id"])] == sorted(keys)
    assert sorted(r["id"] for r in rows.collect()) == list(range(400))


def test_dense_ids_of_nothing(spark):
    frame = spark.createDataFrame([], "key string")
    assert index.with_dense_id(frame, "key").count() == 0


def test_files_that_claim_the_same_chapter(spark):
    rows = [("k0", "a", "5", "s", "1", 0, "f", 1), ("k0", "b", "5", "s", "1", 0, "g", 1)]
    found = index.index_table(spark.createDataFrame(rows, CHUNKS)).orderBy("faiss_id").collect()
    assert [(r["faiss_id"], r["text"]) for r in found] == [(0, "a"), (1, "b")]


def test_index_table_names(spark):
    table = index.index_table(chunk_frame(spark, [("a", "5", "s"), ("b", "6", "t")]))
    assert table.columns[:5] == ["faiss_id", "chunk_id", "text", "class", "subject"]


def test_alignment(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    same = index.alignment(chunks, chunks).first()
    assert same["aligned"] and same["n_chunks"] == same["n_vectors"] == 3
    other = spark.createDataFrame([("b",), ("c",), ("c",), ("d",)], "chunk_id string")
    assert tuple(index.alignment(chunks, other).first()) == (3, 4, 1, 1, 1, False)
    none = index.alignment(chunks.limit(0), other.limit(0)).first()
    assert tuple(none) == (0, 0, 0, 0, 0, True)


def test_corpus_vectors_go_by_chunk_id(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "faiss_id long, chunk_id string")
    given = spark.createDataFrame([("c", [0.0, 2.0]), ("a", [3.0, 4.0])], "chunk_id string, embedding array<float>")
    found = {r["faiss_id"]: r["embedding"] for r in index.corpus_vectors(ids, given).collect()}
    assert found == {0: pytest.approx([0.6, 0.8]), 2: [0.0, 1.0]}


def test_manifest_roundtrip(spark, tmp_path):
    given = spark.createDataFrame([([1.0, 2.0],), ([0.0, 1.0],)], "embedding array<float>")
    made = index.manifest(given, "m", "c", "s", "t", normalize=False, created_at=F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    row = made.first()
    assert (row["embedding_dim"], row["num_vectors"], row["metric"]) == (2, 2, L2)
    assert row["created_at_utc"] == "2024-05-06T07:08:09Z"
    manifest.write_manifest(made, str(tmp_path / "manifest"))
    assert manifest.read_manifest(spark, str(tmp_path / "manifest")).first() == row


def test_manifest_defaults(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"embedding_model": "m", "num_vectors": 3, "unknown": 1}, indent=2))
    row = manifest.read_manifest(spark, str(path)).first()
    assert row.asDict().keys() == set(MANIFEST.fieldNames())
    assert (row["num_vectors"], row["normalize_embeddings"], row["metric"]) == (3, True, "inner_product")


def test_chunks_keep_class_text_and_prune_folders(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunks = chunk_frame(spark, [("a", "07", "s"), ("b", "7", "s"), ("c", "7", "t")])
    tables.write_chunks(chunks, path)
    back = tables.read_chunks(spark, path)
    assert back.schema == CHUNKS
    assert {(r["content"], r["class_num"]) for r in back.collect()} == {("a", "07"), ("b", "7"), ("c", "7")}
    pruned = back.filter("class_num = '7' AND subject = 't'")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(class_num" in plan
    assert [r["content"] for r in pruned.collect()] == ["c"]


def test_pages_roundtrip(spark, tmp_path):
    pages = spark.createDataFrame([("f", "5", "s", "1", 1, "text")], RAW_PAGES)
    tables.write_table(pages, str(tmp_path / "pages"))
    assert tables.read_pages(spark, str(tmp_path / "pages")).collect() == pages.collect()


def test_write_if_absent(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_if_absent(spark.range(3), path)
    tables.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_listing(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_text(name)
    found = listing.list_files(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("a.pdf", 5), ("b.pdf", 5)]


def test_embed_with_another_model(spark):
    class Lengths:
        """A model with two dimensions; defined here, so that it is sent along by value."""

        dimension = 2

        def __init__(self, name):
            self.name = name

        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts], np.float64)

    texts = spark.createDataFrame([(1, "abc"), (2, None)], "n long, t string")
    found = {r["n"]: r["embedding"] for r in embedding.embed(texts, "n", "t", Lengths, "x", normalize=False).collect()}
    assert found == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_embed_reads_two_columns(spark, tmp_path):
    tables.write_table(chunk_frame(spark, [("a", "5", "s")]), str(tmp_path / "chunks"))
    plan = embedding.embed(spark.read.parquet(str(tmp_path / "chunks")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chunk_id:string,content:string>" in plan


def test_embed_batches_and_unit_length(spark):
    texts = spark.createDataFrame([(str(n), f"word{n} the The the") for n in range(100)] + [("x", "...")], "chunk_id string, content string")
    rows = embedding.embed(texts.coalesce(1), batch_size=7).collect()
    lengths = {r["chunk_id"]: np.linalg.norm(r["embedding"]) for r in rows}
    assert lengths.pop("x") == 0
    assert len(lengths) == 100 and all(abs(length - 1) < 1e-6 for length in lengths.values())
    assert all(len(r["embedding"]) == embedding.DIMENSION for r in rows)


@pytest.mark.parametrize("normalize", [True, False])
def test_library_from_pages_to_prompts(spark, tmp_path, normalize):
    texts = ["Plants make sugar from light. " * 5, "Rivers carry water to the sea. " * 5]
    pages = spark.createDataFrame(
        [(f"class6_science_ch{n}.pdf", "6", "science", str(n), 1, text) for n, text in enumerate(texts)], RAW_PAGES
    )
    library = build_library(pages, str(tmp_path), normalize=normalize)
    assert library.manifest().first()["num_vectors"] == library.index().count() == 2
    assert library.manifest().first()["metric"] == ("inner_product" if normalize else L2)
    questions = spark.createDataFrame(
        [(1, " how do plants use light ", "sci", "6"), (2, "rivers", "science", "7")],
        "query_id long, question string, target_subject string, target_class string",
    )
    first, second = ask(library, questions, k=1).orderBy("query_id").collect()
    assert first["n_hits"] == 1 and "Plants make sugar" in first["messages"][1]["content"]
    assert second["messages"] is None and "Class 7 science" in second["error"]
