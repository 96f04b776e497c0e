import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chalkline.operators import index
from chalkline.plans.incremental import current, finished_versions, update_library
from chalkline.plans.library import ask, build_library, build_vectors
from chalkline.schemas import RAW_PAGES
from chalkline.sources import manifest



def pages_of(spark, texts):
    rows = [(f"class6_science_ch{n}.pdf", "6", "science", str(n), 1, text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, RAW_PAGES)


def encoded(folder):
    found = sorted(line for file in folder.iterdir() for line in file.read_text().splitlines())
    for file in folder.iterdir():
        file.write_text("")
    return found


def test_only_new_texts_are_encoded(spark, tmp_path):
    class Counting:
        """Word lengths as a vector; each call leaves the texts it was given in a file."""

        dimension = 2
        folder = ""

        def __init__(self, name):
            self.folder, self.name = name.rsplit(":", 1)

        def encode(self, texts):
            import uuid
            from pathlib import Path

            Path(self.folder, uuid.uuid4().hex).write_text("\n".join(texts))
            return np.array([[len(t), len(self.name)] for t in texts], np.float32)

    calls = tmp_path / "calls"
    calls.mkdir()
    root, model = str(tmp_path / "library"), f"{calls}:m"
    build = lambda texts, name=model: update_library(pages_of(spark, texts), root, Counting, name, normalize=False)
    assert current(spark, root) is None
    first = build(["apples", "pears", "apples"])
    assert (first.version, first.n_chunks, first.n_encoded) == (1, 3, 2) and encoded(calls) == ["apples", "pears"]
    # One chapter goes, one is new before all others, so every id moves.
    second = build(["plums", "apples", "pears", "apples"])
    assert (second.version, second.n_chunks, second.n_encoded) == (2, 4, 1) and encoded(calls) == ["plums"]
    third = build(["plums"])
    assert (third.n_chunks, third.n_encoded) == (1, 0) and encoded(calls) == []
    fourth = build(["apples", ""])  # nothing of the earlier versions was thrown away
    assert fourth.n_encoded == 0 and encoded(calls) == []
    other = build(["plums"], f"{calls}:other")
    assert (other.version, other.n_encoded) == (5, 1) and encoded(calls) == ["plums"]
    for made in (first, second, third, fourth):
        rows = made.library.index().join(made.library.vectors(), "faiss_id", "left").collect()
        assert len(rows) == made.n_chunks and all(r["embedding"] == [len(r["text"]), 1.0] for r in rows)
    assert current(spark, root).folder == other.library.folder
    assert [r["version"] for r in finished_versions(spark, root).orderBy("version").collect()] == [1, 2, 3, 4, 5]


def test_a_build_that_broke_off_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    first = update_library(pages_of(spark, ["apples"]), root)

    class Broken:
        dimension = 1

        def __init__(self, name):
            pass

        def encode(self, texts):
            raise ValueError("no model today")

    with pytest.raises(Exception, match="no model today"):
        update_library(pages_of(spark, ["apples", "pears"]), root, Broken)
    assert current(spark, root).folder == first.library.folder
    again = update_library(pages_of(spark, ["apples", "plums"]), root)
    assert (again.version, again.n_chunks, again.n_encoded) == (2, 2, 1)


def test_versions_answer_as_a_fresh_library_does(spark, tmp_path):
    texts = ["Plants make sugar from light. " * 5, "Rivers carry water to the sea. " * 5, "Stones are old. " * 30]
    update_library(pages_of(spark, texts[:2]), str(tmp_path / "versions"))
    made = update_library(pages_of(spark, texts), str(tmp_path / "versions"))
    fresh = build_library(pages_of(spark, texts), str(tmp_path / "fresh"))
    questions = spark.createDataFrame(
        [(1, "plants light", "sci", "6"), (2, "old stones", "science", "6")],
        "query_id long, question string, target_subject string, target_class string",
    )
    assert ask(made.library, questions, k=2).orderBy("query_id").collect() == ask(fresh, questions, k=2).orderBy("query_id").collect()


def test_empty_table_of_pages(spark, tmp_path):
    made = update_library(pages_of(spark, []), str(tmp_path))
    assert (made.version, made.n_chunks, made.n_encoded) == (1, 0, 0)


def test_a_build_leaves_no_shuffles_and_stores_small_files(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = {file.getName() for file in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())}
        return {name for name in names if name.startswith("shuffle_")}

    earlier, settings = shuffles(), dict(spark.conf.getAll)
    texts = [f"Text {n} of this book. " * 9 for n in range(40)]
    for _ in range(2):
        made = update_library(pages_of(spark, texts), str(tmp_path))
    until = time.time() + 20  # executors are told to remove the files, and not waited for
    while shuffles() - earlier and time.time() < until:
        time.sleep(0.1)
    left = shuffles() - earlier
    assert not left, left
    assert dict(spark.conf.getAll) == settings
    for name in ("chunks", "index", "vectors", "contents"):
        for file in Path(made.library.path(name)).rglob("*.parquet"):
            groups = pq.ParquetFile(file).metadata
            assert {groups.row_group(at).column(0).compression for at in range(groups.num_row_groups)} <= {"ZSTD"}, name


def test_stale_vectors_are_made_anew(spark, tmp_path):
    library = build_library(pages_of(spark, ["apples and pears", "rivers"]), str(tmp_path))
    assert build_vectors(library) is False
    before = {r["faiss_id"]: r["embedding"] for r in library.vectors().collect()}
    changed = library.index().withColumn("text", F.when(F.col("faiss_id") == 0, "plums and figs").otherwise(F.col("text"))).collect()
    schema = library.index().schema
    spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(library.path("index"))
    assert build_vectors(library) is True  # as many chunks as before
    after = {r["faiss_id"]: r["embedding"] for r in library.vectors().collect()}
    assert after[0] != before[0] and after[1] == before[1]
    assert build_vectors(library) is False


def test_broken_manifests(spark, tmp_path):
    good = '{"embedding_model": "m", "num_vectors": 3, "unknown": {"a": 1}}'
    for name, content in {"good": good, "cut": good[:-7], "list": "[1, 2]", "text": "no json", "nameless": '{"num_vectors": 3}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.json").write_text(content)
    found = {r["path"].split("/")[-2]: r for r in manifest.read_manifests(spark, f"{tmp_path}/*").collect()}
    assert {name for name, row in found.items() if row["error"] is None} == {"good"}
    assert (found["good"]["num_vectors"], found["good"]["normalize_embeddings"], found["good"]["metric"]) == (3, True, "inner_product")
    assert all(found["cut"][name] is None for name in ("embedding_model", "num_vectors", "metric", "normalize_embeddings"))
    assert manifest.read_manifest(spark, f"{tmp_path}/good").first()["embedding_model"] == "m"
    with pytest.raises(Exception, match="not a whole JSON object"):
        manifest.read_manifest(spark, f"{tmp_path}/cut").collect()


def test_positions_and_ids(spark, tmp_path):
    chunks = spark.createDataFrame([(f"k{i}",) for i in range(20)], "chunk_id string").repartitionByRange(4, "chunk_id").sortWithinPartitions("chunk_id")
    given = spark.createDataFrame([(f"k{i}", [1.0]) for i in range(18)], "chunk_id string, embedding array<float>")
    chunks.write.parquet(str(tmp_path / "chunks"))
    given.where("chunk_id <> 'k10'").repartitionByRange(3, "chunk_id").sortWithinPartitions("chunk_id").write.parquet(str(tmp_path / "vectors"))
    stored, vectors = spark.read.parquet(str(tmp_path / "chunks")), spark.read.parquet(str(tmp_path / "vectors"))
    assert [r["chunk_id"] for r in index.with_position(stored).orderBy("position").collect()] == sorted(f"k{i}" for i in range(20))
    row = index.positional_alignment(stored, vectors).first()
    # k0 and k1 come before the missing k10; all others are off by one.
    assert tuple(row) == (17, 2, 15, 3, 17)
