"""Quality by the votes of labelled neighbours in a latent space."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks as B

TRIGRAMS = 2048  # cells of hashed byte trigrams
REPEATED = (0.02, 0.1, 0.25, 0.5)  # bounds of the share of words that repeat the word before
FEATURES = TRIGRAMS + len(REPEATED) + 1
LATENT = 64
NEIGHBOURS = 25
SHARPNESS = 12.0  # a neighbour votes with its cosine to this power
SAMPLE_ROWS = 4096  # labelled rows that are kept; the rest of the labels is not used
PRIOR_WEIGHT = 0.02  # of the mean label among the votes; decides for texts without any neighbour
THRESHOLD = 0.3
_BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Model:
    """Bounded by SAMPLE_ROWS, FEATURES and LATENT whatever the corpus; about 2 MB."""

    weights: np.ndarray  # of each feature
    axes: np.ndarray  # features x latent
    vectors: np.ndarray  # unit vectors of the labelled rows
    labels: np.ndarray
    prior: float


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed trigram counts of each text, and one cell for its share of repeated words."""
    data, offsets = B.text_bytes(batch.column("text"))
    rows = len(offsets) - 1
    cells = np.zeros((rows, FEATURES), dtype=np.float32)
    if not len(data):
        return cells
    words, firsts = B.words_of(data, offsets, lower=False)
    hashes = B.word_hashes(words)
    again = np.concatenate([[0], np.cumsum(hashes[1:] == hashes[:-1])]) if len(hashes) else np.zeros(1, np.int64)
    n_words = np.diff(firsts)
    texts = np.flatnonzero(n_words)
    share = (again[firsts[1:][texts] - 1] - again[firsts[:-1][texts]]) / n_words[texts]
    cells[texts, TRIGRAMS + np.searchsorted(REPEATED, share, side="right")] = 1
    if len(data) < 3:
        return cells
    code = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    cell = ((code * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
    owner = np.repeat(np.arange(rows) * TRIGRAMS, np.diff(offsets))[:-2]
    inside = np.ones(len(cell), dtype=bool)
    for back in (1, 2):  # trigrams that would reach into the next text
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(cell))]] = False
    counts = np.bincount((owner + cell)[inside], minlength=rows * TRIGRAMS)
    cells[:, :TRIGRAMS] = counts.reshape(rows, TRIGRAMS)
    return cells


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.text_blocks(batches, "text"):
        for at in range(0, batch.num_rows, _BLOCK_ROWS):
            yield batch.slice(at, _BLOCK_ROWS)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    trigrams = _unit(np.log1p(counts[:, :TRIGRAMS]) * weights)
    return _unit(np.hstack([trigrams, counts[:, TRIGRAMS:]]))


def _learnt(labels: np.ndarray, counts: np.ndarray) -> Model:
    """The weights of cells, the latent axes and the labelled rows on them; an eigendecomposition of the cells' products."""
    if not len(labels):
        empty = np.zeros((0, LATENT), np.float32)
        return Model(np.ones(TRIGRAMS, np.float32), np.zeros((FEATURES, LATENT), np.float32), empty, labels, 0.5)
    weights = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts[:, :TRIGRAMS], axis=0))).astype(np.float32) + 1
    matrix = _weighted(counts, weights)
    values, axes = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    axes = axes[:, np.argsort(-values)[:LATENT]].astype(np.float32)
    return Model(weights, axes, _unit(matrix @ axes), labels, float(labels.mean()))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """A model of the texts of ``docs`` whose ids ``labels`` gives a label of 0 or 1.

    Of the labels, those of the ``sample_rows`` smallest hashes of ids are used, which depends on ids alone. Only these few
    ids meet the documents, in the scan, and only the cells of their texts, at most ``sample_rows`` rows of FEATURES numbers,
    are sent to the one task that fits; the driver gets the model. Rows without a label or id take no part; a null text
    counts as empty. Without any labelled row every text scores one half.
    """
    given = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label")).dropna()
    few = given.withColumn("at", F.xxhash64("id", F.lit("sample"))).orderBy("at", "id", "label").limit(sample_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            counts = _counts(batch)
            cells = B.slices(counts.view(np.uint8).ravel(), np.arange(len(counts) + 1) * (4 * FEATURES)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), cells], names=["at", "label", "cells"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(batch.column(0).to_numpy(), B.text_bytes(batch.column(1))[0]) for batch in batches]
        labels = np.concatenate([x[0] for x in found] or [np.zeros(0)]).astype(np.float32)
        counts = np.concatenate([x[1] for x in found] or [np.zeros(0, np.uint8)]).view(np.float32).reshape(-1, FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_learnt(labels, counts))], pa.binary())], names=["model"])

    met = rows.join(F.broadcast(few), "id").select("at", "label", "text")
    cells = met.mapInArrow(features, "at long, label double, cells binary")
    # Ids may repeat among the documents; the bound holds all the same.
    bounded = cells.orderBy("at", "cells", "label").limit(sample_rows).select("label", "cells").coalesce(1)
    found = bounded.mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else _learnt(np.zeros(0, np.float32), np.zeros((0, FEATURES), np.float32))


def _votes(vectors: np.ndarray, model: Model) -> np.ndarray:
    """The mean label of the nearest labelled vectors, weighted by similarity."""
    if not len(model.labels):
        return np.full(len(vectors), model.prior)
    cosine = vectors @ model.vectors.T
    k = min(NEIGHBOURS, len(model.labels))
    # All neighbours as near as the k-th vote, so ties do not depend on the order of the rows.
    bound = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    power = np.where(cosine >= bound, np.maximum(cosine, 0), 0) ** SHARPNESS
    total = power.sum(axis=1, dtype=np.float64)
    good = (power @ model.labels).astype(np.float64)
    return np.clip((good + PRIOR_WEIGHT * model.prior) / (total + PRIOR_WEIGHT), 0, 1)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, higher where label 1 is likelier.

    Whole texts are read. Empty and null texts score the mean label. All columns stay; one that has the name
    of the score is replaced. Equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = [c for c in docs.columns if c != name]
    source = docs.select(F.struct(*[docs[c] for c in held]).alias("row"), docs[text].alias("text"))
    schema = source.schema["row"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in _small(batches):
            vectors = _unit(_weighted(_counts(batch), model.weights) @ model.axes)
            scores = pa.array(_votes(vectors, model), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), scores], names=["row", "score"])

    scored = source.mapInArrow(run, f"row {schema}, score double")
    return scored.select(*[F.col("row")[c].alias(c) for c in held], F.col("score").alias(name))
