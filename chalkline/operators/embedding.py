"""Texts to vectors with a pluggable model, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 512
BATCH_SIZE = 32


class Model(Protocol):
    """What a model must offer; it is built on the executors, so only its factory is shipped."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


ModelFactory = Callable[[str], Model]


@lru_cache(maxsize=1 << 16)
def _bucket(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension


class HashedWords:
    """Stand-in model: word counts hashed into a fixed number of dimensions.

    It is lexical, not semantic. It needs no download and gives the same vector everywhere.
    """

    _WORD = re.compile(r"[^\W_]+")

    def __init__(self, name: str = "hashed-words", dimension: int = DIMENSION) -> None:
        self.name, self.dimension = name, dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        places = [
            row * self.dimension + _bucket(word, self.dimension)
            for row, text in enumerate(texts)
            for word in self._WORD.findall(text.lower())
        ]
        counts = np.bincount(np.array(places, np.int64), minlength=len(texts) * self.dimension)
        return counts.reshape(len(texts), self.dimension).astype(np.float32)


@lru_cache(maxsize=8)
def _loaded(factory: ModelFactory, name: str) -> Model:
    """The model of this Python worker; loaded on first use and kept for later tasks."""
    return factory(name)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in float32; zero rows stay zero."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (vectors / np.where(lengths > 0, lengths, 1.0)).astype(np.float32)


def embed(
    texts: DataFrame,
    id_column: str = "chunk_id",
    text_column: str = "content",
    factory: ModelFactory = HashedWords,
    model_name: str = "hashed-words",
    normalize: bool = True,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``(id, embedding)`` for every text; only the two columns reach Python. Null counts as ""."""
    columns = texts.select(id_column, F.coalesce(text_column, F.lit("")).alias(text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _loaded(factory, model_name)
            for low in range(0, batch.num_rows, batch_size):
                part = batch.slice(low, batch_size)
                vectors = np.asarray(model.encode(part.column(1).to_pylist()), np.float32)
                if normalize:
                    vectors = unit_rows(vectors)
                offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                arrays = pa.ListArray.from_arrays(offsets, vectors.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(0), arrays], names=[id_column, "embedding"])

    kind = columns.schema[id_column].dataType.simpleString()
    return columns.mapInArrow(run, f"`{id_column}` {kind}, embedding array<float>")
