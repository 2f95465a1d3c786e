"""Vectors of texts by a pluggable model, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 256  # texts that a model is given at once
SIZE = 64


class Embedder(Protocol):
    """One vector for each text, all of one length, in order."""

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


def hashed_embedder(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: words counted in SIZE places by hash, with a sign, at length one (zero for a
    text without words)."""
    out = np.zeros((len(texts), SIZE))
    for row, t in zip(out, texts, strict=True):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            row[h % SIZE] += 1 - 2 * (h >> 31)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0).tolist()


def vectors_of(text: Column, embedder: Callable[[list[str]], Sequence[Sequence[float]]] = hashed_embedder, batch: int = BATCH) -> Column:
    """The vectors of a text column; a null text has none. A model that answers with another number of vectors fails."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in parts:
            there = own[own.notna()]
            got: list = []
            for i in range(0, len(there), batch):
                texts = there.iloc[i : i + batch].tolist()
                some = [[float(x) for x in v] for v in embedder(texts)]
                if len(some) != len(texts):
                    raise ValueError(f"{len(texts)} texts, {len(some)} vectors")
                got += some
            out = pd.Series([None] * len(own), index=own.index, dtype=object)
            for i, v in zip(there.index, got, strict=True):
                out.at[i] = v
            yield out

    return F.pandas_udf(run, "array<float>")(text)


def embed(chunks: DataFrame, embedder: Callable[[list[str]], Sequence[Sequence[float]]] = hashed_embedder, text: str = "text", name: str = "embedding") -> DataFrame:
    """The chunks with their vectors in ``name``, as knn() and append_chunks() take them."""
    return chunks.withColumn(name, vectors_of(F.col(text), embedder))
