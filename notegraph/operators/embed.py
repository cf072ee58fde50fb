"""Embedding jobs: a model is a plug-in; the table work is Spark's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.tables import needs_vectors
from notegraph.operators.text import clean


class EmbeddingModel(Protocol):
    dimensions: int
    max_tokens: int

    def truncate(self, text: str) -> str: ...

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class HashingModel:
    """A deterministic stand-in without a network: words are hashed into a unit vector."""

    def __init__(self, dimensions: int = 64, max_tokens: int = 512):
        self.dimensions, self.max_tokens = dimensions, max_tokens

    def truncate(self, text: str) -> str:
        return " ".join(text.split()[: self.max_tokens])

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w.encode())
                v[h % self.dimensions] += 1 if h >> 32 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embed(texts: DataFrame, make: Callable[[], EmbeddingModel], size: int = 32) -> DataFrame:
    """``block_id, vec, error`` of ``texts(id, text)``: one model a task, batches of ``size``.

    A batch that fails is tried row by row; a row that fails keeps its message and no vector. Empty text is left out.
    """
    kind = dict(texts.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                items = [model.truncate(t) for t in part["text"]]
                try:
                    vecs, errors = model.embed_texts(items), [None] * len(items)
                except Exception:
                    vecs, errors = [], []
                    for t in items:
                        try:
                            vecs.append(model.embed_texts([t])[0])
                            errors.append(None)
                        except Exception as e:
                            vecs.append(None)
                            errors.append(str(e))
                yield pd.DataFrame({"block_id": part["id"].to_numpy(), "vec": vecs, "error": errors})

    return texts.where("text IS NOT NULL AND text <> ''").select("id", "text").mapInPandas(run, f"block_id {kind}, vec array<double>, error string")


def embed_missing(blocks: DataFrame, embeddings: DataFrame, make: Callable[[], EmbeddingModel], text=None, column: str | None = None) -> DataFrame:
    """Vectors for the segments that have none; ``text`` is the column to embed (default: the cleaned content), ``column`` the
    kind of vector that is missing."""
    todo = needs_vectors(blocks, embeddings, column)
    return embed(todo.select("id", (clean(F.col("content")) if text is None else text).alias("text")), make)


def reset(embeddings: DataFrame, blocks: DataFrame, kind: str) -> DataFrame:
    """Without the vectors of blocks of a kind."""
    gone = blocks.where(F.col("kind") == kind).select(F.col("id").alias("block_id"))
    return embeddings.join(gone, "block_id", "left_anti")
