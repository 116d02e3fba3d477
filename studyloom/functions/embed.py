"""Embedding columns from a provider, and a deterministic provider without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts to one vector each; made once in each task.
Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dimension: int = 64) -> Embedder:
    """Words counted into hashed coordinates with signs, at unit length; a text without words gets the first axis."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh32_intdigest(word)
                out[i, (h >> 1) % dimension] += 1 if h & 1 else -1
        out[~out.any(axis=1), 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed


def with_embedding(rows: DataFrame, text: Column, make: Callable[[], Embedder], prefix: str = "") -> DataFrame:
    """rows with embedding (array of float), the vector of prefix + text; null text is embedded as the prefix alone. A provider
    that gives another number of vectors than texts, or a zero vector, is an error."""
    base = rows.withColumn("_text", F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))
    columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for batch in batches:
            vectors = np.asarray(embed(batch["_text"].tolist()))
            if len(vectors) != len(batch) or not np.all(np.any(vectors != 0, axis=1)):
                raise ValueError("a provider must give one vector that isn't zero for each text")
            yield batch.drop(columns="_text").assign(embedding=list(vectors.astype(np.float32)))

    return base.mapInPandas(run, f"{columns}, embedding array<float>")
