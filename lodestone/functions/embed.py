"""Embedders and rerankers behind one interface; the default needs no service.

An embedder is a function from a list of texts to a list of vectors of one dimension, run on executors in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed hashed words, of unit length; equal texts have equal vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def isolating(embed: Embedder, shortest: int = 200) -> Callable[[list[str]], list[list[float] | None]]:
    """An embedder that halves a failing batch, then the failing text, and gives null for a text that fails at any length."""

    def run(texts: list[str]) -> list[list[float] | None]:
        try:
            return list(embed(texts))
        except Exception:  # noqa: BLE001  a service fails in its own ways; the text that it fails on gets null
            if len(texts) > 1:
                half = len(texts) // 2
                return run(texts[:half]) + run(texts[half:])
            return run([texts[0][: len(texts[0]) // 2]]) if len(texts[0]) > shortest else [None]

    return run


def embedded(df: DataFrame, embedder: Embedder, text_col: str = "content", batch: int = 128) -> DataFrame:
    """df with ``embedding``; null where the text is null or can't be embedded."""
    run = isolating(embedder)

    @F.pandas_udf("array<float>")
    def f(texts):
        import pandas as pd

        values = texts.tolist()
        out: list = [None] * len(values)
        known = [i for i, t in enumerate(values) if t is not None]
        for a in range(0, len(known), batch):
            part = known[a : a + batch]
            for i, v in zip(part, run([values[i] for i in part]), strict=True):
                out[i] = v
        return pd.Series(out)

    return df.withColumn("embedding", f(F.col(text_col)))


def reranked(df: DataFrame, scorer: Callable[[str, list[str]], list[float]], query: str, text_col: str = "content", most: int = 50) -> DataFrame:
    """Scores of the first rows (by rank) of a short list by another scorer; null where it fails."""

    @F.pandas_udf("double")
    def f(texts):
        import pandas as pd

        try:
            return pd.Series(scorer(query, texts.tolist()))
        except Exception:  # noqa: BLE001  the caller then keeps its own order
            return pd.Series([None] * len(texts), dtype="float64")

    return df.where(F.col("rank") <= most).withColumn("rerank_score", f(F.col(text_col)))
