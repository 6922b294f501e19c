"""Embeddings by an injected callable, in batches; a deterministic offline stub stands in for a service."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def hashed_vectors(texts: list[str], dim: int = 16) -> list[list[float]]:
    """Unit vectors of hashed words: equal texts get equal vectors, shared words bring vectors closer."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
            v[h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embed(rows: DataFrame, text_col: str, call: Callable[[list[str]], list[list[float]]] = hashed_vectors, batch: int = 64) -> DataFrame:
    """Adds `embedding`; the callable gets at most `batch` texts at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            texts = df[text_col].fillna("").tolist()
            yield df.assign(embedding=[v for lo in range(0, len(texts), batch) for v in call(texts[lo : lo + batch])])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
