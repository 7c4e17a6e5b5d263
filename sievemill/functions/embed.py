"""Text embedding with a pluggable model, loaded once per Python worker."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS

ROWS = 512  # texts that the model gets at once

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = DEFAULTS.embedding_dim, n: int = DEFAULTS.ngram) -> Callable[[], Embedder]:
    """A factory of the offline default: signed feature hashing of character n-grams, scaled to length 1."""

    def factory() -> Embedder:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts, strict=True):
                t = text.lower()
                for gram in {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else ():
                    h = zlib.crc32(gram.encode("utf-8", "surrogatepass"))
                    row[h % dim] += 1 if h & 0x80000000 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return embed

    return factory


def embed(text: Column, factory: Callable[[], Embedder] | None = None) -> Column:
    """array<float> of a text column by the model that ``factory`` makes; null texts are empty ones."""
    factory = factory or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                some = texts.iloc[at : at + ROWS]
                yield pd.Series([np.asarray(v, dtype=np.float32) for v in model([t or "" for t in some])], index=some.index, dtype=object)

    return run(text)
