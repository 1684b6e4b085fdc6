"""Models and codecs behind interfaces. Nothing here loads a model by itself: register what a cluster has installed.

A provider is made once in each Python worker and is called with Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextEncoder(Protocol):
    dim: int

    def encode(self, texts: list[str], query: bool) -> np.ndarray: ...


class FrameEncoder(Protocol):
    dim: int

    def encode(self, frames: list[bytes]) -> np.ndarray: ...


class Expert(Protocol):
    def score(self, frames: list[bytes], question: str) -> np.ndarray: ...


_makers: dict[tuple[str, str], Callable[[], object]] = {}
_made: dict[tuple[str, str], object] = {}


def register(kind: str, name: str, maker: Callable[[], object]) -> None:
    """kind: 'text', 'frame', 'expert', 'probe', 'decode', 'speech' or 'ocr'."""
    _makers[kind, name] = maker


def get(kind: str, name: str) -> object:
    """This process's provider, made at the first call."""
    if (kind, name) not in _makers:
        raise LookupError(f"no {kind} provider {name!r} is registered; have {sorted(n for k, n in _makers if k == kind)}")
    if (kind, name) not in _made:
        _made[kind, name] = _makers[kind, name]()
    return _made[kind, name]


class HashedText:
    """A deterministic stand-in for a sentence encoder: signed hashed words, length 1. It knows no meaning."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


register("text", "hashed", HashedText)


def embed_text(maker: Callable[[], TextEncoder], text: Column, query: bool = False) -> Column:
    """ARRAY<FLOAT> of each text, in Arrow batches; `maker` travels to the workers and runs once in each."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = maker()
        for part in parts:
            yield pd.Series(list(encoder.encode(part.fillna("").tolist(), query)))

    return run(text)


def expert_scores(maker: Callable[[], Expert], hits: DataFrame, question: str, picture: str = "jpeg", batch: int = 16) -> DataFrame:
    """hits with vlm_score: limit them first, the expert is the costly step."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        expert = maker()
        for part in parts:
            frames = part.tolist()
            yield pd.Series(np.concatenate([expert.score(frames[i : i + batch], question) for i in range(0, len(frames), batch)] or [np.zeros(0)]))

    return hits.withColumn("vlm_score", run(F.col(picture)))
