"""Calls to language and embedding models behind small interfaces, with deterministic stand-ins.

A client is built once per task from a factory, so that connections and rate
limits live where the calls are made. No network is used here.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ModelClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class RuleModel:
    """Answers with the sentences of the prompt's context that share most words with its question; no context, an apology."""

    APOLOGY = "No relevant passage was found."

    def complete(self, prompt: str) -> str:
        context, _, question = prompt.rpartition("\n\nQuestion: ")
        asked = set(re.findall(r"\w+", question.lower()))
        parts = [p.strip() for p in re.split(r"(?<=[.!?。！？])\s*", context) if p.strip()]
        best = sorted(parts, key=lambda p: (-len(asked & set(re.findall(r"\w+", p.lower()))), parts.index(p)))[:2]
        return " ".join(best) or self.APOLOGY


class Limited:
    """A client whose calls start at least pause seconds apart and are tried again when they fail."""

    def __init__(self, client: ModelClient, pause: float = 0.0, tries: int = 3):
        self.client, self.pause, self.tries, self.last = client, pause, tries, 0.0

    def complete(self, prompt: str) -> str:
        for n in range(self.tries):
            time.sleep(max(0.0, self.last + self.pause - time.monotonic()))
            self.last = time.monotonic()
            try:
                return self.client.complete(prompt)
            except Exception:
                if n + 1 == self.tries:
                    raise
        raise AssertionError


def complete(rows: DataFrame, prompt: str, reply: str = "reply", client: Callable[[], ModelClient] = RuleModel, say_errors: bool = False) -> DataFrame:
    """rows with a model's reply to each prompt; null prompts get null. say_errors: a failed call's reply is its error, else the job fails."""
    shape = T.StructType([*rows.schema.fields, T.StructField(reply, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()

        def told(p: str) -> str:
            try:
                return model.complete(p)
            except Exception as e:
                if not say_errors:
                    raise
                return f"Error: {e}"

        for batch in batches:
            yield batch.assign(**{reply: [None if p is None else told(p) for p in batch[prompt]]})

    return rows.mapInPandas(run, shape)


@lru_cache(maxsize=1 << 18)
def _slot(word: str, size: int) -> tuple[int, float]:
    """The place of a word in a vector, and its sign."""
    h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return h % size, 1.0 if h >> 31 else -1.0


def embed_texts(texts: Sequence[str | None], size: int = 64) -> np.ndarray:
    """Vectors of length 1 from hashed words, a row a text; zeros without words. A word is hashed once, however often it stands."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    slots = [_slot(w, size) for own in words for w in own]
    row = np.repeat(np.arange(len(words)), [len(own) for own in words])
    at = row * size + np.array([k for k, _ in slots], dtype=np.int64)
    out = np.bincount(at, weights=[sign for _, sign in slots], minlength=len(words) * size).astype(float).reshape(len(words), size)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embed_text(text: str | None, size: int = 64) -> list[float]:
    """The vector of one text."""
    return embed_texts([text], size)[0].tolist()


def embedding(text: Column, size: int = 64) -> Column:
    """embed_texts() over a column, by batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed_texts(texts.tolist(), size).astype(np.float32)))

    return run(text)
