"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def fixed(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of size characters, each starting size - overlap after the last; the last is the first to reach the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / step).cast("int"))
    starts = F.sequence(F.lit(0), last)
    return F.when(F.length(c) > 0, F.transform(starts, lambda k: F.substr(c, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _cut(text: str, separator: str) -> list[str]:
    """Pieces, each but the first with the separator at its front."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _gathered(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined up to size; each next chunk begins with at most overlap characters of the one before."""
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def recursive(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that a text has; stripped, blank ones dropped."""
    if not text:
        return []
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    out: list[str] = []
    small: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _gathered(small, size, overlap)
        small = []
        out += recursive(piece, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [piece]
    out += _gathered(small, size, overlap)
    return [c for c in (x.strip() for x in out) if c]


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: the key, chunk_no (from 1) and content. Runs on each input partition; nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, c) for k, t in zip(batch[key], batch[text], strict=True) for n, c in enumerate(recursive(t, size, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "content"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_no int, content string")
