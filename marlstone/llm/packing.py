"""Packing token sequences into windows of several lengths.

A document's ids, with an end id, are cut into windows of the longest tier; the
rest is routed to the shortest tier that holds it. Windows open with the longest
pieces. Gaps are filled from shorter tiers, largest fitting piece first, and at
last by cutting a piece to the gap, so that all windows are full but one at the
end of an input partition. Windows of one tier are dealt into step groups of
like cost (the sum of squared piece lengths, as attention has it).

Every input partition packs its own rows in bounded buffers: nothing is
shuffled, a lost executor costs its partitions only, and an input partition
pads less than one longest window. Null texts are empty; an empty text is its
end id alone. Repeated rows are packed each. A null key is a key like others.
An empty table gives no pieces. A text is held in memory whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.tokens import default_files, encoder

#: Pieces held before they are packed.
BUFFER = 8192


class Packer:
    """Takes documents' lengths; gives windows as lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # (length, document, start), sorted
        self.tokens = [0] * len(self.tiers)
        self.held = 0

    def add(self, document: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows of the longest tier at once; the rest is routed."""
        longest, start = self.tiers[-1], 0
        while length - start >= longest:
            yield longest, [(document, start, longest)]
            start += longest
        if start < length:
            self._route(length - start, document, start)

    def _route(self, length: int, document: int, start: int) -> None:
        tier = bisect_left(self.tiers, length)
        insort(self.pools[tier], (length, document, start))
        self.tokens[tier] += length
        self.held += 1

    def _pop(self, tier: int, k: int) -> tuple[int, int, int]:
        piece = self.pools[tier].pop(k)
        self.tokens[tier] -= piece[0]
        self.held -= 1
        return piece

    def _take(self, most: int, tier: int) -> tuple[int, int, int] | None:
        """The largest piece of at most that length, from this tier or shorter ones."""
        for t in range(tier, -1, -1):
            if k := bisect_right(self.pools[t], (most, float("inf"), 0)):
                return self._pop(t, k - 1)
        return None

    def _cut(self, gap: int, tier: int) -> tuple[int, int, int] | None:
        """A part of the shortest piece left; the rest of it is routed anew."""
        for t in range(tier + 1):
            if self.pools[t]:
                length, document, start = self._pop(t, 0)
                self._route(length - gap, document, start + gap)
                return gap, document, start
        return None

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows by tier, longest first; what can't fill one stays unless last."""
        for tier in reversed(range(len(self.tiers))):
            size = self.tiers[tier]
            while self.pools[tier] and (last or sum(self.tokens[: tier + 1]) >= size):
                gap, window = size, []
                while gap:
                    piece = self._take(gap, tier) or self._cut(gap, tier)
                    if piece is None:
                        break
                    length, document, start = piece
                    window.append((document, start, length))
                    gap -= length
                yield size, window


def _groups(windows: list[tuple[int, int]], size: int, first: int) -> tuple[list[int], int]:
    """windows: (tier, cost). The step group of each, dealt to and fro by falling cost, and the next free group."""
    out = [0] * len(windows)
    for tier in sorted({t for t, _ in windows}):
        own = sorted((k for k, w in enumerate(windows) if w[0] == tier), key=lambda k: -windows[k][1])
        n = -(-len(own) // size)
        for place, k in enumerate(own):
            lap, at = divmod(place, n)
            out[k] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return out, first


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = (256, 512, 1024), end_id: int = 0, group: int = 8, files: tuple[str, str | None] | None = None) -> DataFrame:
    """One row per piece: the key, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, tier, step_group."""
    files = files or default_files()
    shape = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, t) for c, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()), ("step_group", T.LongType()))])

    def run(batches):
        encode = encoder(*files)
        base = TaskContext.get().partitionId() << 36
        packer = Packer(tiers)
        held: dict[int, list] = {}  # document: key, ids, ids not yet packed
        n_docs, n_windows, n_groups = 0, 0, 0
        arrow = None

        def rows(windows):
            nonlocal n_windows, n_groups
            groups, n_groups = _groups([(t, sum(x[2] ** 2 for x in w)) for t, w in windows], group, n_groups)
            out = []
            for (tier, window), step in zip(windows, groups, strict=True):
                offset = 0
                for document, start, length in window:
                    doc = held[document]
                    out.append((doc[0], start, length, doc[1][start : start + length].tobytes(), len(doc[1]), base + n_windows, offset, tier, base + step))
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[document]
                n_windows += 1
            for k in range(0, len(out), BUFFER):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[k : k + BUFFER], strict=True), arrow, strict=True)], schema=arrow)

        done: list = []
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([pa.field(key, batch.schema.field(0).type), *(pa.field(c, t) for c, t in (("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())))])
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(body.as_py() or ""), np.uint32(end_id)).astype("<u4")
                held[n_docs] = [k, ids, len(ids)]
                done += packer.add(n_docs, len(ids))
                n_docs += 1
                if packer.held + len(done) >= BUFFER:
                    yield from rows(done + list(packer.windows(last=False)))
                    done = []
        if arrow is not None:
            yield from rows(done + list(packer.windows(last=True)))

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, shape)
