"""Repeated passages: exact counts of word windows by super-k-mer partitions.

A window is a run of consecutive words of one document. Its minimiser is the
least hash among its short word runs (mers); consecutive windows that share it
form a super-k-mer, which overlaps its neighbours only at its ends. Equal
windows have equal minimisers, so all places of a window meet in one bucket.

1. Mers that are very frequent are listed: at most ``HEAVY`` of them, for each
   stands for that share of all mers. They become minimisers only where a
   window has no other, so that a passage in a third of all documents draws
   none of those documents' own words into its buckets.
2. Each super-k-mer becomes a short row: bucket, a digest of its words (blake2b,
   128 bits), place. Buckets with a single one hold no repeated window and go.
   Super-k-mers of equal words are folded into one, on the map side first.
3. One of each, as a packed string, travels to its bucket. There its windows are
   sorted by a hash and compared by their words, so counts are exact.
   A bucket of over ``SPLIT`` words is not held by one task: its windows become
   rows of their own, counted by the digests of their words, on the map side
   first, so that neither a hot minimiser nor a hot window gathers in a task.
4. The repeated stretches go back to all places of the super-k-mers, and the
   words they cover are removed.

Where only digests are compared, two different word sequences would have to
share 128 bits of blake2b to be taken for one. Rows of one id are told apart by
a 64-bit hash and the length of their texts.

Windows are judged on the input. Null and short texts have no windows. Repeated
rows are places of their own, so all their windows are repeated. Ids may be null
or repeat with other texts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.hashing import Words, digest, mix, words_of
from marlstone.llm.store import drop, written

#: Words of a mer.
MER = 6
#: Most mers that are set back.
HEAVY = 16_384
#: Words of a bucket's different super-k-mers from which its windows are counted as rows.
SPLIT = 200_000
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive words."""
    out = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for k in range(size):
        out *= _TURN
        out += hashes[k : len(hashes) - size + 1 + k]
    return mix(out)


def _inside(ws: Words, size: int) -> np.ndarray:
    """Which runs of size words lie in one text."""
    good = np.ones(max(0, len(ws.hashes) - size + 1), dtype=bool)
    for back in range(1, size):
        at = ws.firsts[1:] - back
        at = at[(at >= ws.firsts[:-1]) & (at < len(good))]
        good[at] = False
    return good


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def heavy_mers(texts: DataFrame) -> np.ndarray:
    """Hashes of mers that make up over 1 / HEAVY of all, as far as single batches show it; sorted."""

    def run(batches):
        for batch in batches:
            ws = words_of([(t or "").encode() for t in batch.column(0).to_pylist()])
            mers = _runs(ws.hashes, MER)[_inside(ws, MER)]
            found, n = np.unique(mers, return_counts=True)
            often = n >= max(2, len(mers) // HEAVY)
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array([len(mers), *n[often].tolist()], pa.int64())], names=["mer", "n"])

    counts = texts.mapInArrow(run, "mer bigint, n bigint").groupBy("mer").agg(F.sum("n").alias("n"))
    # the row of all mers is first, as no other can have more
    rows = counts.orderBy(F.desc("n"), F.asc_nulls_first("mer")).limit(HEAVY + 1).collect()
    if not rows:
        return np.array([], dtype=np.uint64)
    total = rows[0]["n"]
    return np.sort(np.array([r["mer"] for r in rows[1:] if r["mer"] is not None and r["n"] * HEAVY > total], dtype=np.int64).view(np.uint64))


def super_kmers(ws: Words, size: int, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """bucket, digests, text, first word in it, windows, and whether the minimiser stands in it twice; one entry per super-k-mer."""
    none = np.array([], dtype=np.int64)
    mers = _runs(ws.hashes, MER)
    good = _inside(ws, size)
    if not good.any():
        return none, [], none, none, none, none.astype(bool)
    order = mers >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, mers), len(heavy) - 1)
        order |= (heavy[at] == mers).astype(np.uint64) << np.uint64(63)
    width = size - MER + 1
    least = _least(order, width)
    start = good.copy()
    start[1:] &= ~good[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(start)
    stop = good.copy()
    stop[:-1] &= ~good[1:] | start[1:]
    last = np.flatnonzero(stop)
    n = last - first + 1
    # how often the minimiser stands in each
    spans = n + width - 1
    begin = np.concatenate(([0], np.cumsum(spans)))
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1] - first, spans)
    twice = np.add.reduceat((order[inner] == np.repeat(least[first], spans)).astype(np.int64), begin[:-1]) > 1
    body = [digest(ws.data[a:b]) for a, b in zip(ws.starts[first].tolist(), ws.ends[last + size - 1].tolist(), strict=True)]
    text = np.searchsorted(ws.firsts, first, side="right") - 1
    return least[first].view(np.int64), body, text, first - ws.firsts[text], n, twice


def repeated_stretches(size: int, rows: list[tuple[int, bytes, int, bytes]]) -> Iterator[tuple[int, bytes, list[int]]]:
    """rows: bucket, digest, places, packed words; whole buckets. Gives bucket, digest and flat (start, end) pairs of repeated windows."""
    ws = words_of([r[3] for r in rows])
    good = _inside(ws, size)
    at = np.flatnonzero(good)
    window = _runs(ws.hashes, size)[at]
    text = np.searchsorted(ws.firsts, at, side="right") - 1
    bucket = np.array([r[0] for r in rows])[text]
    many = np.array([r[2] for r in rows])[text] > 1
    order = np.lexsort((window, bucket))
    b, w = bucket[order], window[order]
    new = np.concatenate(([True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])))
    group = np.cumsum(new) - 1
    n = np.bincount(group, minlength=0)
    hit = np.zeros(len(at), dtype=bool)
    ends = np.concatenate((np.flatnonzero(new), [len(order)]))
    bare = lambda k: ws.data[ws.starts[at[k]] : ws.ends[at[k] + size - 1]]
    for g in np.flatnonzero(n > 1):
        own = order[ends[g] : ends[g + 1]]
        first = bare(own[0])
        if all(bare(k) == first for k in own[1:]):
            hit[own] = True
            continue
        counted: dict[bytes, list[int]] = {}  # two word sequences of one hash
        for k in own:
            counted.setdefault(bare(k), []).append(k)
        for same in counted.values():
            hit[same] = len(same) > 1
    hit |= many
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    cut = np.flatnonzero(np.diff(text)) + 1  # stretches end with their string
    out: dict[int, list[int]] = {}
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        inner = cut[np.searchsorted(cut, a, side="right") : np.searchsorted(cut, z)]
        for low, high in zip([a, *inner], [*inner, z], strict=True):
            t = int(text[low])
            place = int(at[low] - ws.firsts[t])
            out.setdefault(t, []).extend((place, place + int(high - low)))
    for t, flat in out.items():
        yield rows[t][0], rows[t][1], flat


def unlike(batch: pa.RecordBatch) -> Iterator[tuple[str, list]]:
    """Text and wanted of a batch's rows; rows of one id and text, which a join leaves side by side, are taken once."""
    before = None
    for row in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
        if row != before:
            yield row
        before = row


class SubstringDedup:
    """Removes each word that lies in a window of ``size`` words whose words start at two places or more."""

    def __init__(self, size: int = 35, text: str = "text", key: str = "doc_id"):
        self.size, self.text, self.key = size, text, key

    def _places(self, rows: DataFrame, heavy: np.ndarray) -> DataFrame:
        size = self.size
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                ws = words_of([(t or "").encode() for t in batch.column("text").to_pylist()])
                bucket, body, text, first, n, twice = super_kmers(ws, size, heavy)
                if len(bucket):
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(body, pa.binary()), batch.column("id").take(at), batch.column("version").take(at), batch.column("chars").take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["bucket", "body", "id", "version", "chars", "first", "n", "twice"])

        return rows.mapInArrow(run, f"bucket bigint, body binary, id {kind}, version bigint, chars int, first int, n int, twice boolean")

    def _packed(self, found: DataFrame) -> DataFrame:
        """found: text and wanted (bucket, body, places, first, n). One row per wanted: bucket, body, places, words."""
        size = self.size

        def run(batches):
            for batch in batches:
                out = []
                for text, wanted in unlike(batch):
                    words = text.encode().split()
                    out += [(w["bucket"], w["body"], w["places"], b" ".join(words[w["first"] : w["first"] + w["n"] + size - 1])) for w in wanted]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "body", "places", "words"])

        return found.mapInArrow(run, "bucket bigint, body binary, places bigint, words binary")

    def _windows(self, found: DataFrame) -> DataFrame:
        """found: text and wanted, as in _packed. Repeated windows of the wanted: bucket, body, flat."""
        size = self.size

        def run(batches):
            for batch in batches:
                for text, wanted in unlike(batch):
                    ws = words_of([text.encode()])
                    n = [w["n"] for w in wanted]
                    at = np.concatenate([np.arange(x) for x in n])
                    begin = at + np.repeat([w["first"] for w in wanted], n)
                    names = [digest(ws.data[a:b]) for a, b in zip(ws.starts[begin].tolist(), ws.ends[begin + size - 1].tolist(), strict=True)]
                    whose = pa.array(np.repeat(np.arange(len(n)), n))
                    own = [pa.array([w[c] for w in wanted], t).take(whose) for c, t in (("bucket", pa.int64()), ("body", pa.binary()), ("places", pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(names, pa.binary())], names=["bucket", "body", "places", "at", "window"])

        # rows of one id and text send the same
        windows = written(found.mapInArrow(run, "bucket bigint, body binary, places bigint, at int, window binary").dropDuplicates(["bucket", "body", "at"]))
        often = written(windows.groupBy("window").agg(F.sum("places").alias("n")).where("n > 1").select("window"))  # so that the join may split a hot window
        hit = windows.join(often, "window", "left_semi").groupBy("bucket", "body").agg(F.collect_list("at").alias("at"))
        return hit.select("bucket", "body", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("flat"))

    def _counted(self, packed: DataFrame) -> DataFrame:
        size = self.size

        def run(batches):
            rows, weight = [], 0

            def flush(own):
                out = list(repeated_stretches(size, own))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int32())))], names=["bucket", "body", "flat"])

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "body", "places", "words")), strict=True):
                    if rows and row[:2] == rows[-1][:2]:  # rows of one id and text send the same
                        continue
                    if weight > 2_000_000 and row[0] != rows[-1][0]:
                        yield from flush(rows)
                        rows, weight = [], 0
                    rows.append(row)
                    weight += len(row[3])
            if rows:
                yield from flush(rows)

        return packed.repartition("bucket").sortWithinPartitions("bucket", "body").mapInArrow(run, "bucket bigint, body binary, flat array<int>")

    def spans(self, rows: DataFrame) -> DataFrame:
        """rows: id, version, chars, text. Per (who, version, chars): flat pairs of first word and end of repeated stretches."""
        size, row = self.size, ["who", "version", "chars"]
        heavy = heavy_mers(rows.select("text"))
        every = written(self._places(rows, heavy))
        shared = every.groupBy("bucket").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("bucket")
        places = written(every.join(shared, "bucket"))
        drop(every)
        folded = places.groupBy("bucket", "body").agg(F.count("*").alias("places"), F.max("twice").alias("twice"), F.min(F.struct(F.struct("id").alias("who"), "version", "chars", "first", "n")).alias("one"))
        folded = written(folded.select("bucket", "body", "places", "twice", "one.*"))
        alone = written(folded.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + size - 1).alias("words")))
        folded = folded.join(alone, "bucket")
        simple = (F.col("kinds") == 1) & ~F.col("twice")
        texts = rows.select(F.struct("id").alias("who"), "version", "chars", "text")

        def found(which):
            wanted = folded.where(~simple & which).groupBy(*row).agg(F.collect_list(F.struct("bucket", "body", "places", "first", "n")).alias("wanted"))
            return texts.join(wanted, row).select("text", "wanted")

        counted = self._counted(self._packed(found(F.col("words") <= SPLIT)))
        if not alone.where(F.col("words") > SPLIT).isEmpty():
            counted = counted.unionByName(self._windows(found(F.col("words") > SPLIT)))
        whole = folded.where(simple & (F.col("places") > 1)).select("bucket", "body", F.array(F.lit(0), F.col("n")).alias("flat"))
        back = places.join(counted.unionByName(whole), ["bucket", "body"])
        moved = F.transform("flat", lambda x, k: F.col("first") + x + F.when(k % 2 == 1, size - 1).otherwise(0))
        # rows of one id and text have the same places, which a set holds once
        return back.groupBy(F.struct("id").alias("who"), "version", "chars").agg(F.flatten(F.collect_set(moved)).alias("flat"))

    def remove(self, docs: DataFrame) -> DataFrame:
        """One row per row: id, n_words, n_removed, kept_text (its words joined by one space)."""
        text = F.coalesce(F.col(self.text), F.lit(""))
        rows = docs.select(F.col(self.key).alias("id"), F.xxhash64(text).alias("version"), F.length(text).alias("chars"), text.alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        texts = rows.select(F.struct("id").alias("who"), "version", "chars", "text")
        met = texts.join(self.spans(rows), ["who", "version", "chars"], "left").select("who.id", "text", "flat")

        def run(batches):
            for batch in batches:
                n_words, n_removed, kept = [], [], []
                for text, flat in zip(batch.column("text").to_pylist(), batch.column("flat").to_pylist(), strict=True):
                    words = text.encode().split()
                    n_words.append(len(words))
                    if flat:
                        gone = np.zeros(len(words) + 1, dtype=np.int32)
                        np.add.at(gone, flat[::2], 1)
                        np.add.at(gone, flat[1::2], -1)
                        stays = np.cumsum(gone)[:-1] == 0
                        words = [words[k] for k in np.flatnonzero(stays)]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

        return met.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_text string")
