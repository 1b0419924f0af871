"""Importance resampling towards a target distribution, by hashed n-grams.

1. A text is lower-cased (A to Z) and its separators collapse to single spaces; a
   regular expression, run with overlapping matches between boundary lookarounds,
   then gives every run of 1 to n words, whose CRC names its bucket. A
   document's buckets are written, so each text is scanned once.
2. Counts of buckets over all documents and over all target texts give each
   bucket a gain, the log of the ratio of its smoothed shares in thousandths.
3. A document's weight is the floored mean of its features' gains. Gumbel noise
   from a hash of its id is added; the highest scores are a draw without
   replacement in proportion to the exponentials of weights.
4. Ranks come from one range sort: each part's rows are numbered within it, after
   as many as the parts before it hold.

Null and blank texts have no features and weight 0. Texts of fewer than
`least_words` words are scored and never drawn. Ties go to smaller ids, null ids
last, then to fewer features and lower weights; repeated rows are drawn each, by
the same score. A null id draws as an empty one. Without documents there are no
rows; without target texts the target's shares are even.
"""

from __future__ import annotations

from functools import lru_cache
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import drop, written

#: Bytes that are no part of a word: ASCII but for digits and, once lower-cased, letters.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANKED = bytes(32 if b in SEPARATORS else b for b in _LOWERED)
_FIRST = itemgetter(0)


@lru_cache(maxsize=8)
def _scanner(n: int):
    """Runs of n words, one from each word on."""
    import regex

    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapsed(text: str) -> bytes:
    """The words of a text with one space between."""
    return b" ".join(text.encode().translate(_BLANKED).split())


def crcs(words: bytes, n: int) -> np.ndarray:
    """The CRC of every run of 1 to n words, shorter runs first."""
    runs = [np.fromiter(map(crc32, map(_FIRST, _scanner(k).finditer(words, overlapped=True))), dtype=np.uint32) for k in range(1, n + 1)]
    return np.concatenate(runs)


class Resampler:
    """n: words of the longest run; percent: of the documents with at least least_words words, how many are drawn; seed: of the noise."""

    def __init__(self, n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7):
        self.n, self.buckets, self.percent, self.least_words, self.seed = n, buckets, percent, least_words, seed
        self._kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def features(self, docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
        """id, n_words, n_features, buckets (little-endian, one a feature)."""
        n, buckets, kind = self.n, self.buckets, self._kind

        def run(batches):
            for batch in batches:
                rows = []
                for body in batch.column(1):
                    words = collapsed(body.as_py() or "")
                    got = crcs(words, n) % np.uint32(buckets)
                    rows.append((words.count(b" ") + 1 if words else 0, len(got), got.astype(kind).tobytes()))
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["id", "n_words", "n_features", "buckets"])

        rows = docs.select((F.lit(0) if key is None else F.col(key)).alias("id"), F.col(text).alias("body"))
        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, buckets binary")

    def counts(self, features: DataFrame) -> DataFrame:
        """bucket, n: features in it; buckets without any are left out."""
        buckets, kind = self.buckets, self._kind

        def run(batches):
            total = np.zeros(buckets, dtype=np.int64)
            for batch in batches:
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind), minlength=buckets)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

        return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def gains(self, source: DataFrame, target: DataFrame) -> DataFrame:
        """bucket, gain, from the counts of both sides."""
        total = lambda counts: counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        s_all, t_all = (float(total(x) + self.buckets) for x in (source, target))
        both = source.sparkSession.range(self.buckets).select(F.col("id").alias("bucket"))
        both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
        more = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1
        ratio = more("t") * F.lit(s_all) / (more("s") * F.lit(t_all))
        return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))

    def noise(self, key: Column) -> Column:
        """Gumbel noise in thousandths, from a hash of the id."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))

    def score(self, docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
        """One row a document: id, n_words, n_features, weight, score (long); written to the shared folder."""
        own = written(self.features(docs, text, key))
        source, aimed = written(self.counts(own)), written(self.counts(self.features(target, target_text)))
        gains = np.zeros(self.buckets, dtype=np.int64)
        for bucket, gain in self.gains(source, aimed).collect():  # as many rows as there are buckets
            gains[bucket] = gain
        kind = self._kind

        def run(batches):
            for batch in batches:
                bodies, n = batch.column(3).to_pylist(), batch.column(2).to_pylist()
                weights = [int(gains[np.frombuffer(b, dtype=kind)].sum()) // k if k else 0 for b, k in zip(bodies, n, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(weights, pa.int64())], names=["id", "n_words", "n_features", "weight"])

        weighed = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")
        out = written(weighed.withColumn("score", F.col("weight") + self.noise(F.col("id"))))
        drop(own, source, aimed)
        return out

    def draw(self, scored: DataFrame) -> DataFrame:
        """scored with rank: 1, 2, 3 ... by falling score for the documents that are drawn, null for all others."""
        fit = F.col("n_words") >= self.least_words
        ways = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
        placed = written(scored.where(fit).orderBy(*ways).withColumn("at", F.monotonically_increasing_id()))
        part = F.shiftright("at", 33)  # the rest of such an id counts rows within its part
        sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a part of the sort
        firsts = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).astype(int).tolist()
        take = self.percent * firsts[-1] // 100
        offsets = scored.sparkSession.createDataFrame([(p, k) for (p, _), k in zip(sizes, firsts, strict=False)], "part long, before long")
        rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= take, rank)).drop("part", "before", "at")
        return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
