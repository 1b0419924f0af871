"""Language identification in two steps: the family first, then the languages within it.

1. A text is a count of hashed character n-grams (1 to 4 characters) over its
   letters in lower case, with one space for anything else.
2. Families by multinomial naive Bayes, on counts over all labelled documents.
3. Within a family, a linear support vector machine (squared hinge) for every two
   languages votes; each is fitted by a task of its own on the square roots of
   n-gram shares, and its margins are calibrated on halves that it wasn't fitted
   on. The most votes win, then the highest mean chance, then the lower name.

Machines are fitted on at most `examples` distinct texts of a language, those of
least hash; naive Bayes takes every row. Languages that no family names are a
family of their own. As labels are names that people give, what is held per
language (two rows of n-gram counts, and one of weights per pair of a family)
fits the driver.

Null texts and texts without a letter are `und` with score 0, as are all texts
where nothing is labelled. Repeated rows are counted each by naive Bayes, equal
texts are one example; null ids and labels: a null label isn't learned from.
Empty tables give no rows. A text is held in memory whole, its n-grams in slices.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import drop, written

# Languages of common families by ISO code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sd si ur",
    "iranian": "ckb fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "austronesian": "ceb id jv mg ms su tl",
    "sinitic": "yue zh",
}
UNKNOWN = "und"
#: Buckets of n-grams as a power of two, characters of the longest, and characters of a slice.
BITS, LONGEST, SLICE = 13, 4, 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _letter(c: int) -> int:
    """The character in lower case, or a space where it is no letter."""
    one = chr(c)
    if not one.isalpha():
        return 32
    low = one.lower()
    return ord(low) if len(low) == 1 else c


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([_letter(c) for c in range(1 << 16)], dtype=np.uint32)


def profile(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of n-grams by bucket; None without a letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)
    high = codes >> 16 > 0
    if high.any():
        plain = _letters()[np.where(high, 32, codes)]
        values, at = np.unique(codes[high], return_inverse=True)
        plain[high] = np.array([_letter(int(c)) for c in values], dtype=np.uint32)[at]
    else:
        plain = _letters()[codes]
    blank = plain == 32
    if blank.all():
        return None
    again = np.ones(len(plain), dtype=bool)
    again[1:] = blank[:-1]
    plain = np.concatenate(([32], plain[~(blank & again)], [32]))
    plain = (plain[:-1] if plain[-2] == 32 else plain).astype(np.uint64)
    total = np.zeros(1 << bits, dtype=np.int64)
    for a in range(0, len(plain), SLICE):
        some = plain[a : a + SLICE + LONGEST - 1]
        h = np.zeros(len(some), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            if len(some) < n:
                break
            h = (h[: len(some) - n + 1] + some[n - 1 :]) * _P
            own = h[:SLICE]
            total += np.bincount((((own ^ (own >> np.uint64(29))) * _Q) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return total


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of n-grams: unit vectors, with a constant at the end."""
    return np.append(np.sqrt(counts / counts.sum()), 1.0).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, weight: float = 1e-4, rounds: int = 250) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, both classes weighing the same, by accelerated gradient steps."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step, w = np.float32(1 / (4 + weight)), np.zeros(x.shape[1], dtype=np.float32)
    ahead, t = w, 1.0
    for _ in range(rounds):
        lack = np.maximum(0, 1 - y * (x @ ahead)).astype(np.float32)
        new = ahead - step * (np.float32(weight) * ahead - 2 * ((each * y * lack).astype(np.float32) @ x))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + np.float32((before - 1) / t) * (new - w), new
    return w


def slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The k for which 1 / (1 + exp(-k * margin)) fits the labels best, of a few hundred by even ratios."""
    if not len(margins):
        return 1.0
    tries = np.geomspace(0.1, 1000, 120)
    loss = [np.logaddexp(0, -k * y * margins).mean() + 1e-3 * np.log(k) ** 2 / len(y) for k in tries]
    return float(tries[int(np.argmin(loss))])


@dataclass
class Fitted:
    """What tasks need to predict."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    prior: np.ndarray | None = None
    chance: np.ndarray | None = None  # logs, by family and bucket
    sharpness: float = 1.0
    machines: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def family(self, counts: np.ndarray) -> tuple[int, np.ndarray]:
        """The likeliest family, and the log odds of all."""
        odds = self.prior + self.chance @ counts
        return int(odds.argmax()), (odds - odds.max()) / (1 + counts.sum()) ** 0.5

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.families:
            return UNKNOWN, 0.0
        k, odds = self.family(counts)
        sure = 1 / np.exp(self.sharpness * odds).sum()
        names = self.members[k]
        if len(names) == 1:
            return names[0], float(sure)
        x = shares(counts)
        votes, chances = dict.fromkeys(names, 0), {n: [] for n in names}
        for (a, b), (w, steep) in self.machines.items():
            if a in chances and b in chances:
                p = float(1 / (1 + np.exp(-np.clip(steep * float(x @ w), -500, 500))))
                votes[a if p >= 0.5 else b] += 1
                chances[a].append(p)
                chances[b].append(1 - p)
        best = min(names, key=lambda n: (-votes[n], -sum(chances[n]), n))
        return best, float(sure) * sum(chances[best]) / len(chances[best])


class LanguageId:
    """families: names of languages, parted by spaces, by family; examples: texts of a language that machines are fitted on at most."""

    def __init__(self, families: dict[str, str] | None = None, examples: int = 800):
        self.family_of = {n: f for f, names in (FAMILIES if families is None else families).items() for n in names.split()}
        self.examples, self.fitted = examples, Fitted()

    def fit(self, docs: DataFrame, usable: Column | None = None, text: str = "text", label: str = "lang") -> LanguageId:
        """Learns from text and label of the usable rows."""
        rows = docs.where(F.lit(True) if usable is None else usable).select(F.col(label).cast("string").alias("name"), F.col(text).alias("body"))
        rows = rows.where(F.col("name").isNotNull() & F.col("body").isNotNull())

        def count(batches):
            totals: dict[str, np.ndarray] = {}
            documents: dict[str, int] = {}
            for batch in batches:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = profile(body.as_py())
                    if own is not None:
                        totals[name] = totals[name] + own if name in totals else own
                        documents[name] = documents.get(name, 0) + 1
            for name, own in totals.items():
                some = np.append(np.flatnonzero(own), -1)
                n = np.append(own[some[:-1]], documents[name])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int64()), pa.array(n, pa.int64())], names=["name", "bucket", "n"])

        counted = rows.mapInArrow(count, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n"))
        found = counted.toPandas()  # at most one row per language and bucket
        names = sorted(found["name"].unique())
        self.fitted = Fitted()
        if not names:
            return self
        by_family: dict[str, list[str]] = {}
        for n in names:
            by_family.setdefault(self.family_of.get(n, n), []).append(n)
        told = self.fitted
        told.families = sorted(by_family)
        told.members = [by_family[f] for f in told.families]
        place = found["name"].map({n: k for k, f in enumerate(told.families) for n in by_family[f]}).to_numpy()
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        totals, documents = np.zeros((len(told.families), 1 << BITS)), np.zeros(len(told.families))
        np.add.at(totals, (place[bucket >= 0], bucket[bucket >= 0]), n[bucket >= 0])
        np.add.at(documents, place[bucket < 0], n[bucket < 0])
        told.prior = np.log(documents / documents.sum())
        told.chance = np.log((totals + 0.5) / (totals + 0.5).sum(axis=1, keepdims=True))
        sample = written(self._sample(rows, names))
        self._machines(sample)
        self._sharpen(sample)
        drop(sample)
        return self

    def _sample(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """name and counts of at most `examples` distinct texts of a language, those of least hash."""
        hashed = rows.withColumn("h", F.xxhash64("body", F.lit(1)))
        each = hashed.groupBy("name").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
        # a fifth and a few more than wanted, as the counts are estimates
        share = {r["name"]: min(1.0, (1.2 * self.examples + 50) / max(1, r["n"])) for r in each}
        least = F.coalesce(F.create_map(*(F.lit(x) for n in names for x in (n, int(share.get(n, 1.0) * (1 << 40)))))[F.col("name")], F.lit(0))
        some = hashed.where(F.pmod("h", F.lit(1 << 40)) <= least)

        def told(batches):
            for batch in batches:
                own = [profile(b.as_py()) for b in batch.column(2)]
                keep = [k for k, x in enumerate(own) if x is not None]
                counts = pa.array([own[k].astype("<u4").tobytes() for k in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), counts], names=["name", "h", "counts"])

        # equal texts meet by their hash before any is counted
        distinct = some.groupBy("name", "h").agg(F.min("body").alias("body"))
        rank = F.row_number().over(Window.partitionBy("name").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
        few = distinct.withColumn("rank", rank).where(F.col("rank") <= self.examples).select("name", "h", "body")
        return few.mapInArrow(told, "name string, h long, counts binary")

    def _machines(self, sample: DataFrame) -> None:
        pairs = [(a, b) for own in self.fitted.members for a, b in combinations(own, 2)]
        if not pairs:
            return
        of = F.create_map(*(F.lit(x) for n in {n for p in pairs for n in p} for x in (n, [k for k, p in enumerate(pairs) if n in p])))
        dealt = sample.withColumn("pair", F.explode(of[F.col("name")]))

        def fit(key, own: pd.DataFrame) -> pd.DataFrame:
            k = int(key[0])
            own = own.sort_values(["h", "name"])
            x = np.stack([shares(np.frombuffer(c, dtype="<u4")) for c in own["counts"]])
            y = np.where(own["name"] == pairs[k][0], 1, -1).astype(np.float32)
            half, margins = np.arange(len(y)) % 2, np.zeros(len(y))
            for side in (0, 1):
                margins[half == side] = x[half == side] @ machine(x[half != side], y[half != side])
            return pd.DataFrame({"pair": [k], "weights": [machine(x, y).tobytes()], "steep": [slope(margins, y)]})

        for r in dealt.groupBy("pair").applyInPandas(fit, "pair int, weights binary, steep double").collect():  # one row a pair of languages
            self.fitted.machines[pairs[r["pair"]]] = (np.frombuffer(r["weights"], dtype=np.float32), r["steep"])

    def _sharpen(self, sample: DataFrame) -> None:
        """How sure the log odds of families make, from the examples' own families."""
        told = self.fitted
        place = {n: k for k, own in enumerate(told.members) for n in own}

        def margins(batches):
            for batch in batches:
                out = []
                for name, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    odds = told.family(np.frombuffer(counts, dtype="<u4"))[1]
                    others = np.delete(odds, place[name])
                    out.append(odds[place[name]] - others.max() if len(others) else 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["margin"])

        found = sample.select("name", "counts").mapInArrow(margins, "margin double").toPandas()["margin"].to_numpy()  # one number an example
        told.sharpness = slope(np.sort(found), np.ones(len(found)))

    def predict(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """One row a document: id, lang_pred, family (null where unknown), score."""
        told = self.fitted
        family = {n: f for f, own in zip(told.families, told.members, strict=True) for n in own}

        def run(batches):
            for batch in batches:
                got = [told.predict(profile(b.as_py())) for b in batch.column(1)]
                columns = [pa.array([n for n, _ in got], pa.string()), pa.array([family.get(n) for n, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "family", "score"])

        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, family string, score double")
