"""Toxicity by the nearest labelled examples.

Terms are words and the first letters of words (for languages that inflect and
compound). The vocabulary is all terms of a bounded sample of labelled rows
(``examples``, the ones of least id hash), of either label and of whole texts;
their document frequencies are counted over all documents. A term weighs
(1 + log of its count) * idf * (1 + boost * its surplus), where the surplus is
the lower bound (``sure`` standard errors) of the log odds by which label 1 has
it more often: labels weigh terms, but take none away. Vectors have length 1.

The examples lie in an inverted index in blocks. Postings are laid out by term
and block, with the greatest weight of each term in each block, so that a query
bounds what a block can hold; the blocks of greatest bound give k rows to beat,
and of the others only those are read whose bound reaches the k-th of these.
The few terms that a large part of the examples have are columns of a matrix,
which is multiplied by a batch of queries at once before any block is bounded.
The result is the k nearest by exact cosine. Examples are placed by their
vectors, then their labels, and ties fall by place: ids decide nothing.

Votes count by nearness, drawn a little towards the share of label 1. A logistic
curve, fitted to the votes that each example gets from all others, turns them
into chances. A text without any known term (blank texts above all) gets the
label's share among examples without terms.

Scores come from texts alone. Null and blank texts have no terms. Labels that
are null are not used; of repeated labels of an id the greatest counts. Repeated
rows and null ids get a score each. Without labels of both kinds all scores are
drawn from the (smoothed) share of label 1. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import written

_LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are terms.
STEMS = (4, 5)
#: Words whose terms are remembered.
MEMORY = 300_000
#: Texts that are scored together.
TOGETHER = 128


def terms(word: str) -> list[str]:
    """A word's terms: each run of letters (marked by a bar) and its beginnings."""
    if word.isalpha() and len(word) > STEMS[-1]:
        return [word + "|", *[word[:n] for n in STEMS]]
    out = []
    for w in _LETTERS.findall(word):
        out.append(w + "|")
        out += [w[:n] for n in STEMS if len(w) > n]
    return out


def counted(text: str | None) -> dict[str, int]:
    """How often each term stands in a text."""
    out: dict[str, int] = {}
    for word, n in Counter((text or "").lower().split()).items():
        for t in terms(word):
            out[t] = out.get(t, 0) + n
    return out


class _Places(dict):
    """The places of each word's known terms, found once."""

    def __init__(self, known: list[str]):
        super().__init__()
        self.place = {t: k for k, t in enumerate(known)}.get

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple([k for k in map(self.place, terms(word)) if k is not None])
        if len(self) >= MEMORY:
            self.clear()
        if len(word) < 100:  # longer ones are looked up anew
            self[word] = found
        return found


class Vocabulary:
    """Counts the known terms of texts by their places."""

    def __init__(self, known: list[str]):
        self.words = _Places(known)

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text's terms, in order, and how often each stands there."""
        found = chain.from_iterable(map(self.words.__getitem__, _LETTERS.findall((text or "").lower())))
        places = np.fromiter(found, dtype=np.int64)
        places.sort()
        new = np.flatnonzero(np.concatenate((places[:1] == places[:1], places[1:] != places[:-1])))
        return places[new], np.diff(new, append=len(places))


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of all ranges, one after the other."""
    n = ends - begins
    return np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


class BlockMaxIndex:
    """The nearest of a set of sparse vectors of length 1 by exact cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]] | list[dict[int, float]], n_terms: int, block: int = 64):
        """vectors: (terms, weights) each, or dictionaries."""
        vectors = [(list(v), list(v.values())) if isinstance(v, dict) else v for v in vectors]
        self.block, self.n = block, len(vectors)
        self.n_blocks = -(-self.n // block) or 1
        sizes = [len(t) for t, _ in vectors]
        rows = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        own = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int32)
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        #: Terms in a twentieth of all rows have a list that is nearly whole: these are columns of a matrix.
        dense = np.bincount(own, minlength=n_terms) > max(self.n // 20, 8)
        self.column = np.where(dense, np.cumsum(dense) - 1, -1)
        self.common = dense[own].nonzero()[0]
        self.common = rows[self.common], self.column[own[self.common]], weights[self.common]
        order = np.lexsort((rows, own))
        order = order[~dense[own[order]]]
        own, self.rows, self.weights = own[order], rows[order], weights[order]
        #: One entry per term and block: its block, where its postings begin (and the next one's), its greatest weight.
        blocks = self.rows // block
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (blocks[1:] != blocks[:-1])
        at = np.flatnonzero(new)
        self.blocks = blocks[at]
        self.begins = np.concatenate((at, [len(own)]))
        self.most = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        #: Where each term's entries begin.
        self.entries = np.searchsorted(own[at], np.arange(n_terms + 1))
        self._matrix = None

    @property
    def matrix(self) -> np.ndarray:
        """Weights of the common terms, by column and row; the rows of a block are padded to its size."""
        if self._matrix is None:
            rows, columns, weights = self.common
            self._matrix = np.zeros((max(1, int(self.column.max(initial=-1)) + 1), self.n_blocks * self.block))
            self._matrix[columns, rows] = weights
        return self._matrix

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """search() of one vector as a dictionary."""
        return self.search([(np.array(list(query), dtype=np.int64), np.array(list(query.values()), dtype=float))], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the k nearest rows with a cosine above 0, nearest first, for each query (different terms, their weights)."""
        common = np.zeros((len(queries), len(self.matrix)))
        for own, (t, q) in zip(common, queries, strict=True):
            column = self.column[t]
            own[column[column >= 0]] = q[column >= 0]
        return [self._search(t, q, sums, k) for (t, q), sums in zip(queries, common @ self.matrix, strict=True)]

    def _search(self, t: np.ndarray, q: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """sums: what the common terms give each row."""
        low, high = self.entries[t], self.entries[t + 1]
        entries, weights = _ranges(low, high), np.repeat(q, high - low)
        blocks = self.blocks[entries]
        bound = sums.reshape(self.n_blocks, self.block).max(axis=1) + np.bincount(blocks, self.most[entries] * weights, minlength=self.n_blocks)

        def rare(which: np.ndarray) -> np.ndarray:
            """What the other terms give the rows of some blocks."""
            use = which[blocks]
            begins, ends = self.begins[entries[use]], self.begins[entries[use] + 1]
            at = _ranges(begins, ends)
            return np.bincount(self.rows[at], self.weights[at] * np.repeat(weights[use], ends - begins), minlength=len(sums))

        first = np.zeros(self.n_blocks, dtype=bool)
        first[np.argsort(-bound, kind="stable")[: 1 + -(-k // self.block)]] = True
        cosine = np.where(np.repeat(first, self.block), sums + rare(first), 0)
        least = np.partition(cosine, -k)[-k] if self.n > k else 0.0
        more = (bound > 0) & (bound >= least - 1e-9) & ~first
        if more.any():
            cosine += np.where(np.repeat(more, self.block), sums + rare(more), 0)
            least = np.partition(cosine, -k)[-k] if self.n > k else 0.0
        hit = np.flatnonzero(cosine > max(1e-15, least - 1e-9))
        best = hit[np.lexsort((hit, -np.round(cosine[hit], 12)))[:k]]
        return best, cosine[best]


def surplus(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int, sure: float) -> np.ndarray:
    """By how much at least (in log odds) examples of label 1 have a term more often; 0 where that isn't sure."""
    odds = lambda c, n: np.log((c + 0.5) / (n - c + 0.5))
    return np.maximum(0.0, odds(yes, n_yes) - odds(no, n_no) - sure * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)))


def _logit(p):
    return np.log(p) - np.log1p(-p)


def calibrated(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes (their log odds) to chances of label 1; (1, 0) where it can't be fitted."""
    yes, no = int(labels.sum()), int((~labels).sum())
    if not yes or not no:
        return 1.0, 0.0
    goal = np.where(labels, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack((_logit(np.clip(votes, 1e-6, 1 - 1e-6)), np.ones(len(votes))))
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p))
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


Counts = tuple[np.ndarray, np.ndarray]


class Model:
    """What tasks need to score texts: the known terms, their weights, the index and the examples' labels and ids."""

    def __init__(self, known: list[str], weight: np.ndarray, examples: list[tuple[Counts, bool, str]], k: int, pull: float):
        self.known, self.weight, self.k, self.pull, self._index = known, weight, k, pull, None
        # like ones share blocks: by their most frequent terms (those of least weight), then by all, then by label
        rank = np.empty(len(weight), dtype=np.int64)
        rank[np.argsort(weight, kind="stable")] = np.arange(len(weight))
        some = sorted(((sorted(rank[t].tolist()), n[np.argsort(rank[t])].tolist(), label, i, (t, n)) for (t, n), label, i in examples if len(t)), key=lambda e: e[:3])
        self.votes, self.ids = np.array([e[2] for e in some], dtype=bool), [e[3] for e in some]
        shortest = lambda parts, kind: np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind)
        self.lists = [len(e[4][0]) for e in some], shortest((e[4][0] for e in some), np.int32), shortest((e[4][1] for e in some), np.uint32)
        blank = [label for (t, _), label, _ in examples if not len(t)]
        self.share = (sum(label for _, label, _ in examples) + 0.5) / (len(examples) + 1)
        self.blank_score = (sum(blank) + self.share) / (len(blank) + 1)
        self.curve = (1.0, 0.0)

    def __getstate__(self):
        return self.__dict__ | {"_index": None}  # each worker builds it once from the counts, which are a fraction of its size

    @property
    def index(self) -> BlockMaxIndex:
        if self._index is None:
            sizes, t, n = self.lists
            ends = np.cumsum(sizes, dtype=np.int64)
            rows = [(t[b - s : b].astype(np.int64), n[b - s : b]) for s, b in zip(sizes, ends, strict=True)]
            self._index = BlockMaxIndex([(c[0], self.vector(c)) for c in rows], len(self.known))
        return self._index

    def vector(self, counts: Counts) -> np.ndarray:
        """The weights of counted terms, of length 1."""
        raw = (1 + np.log(counts[1].astype(np.float64))) * self.weight[counts[0]]
        return raw / (np.sqrt(raw @ raw) or 1.0)

    def vote(self, cosine: np.ndarray, labels: np.ndarray) -> float:
        """The votes of near examples, drawn towards the share of label 1."""
        near = cosine**2 / (0.05 + np.maximum(0.0, 1 - cosine))
        return float((near @ labels + self.pull * self.share) / (near.sum() + self.pull))

    def chance(self, vote: float) -> float:
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-(slope * _logit(min(1 - 1e-6, max(1e-6, vote))) + offset))))

    def nearest(self, texts: list[Counts], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the examples nearest to each text."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            out += self.index.search([(c[0], self.vector(c)) for c in texts[at : at + TOGETHER]], k)
        return out

    def judge(self, texts: list[Counts]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each text's score, and the examples it rests on with their cosines."""
        none = self.blank_score, np.zeros(0, np.int64), np.zeros(0)
        if not self.ids:
            return [none] * len(texts)
        found = self.nearest(texts, self.k)
        return [(round(self.chance(self.vote(cosine, self.votes[near])), 9), near, cosine) if len(c[0]) else none for c, (near, cosine) in zip(texts, found, strict=True)]

    def left_out(self, texts: list[Counts], labels: list[bool]) -> list[float]:
        """The vote on each example by all others: one of its own vector and label is left out."""
        out = []
        for (near, cosine), label in zip(self.nearest(texts, self.k + 1), labels, strict=True):
            same = np.flatnonzero((cosine > 1 - 1e-9) & (self.votes[near] == label))
            keep = np.delete(np.arange(len(near)), same[:1])[: self.k]
            out.append(self.vote(cosine[keep], self.votes[near[keep]]))
        return out


def _judged(model: Model, words: Vocabulary, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The judgement of each text; equal texts of a batch are judged once."""
    kinds = list(dict.fromkeys(texts))
    known = dict(zip(kinds, model.judge([words.count(t) for t in kinds]), strict=True))
    return [known[t] for t in texts]


def _packed(counts: Counts) -> tuple[bytes, bytes]:
    """Places and counts as bytes: steps between places, and counts in one byte each where they fit."""
    places, n = counts
    return np.diff(places, prepend=0).astype("<u4").tobytes(), n.astype("u1" if not len(n) or n.max() < 256 else "<u4").tobytes()


def _unpacked(places: bytes, n: bytes) -> Counts:
    steps = np.frombuffer(places, dtype="<u4")
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(n, dtype="u1" if len(n) == len(steps) else "<u4")


class Toxicity:
    """fit() learns from labelled rows; score() gives every row a score and its evidence."""

    def __init__(self, text: str = "text", key: str = "doc_id", label: str = "toxic", examples: int = 2_500, sure: float = 1.5, boost: float = 2.0, k: int = 16, pull: float = 0.1):
        self.text, self.key, self.label = text, key, label
        self.examples, self.sure, self.boost, self.k, self.pull = examples, sure, boost, k, pull

    def _rows(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.key).alias("id"), F.col(self.text).alias("text"))

    def fit(self, docs: DataFrame, labels: DataFrame, usable: Column | None = None, hold: bool = False) -> Toxicity:
        """hold: the terms of docs are written down, so that score() of the same frame need not count them again."""
        known = labels.where(F.col(self.label).isNotNull() & F.col(self.key).isNotNull() & (F.lit(True) if usable is None else usable))
        known = known.groupBy(F.col(self.key).alias("id")).agg((F.max(self.label) > 0).alias("label"))
        # labels of ids that docs lack take no places; at most `examples` narrow rows: a proven bound for the broadcast
        known = known.join(self._rows(docs).select("id").distinct(), "id", "left_semi")
        sample = written(known.orderBy(F.xxhash64("id"), "id").limit(self.examples))
        # equal rows of an id are one example, and rows of one id count towards the bound each
        rows = self._rows(docs).withColumn("body", F.xxhash64("text"))
        chosen = rows.join(F.broadcast(sample), "id").select("id", "body", "label").distinct()
        chosen = written(chosen.orderBy(F.xxhash64("id"), "id", "body").limit(self.examples))
        found = rows.join(F.broadcast(chosen), ["id", "body"]).dropDuplicates(["id", "body"])
        found = written(found.select(F.col("id").cast("string").alias("id"), "text", "label"))
        counted = written(found.mapInArrow(_all_terms, "id string, label boolean, terms array<string>, n array<int>")).toArrow()  # one row per example
        lists = counted.column("terms").combine_chunks()
        coded = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        coded = coded.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        own, n = coded.indices.to_numpy(zero_copy_only=False), np.concatenate([np.zeros(0, np.int64), *(x.as_py() or [] for x in counted.column("n"))]).astype(np.int64)
        sizes = [len(x) for x in counted.column("terms")]
        order = np.argsort(np.array(known, dtype=object), kind="stable") if known else np.zeros(0, np.int64)
        place = np.empty(len(known), dtype=np.int64)
        place[order] = np.arange(len(known))
        known, own = [known[k] for k in order], place[own] if len(own) else np.zeros(0, np.int64)
        marks = np.array(counted.column("label").to_pylist(), dtype=bool)
        self.held = (docs, self._counts(docs, known)) if hold else None
        frequency, total = self._frequencies(docs, known)
        by_label = [np.bincount(own[np.repeat(marks == want, sizes)], minlength=len(known)) if len(own) else np.zeros(len(known)) for want in (True, False)]
        weight = np.log((total + 1) / (frequency + 0.5))
        if marks.any() and not marks.all():
            weight = weight * (1 + self.boost * surplus(*by_label, int(marks.sum()), int((~marks).sum()), self.sure))
        ends = np.cumsum(sizes)
        counts = [(own[b - s : b], n[b - s : b]) for s, b in zip(sizes, ends, strict=True)]
        self.model = Model(known, weight, list(zip(counts, marks.tolist(), counted.column("id").to_pylist(), strict=True)), self.k, self.pull)
        self.shared = docs.sparkSession.sparkContext.broadcast(self.model)  # its size is that of at most `examples` texts
        self._calibrate(found)
        return self

    def _counts(self, docs: DataFrame, known: list[str]) -> DataFrame:
        """id, and places and counts of each row's terms."""
        rows = self._rows(docs)
        kind = rows.schema["id"].dataType.simpleString()
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches):
            words = Vocabulary(shared.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = [words.count(text) for text in batch.column("text").to_pylist()]
                bytes_of = [pa.array(part, pa.binary()) for part in zip(*map(_packed, found), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *bytes_of], names=["id", "terms", "n"])

        return written(rows.mapInArrow(run, f"id {kind}, terms binary, n binary"))

    def _frequencies(self, docs: DataFrame, known: list[str]) -> tuple[np.ndarray, int]:
        """In how many documents each known term stands, and the number of documents."""
        counted, size = self.held is not None, len(known)
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches):
            words, frequency, n = None if counted else Vocabulary(shared.value), np.zeros(size + 1, dtype=np.int64), 0
            for batch in batches:
                found = [_unpacked(x, b"")[0] for x in batch.column(0).to_pylist()] if counted else [words.count(text)[0] for text in batch.column(0).to_pylist()]
                frequency += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=size + 1)
                n += len(found)
            frequency[-1] = n
            some = np.flatnonzero(frequency)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(frequency[some])], names=["term", "n"])

        rows = self.held[1].select("terms") if counted else docs.select(self.text)
        rows = rows.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row per known term
        out = np.zeros(size + 1, dtype=np.int64)
        out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
        return out[:-1], int(out[-1])

    def _calibrate(self, found: DataFrame) -> None:
        shared = self.shared

        def run(batches):
            model = shared.value
            words = Vocabulary(model.known)
            for batch in batches:
                rows = [(words.count(t), bool(label)) for t, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)]
                counts, labels = [c for c, _ in rows if len(c[0])], [label for c, label in rows if len(c[0])]
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(model.left_out(counts, labels)), pa.array(labels)], names=["vote", "label"])

        rows = found.mapInArrow(run, "vote double, label boolean").toArrow()  # one row per example
        votes, labels = rows.column("vote").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=bool)
        order = np.lexsort((labels, votes))  # sums in one order
        self.model.curve = calibrated(votes[order], labels[order])

    def score(self, docs: DataFrame, evidence: int = 3) -> DataFrame:
        """One row per row: id, score, evidence (ids of the nearest examples, as text, with their cosines)."""
        held = self.held is not None and self.held[0] is docs
        rows = self.held[1] if held else self._rows(docs)
        kind = rows.schema["id"].dataType.simpleString()
        shared, curve = self.shared, self.model.curve

        def run(batches):
            model = shared.value
            model.curve = curve
            words = None if held else Vocabulary(model.known)
            shape = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64())]))
            for batch in batches:
                if held:
                    judged = model.judge(list(map(_unpacked, batch.column("terms").to_pylist(), batch.column("n").to_pylist())))
                else:
                    judged = _judged(model, words, batch.column("text").to_pylist())
                shown = [[{"example": model.ids[k], "cosine": c} for k, c in zip(near[:evidence].tolist(), cosine[:evidence].tolist(), strict=True)] for _, near, cosine in judged]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([j[0] for j in judged], pa.float64()), pa.array(shown, shape)], names=["id", "score", "evidence"])

        return rows.mapInArrow(run, f"id {kind}, score double, evidence array<struct<example:string,cosine:double>>")

    def keep(self, docs: DataFrame, least: float = 0.7) -> DataFrame:
        """The rows whose score is below least, with the columns of docs; nothing is shuffled."""
        shared, curve, place = self.shared, self.model.curve, docs.columns.index(self.text)

        def run(batches):
            model = shared.value
            model.curve = curve
            words = Vocabulary(model.known)
            for batch in batches:
                yield batch.filter(pa.array([score < least for score, *_ in _judged(model, words, batch.column(place).to_pylist())], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def _all_terms(batches):
    for batch in batches:
        found = [counted(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["id", "label", "terms", "n"])
