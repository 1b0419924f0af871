import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
from shared import DATA

from marlstone.operators import keywords, vectors
from marlstone.operators.keywords import KeywordIndex, best, diverse, fused
from marlstone.operators.vectors import CellIndex

SHAPE = "vec_id long, embedding array<float>, label int, id string, cell int, v double"


def rows_of(spark, some):
    return spark.createDataFrame([(k, v, 1, "x", 7, 0.5) for k, v in some], SHAPE)


def nearest(rows, asked, k):
    """All distances, in Python."""
    out = []
    for q, v in asked:
        if v:
            away = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in rows if w)
            out += [(q, i, round(d, 9), r + 1) for r, (d, i) in enumerate(away[:k])]
    return sorted(out)


def searched(index, spark, asked, k, **more):
    got = index.search(rows_of(spark, asked), k, **more)
    return sorted((r["query_id"], r["vec_id"], round(r["distance2"], 9), r["rank"]) for r in got.collect())


def cloud(seed, n, width=6, centres=8):
    """Vectors of small whole numbers around some centres, so that distances are exact and ties occur."""
    rng = random.Random(seed)
    middles = [[rng.randint(-20, 20) for _ in range(width)] for _ in range(centres)]
    return [(k, [float(x + rng.randint(-2, 2)) for x in rng.choice(middles)]) for k in range(n)]


@pytest.mark.parametrize(("cells", "least"), [(None, 1024), (1, 20), (40, 1024), (40, 3)])
def test_index_is_exact(spark, monkeypatch, cells, least):
    monkeypatch.setattr(vectors, "RING_ROWS", least)
    rows = cloud(1, 700)
    asked = rows[::23] + [(-1, [100.0] * 6), (-2, [0.0] * 6)]
    index = CellIndex(rows_of(spark, rows), cells=cells)
    assert searched(index, spark, asked, 5) == nearest(rows, asked, 5)
    share = index.share_read(len(asked))
    assert share <= 1.0 and (cells != 40 or share < 0.5)


def test_index_of_awkward_rows(spark):
    """Null, empty and equal vectors, fewer rows than asked for, repeated queries' keys, and nothing at all."""
    rows = [(k, [1.0, 1.0]) for k in range(60)] + [(100, None), (101, []), (102, [5.0, 5.0]), (103, [5.0, 5.0])]
    asked = [(1, [1.0, 1.0]), (2, None), (3, [5.0, 5.0]), (4, [])]
    index = CellIndex(rows_of(spark, rows))
    assert searched(index, spark, asked, 4) == nearest(rows, asked, 4)
    assert searched(index, spark, asked[:1], 100) == nearest(rows, asked[:1], 100)
    assert searched(index, spark, [(2, None)], 4) == [] == searched(CellIndex(rows_of(spark, [])), spark, asked, 4)


def test_hot_ring_is_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 10)
    rows = [(k, [3.0, 4.0]) for k in range(600)] + [(1000 + k, [float(k % 30), float(k // 30)]) for k in range(300)]
    asked = rows[:40] + rows[600::20]
    assert searched(CellIndex(rows_of(spark, rows)), spark, asked, 6) == nearest(rows, asked, 6)


def test_clustered_vectors_are_read_in_part(spark):
    rng = random.Random(9)
    middles = [[rng.uniform(-50, 50) for _ in range(16)] for _ in range(30)]
    rows = [(k, [x + rng.uniform(-1, 1) for x in rng.choice(middles)]) for k in range(3000)]
    index = CellIndex(rows_of(spark, rows))
    got = {(q, i): r for q, i, _, r in searched(index, spark, rows[::100], 5)}
    near = lambda v: sorted(((np.float32(v) - np.float32(w)).astype(float) ** 2).sum().item() for _, w in rows)[:5]
    assert len(got) == 150 and index.share_read(30) < 0.2
    told = dict(rows)
    for q, v in rows[::100]:
        mine = sorted(((np.float32(v) - np.float32(told[i])).astype(float) ** 2).sum().item() for (k, i) in got if k == q)
        assert np.allclose(mine, near(v))


def test_index_fitted_on_a_few_rows_is_exact(spark):
    rows = cloud(3, 500)
    assert searched(CellIndex(rows_of(spark, rows), sample=12), spark, rows[:30], 7, first=1) == nearest(rows, rows[:30], 7)


def test_index_reads_a_part_of_the_documents_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    index = CellIndex(rows)
    asked = rows.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in index.search(asked, 5).select("query_id", "vec_id", "rank").collect())
    told = rows.collect()
    names, all_ = np.array([r["vec_id"] for r in told]), np.array([r["embedding"] for r in told], dtype=float)
    want = []
    for r in told:
        if r["vec_id"] % 20 == 0:
            d = ((all_ - np.array(r["embedding"], dtype=float)) ** 2).sum(axis=1)
            want += [(r["vec_id"], int(names[k]), i + 1) for i, k in enumerate(np.lexsort((names, d))[:5])]
    assert got == sorted(want)
    assert index.share_read(asked.count()) <= 1  # these vectors are spread evenly: nothing can be left out for sure


def terms(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bm25(docs, queries, k, k1=1.5, b=0.75):
    lengths = {i: len(terms(t)) for i, t in docs}
    mean = max(1, sum(lengths.values())) / len(docs)
    holds = defaultdict(dict)
    for i, t in docs:
        for w, n in Counter(terms(t)).items():
            holds[w][i] = n
    out = []
    for q, t in queries:
        score = Counter()
        for w, times in Counter(terms(t)).items():
            n = len(holds[w])
            rarity = log(1 + (len(docs) - n + 0.5) / (n + 0.5))
            for i, f in holds[w].items():
                score[i] += times * int(1e6 * rarity * (f * (k1 + 1) / (f + k1 * (1 - b + b * lengths[i] / mean))) + 0.5)
        out += [(q, i, s / 1e6, r + 1) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def text_frame(spark, rows, key="doc_id"):
    return spark.createDataFrame([(k, t, "t", 1, 2, 3) for k, t in rows], f"{key} long, text string, term string, impact int, score int, n int")


def word_rows(seed, n, most=30):
    """Words of very unlike frequency."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 500}"
    return [(k, rng.choice([" ", ", ", "-"]).join(["the"] * rng.randint(0, 3) + [word() for _ in range(rng.randint(0, most))])) for k in range(n)]


@pytest.mark.parametrize("k", [1, 4, 50])
def test_bm25_is_brute_force(spark, k):
    docs = word_rows(1, 400) + [(1000, None), (1001, ""), (1002, "Ünïcode ÉTÉ 日本"), (1003, "THE the The")]
    queries = word_rows(2, 40, 8) + [(900, None), (901, ""), (902, "unknownword"), (903, "the"), (904, "the the été"), (905, "日本 the w1 w1")]
    index = KeywordIndex(text_frame(spark, docs))
    got = index.search(text_frame(spark, queries, "query_id"), k)
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == bm25(docs, queries, k)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_bm25_by_a_pass_is_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(keywords, "HELD", 6000)  # batches of few texts
    docs = word_rows(1, 400) + [(1000, None), (1001, ""), (1002, "Ünïcode ÉTÉ 日本"), (1003, "THE the The")] + [(2000 - n, "copy the w1") for n in range(60)]
    queries = word_rows(2, 40, 8) + [(900, None), (901, ""), (902, "unknownword"), (903, "the"), (904, "the the été"), (905, "日本 the w1 w1"), (906, "copy")]
    held, asked = text_frame(spark, docs).repartition(3), text_frame(spark, queries, "query_id")
    monkeypatch.setattr(keywords, "KeywordIndex", None)
    got = keywords.searched(held, asked, k)
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == bm25(docs, queries, k)
    assert keywords.searched(held.limit(0), asked, k).count() == keywords.searched(held, asked.limit(0), k).count() == 0
    monkeypatch.undo()
    monkeypatch.setattr(keywords, "FEW", 0)  # as many as take the index
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in keywords.searched(held, asked, k).collect()) == bm25(docs, queries, k)


def test_bm25_leaves_common_terms_out(spark, monkeypatch):
    """With a bound from rare terms, common ones bring in no documents of their own, and the answer stays whole."""
    monkeypatch.setattr(keywords, "FIRST", 4)
    docs = [(k, "the of and " + ("rare word" if k % 50 == 0 else f"x{k}")) for k in range(500)]
    queries = [(1, "the rare word"), (2, "the of and"), (3, "the x7 x8")]
    index = KeywordIndex(text_frame(spark, docs))
    got = index.search(text_frame(spark, queries, "query_id"), 3)
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == bm25(docs, queries, 3)
    assert {(r["query_id"], r["term"]) for r in index.asked.where("common").collect()} >= {(1, "the")}


def test_bm25_of_nothing(spark):
    none = text_frame(spark, [])
    assert KeywordIndex(none).search(text_frame(spark, [(1, "a")], "query_id")).count() == 0
    assert KeywordIndex(text_frame(spark, [(1, "a b")])).search(text_frame(spark, [], "query_id")).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (3, 5, 1)], "query_id long, id long, rank int")
    got = sorted((r["query_id"], r["id"], r["rank"], r["score"]) for r in fused([a, b], 3).collect())
    one = lambda r: round(1e9 / (60 + r)) / 1e9
    assert got == [(1, 10, 2, one(1)), (1, 11, 3, one(2)), (1, 12, 1, round(one(1) + one(3), 9)), (2, 10, 1, one(1)), (3, 5, 1, one(1))]
    assert fused([a.limit(0), b.limit(0)]).count() == 0


def test_best_breaks_ties_by_key(spark):
    some = spark.createDataFrame([(1, k, 5) for k in (9, 3, 7)], "query_id long, id long, score long")
    assert [(r["id"], r["rank"]) for r in best(some, 2).orderBy("rank").collect()] == [(3, 1), (7, 2)]


def greedy(query, rows, k, balance):
    cosine = lambda a, b: int(np.floor(abs(c) * 1e9 + 0.5) * np.sign(c)) if (c := np.dot(a, b) / (np.sqrt(np.dot(a, a) * np.dot(b, b)) or 1)) else 0
    half_up = lambda x: int(np.floor(abs(x) + 0.5) * np.sign(x))
    left, taken = dict(rows), []
    while left and len(taken) < k:
        value = {i: half_up(balance * cosine(v, query) - (1 - balance) * max((cosine(v, dict(rows)[j]) for j, _ in taken), default=0)) for i, v in left.items()}
        best_ = min(left, key=lambda i: (-value[i], i))
        taken.append((best_, value[best_] / 1e9))
        del left[best_]
    return taken


@pytest.mark.parametrize("balance", [0.0, 0.5, 0.7, 1.0])
def test_diverse_is_greedy(spark, balance):
    rng = random.Random(5)
    lists = {q: [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(rng.choice([1, 3, 12]))] for q in range(12)}
    lists[3] = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)] + [(9, [0.0] * 4)]
    asked = {q: [float(rng.randint(-3, 3)) for _ in range(4)] for q in lists}
    flat = [(q, i, v, asked[q], 0, "c") for q, own in lists.items() for i, v in own] + [(0, 500, None, asked[0], 0, "c"), (50, 1, [1.0] * 4, None, 0, "c")]
    got = defaultdict(dict)
    for r in diverse(spark.createDataFrame(flat, "query_id long, id long, v array<double>, q array<double>, near int, taken string"), 4, balance).collect():
        got[r["query_id"]][r["rank"]] = (r["id"], r["score"])
    for q, own in lists.items():
        assert [got[q][k + 1] for k in range(len(got[q]))] == greedy(asked[q], own, 4, balance), q
    assert set(got) == set(lists)


def test_documents_in_reach(spark):
    """Every passage of the benchmark finds a document that holds it, where one does."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    hits = KeywordIndex(docs).search(asked, 5).collect()
    told = {r["doc_id"]: r["text"] for r in docs.collect()}
    holders = {r["query_id"]: {i for i, t in told.items() if r["text"] in (t or "")} for r in asked.collect()}
    found = Counter(r["query_id"] for r in hits if r["id"] in holders[r["query_id"]])
    assert all(found[q] for q, own in holders.items() if own)


def test_queries_go_to_rings_in_small_batches(spark, monkeypatch):
    """A query's vector may go to every ring; a task holds a bounded number of those at once."""
    rows = cloud(5, 400)
    monkeypatch.setattr(vectors, "HELD", 300)
    assert searched(CellIndex(rows_of(spark, rows), cells=20), spark, rows[:30], 7) == nearest(rows, rows[:30], 7)
    whole = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert [len(b) for b in vectors.slices([whole, whole], 4)] == [4, 4, 2] * 2 and len(list(vectors.slices([whole], 0))) == 10
