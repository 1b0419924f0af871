import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from frames import LOWER, awkward, awkward_rows, empty
from pyspark.sql import functions as F
from shared import DATA

from marlstone.llm.importance import Resampler, collapsed, crcs


def runs(text, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return ws, [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def by_hand(rows, targets, n=2, buckets=10_000, percent=25, least=20, seed=7):
    """id, n_features, weight, score, rank; the definition, row by row."""
    hashed = [(k, len(ws), [zlib.crc32(f.encode()) % buckets for f in fs]) for k, (ws, fs) in ((k, runs(t, n)) for k, t in rows)]
    s = Counter(b for *_, own in hashed for b in own)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in targets for f in runs(x, n)[1])
    s_all, t_all = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for k, words, own in hashed:
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    take = percent * len(fit) // 100
    ranked = [(r[0], *r[2:], i + 1 if i < take else None) for i, r in enumerate(fit)]
    return sorted(ranked + [(r[0], *r[2:], None) for r in out if r[1] < least], key=str)


def got_rows(model, docs, target):
    got = model.draw(model.score(docs, target))
    return sorted((tuple(r) for r in got.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


PIECES = ["a", "B", "Zz9", " ", "  ", "-", "_", "@", "[", "`", "{", "\x7f", "\x00", "\n", "é", "É", "日本", "\xa0", "​", "👍", "0", "ß", "\x80"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_scans_give_every_run(n):
    rng = random.Random(n)
    for _ in range(2000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        ws, fs = runs(text, n)
        assert collapsed(text) == " ".join(ws).encode()
        assert crcs(collapsed(text), n).tolist() == [zlib.crc32(f.encode()) for f in fs], repr(text)


def test_long_texts_are_linear():
    import time

    for text in ("a" * 2_000_000, "a " * 1_000_000, "-" * 2_000_000, "é" * 1_000_000):
        begin = time.time()
        crcs(collapsed(text), 2)
        assert time.time() - begin < 15


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "x1", "日本"]
    rows += [(k, "; ".join(rng.choice(words) for _ in range(rng.choice([5, 19, 20, 21, 60])))) for k in range(100, 400)]
    rows += [rows[-1]] * 3 + [(None, rows[-2][1]), (101, rows[-5][1])]
    targets = ["alpha beta gamma", None, "", "alpha alpha; x1", rows[0][1]]
    docs, target = awkward(spark, [(k, t, None) for k, t in rows]), awkward(spark, [(None, t, None) for t in targets])
    want = by_hand(rows, targets)
    assert got_rows(Resampler(), docs, target) == want
    assert sum(r[-1] is not None for r in want) == 25 * sum(len(runs(t, 1)[0]) >= 20 for _, t in rows) // 100
    small = {"n": 3, "buckets": 70_000, "percent": 60, "least": 3, "seed": 1}
    assert got_rows(Resampler(3, 70_000, 60, 3, 1), docs, target) == by_hand(rows, targets, **small)


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, "one two " * 15) for k in (5, 3, 9, 3, 3, None)]
    model = Resampler(percent=50)
    scored = model.score(awkward(spark, [(k, t, None) for k, t in rows]), empty(spark)).withColumn("score", F.lit(4).cast("long"))
    assert sorted((r["rank"], r["id"]) for r in model.draw(scored).collect() if r["rank"]) == [(1, 3), (2, 3), (3, 3)]


def test_ranks_over_many_parts(spark):
    rows = [(k, f"w{k % 11} v{k % 7} " * 12) for k in range(3000)]
    docs = awkward(spark, [(k, t, None) for k, t in rows]).repartition(9)
    assert got_rows(Resampler(), docs, awkward(spark, [(1, "w1 v1 w2", None)])) == by_hand(rows, ["w1 v1 w2"])


def test_nothing(spark):
    assert got_rows(Resampler(), empty(spark), awkward(spark)) == []
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert got_rows(Resampler(), awkward(spark), empty(spark)) == by_hand(rows, [])


def test_documents_like_the_target_are_drawn(spark):
    """Texts of the target's kind, a quarter of all, are most of the quarter drawn; the noise lets others in."""
    rng = random.Random(6)
    kind = lambda ws: " ".join(rng.choice(ws) for _ in range(60))
    ours, theirs = [f"q{k}" for k in range(50)], [f"z{k}" for k in range(50)]
    rows = [(k, kind(ours if k % 4 == 0 else theirs)) for k in range(800)]
    drawn = [r[0] for r in got_rows(Resampler(buckets=1000), awkward(spark, [(k, t, None) for k, t in rows]), awkward(spark, [(0, kind(ours), None) for _ in range(40)])) if r[-1]]
    assert len(drawn) == 200 and sum(k % 4 == 0 for k in drawn) >= 0.55 * len(drawn)


def test_all_documents(spark):
    docs, target = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got_rows(Resampler(), docs, target) == by_hand(rows, [r["text"] for r in target.collect()])
