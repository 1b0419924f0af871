import random
from collections import Counter

import pytest
from frames import awkward, awkward_rows, empty

from marlstone.llm import substrings
from marlstone.llm.substrings import SubstringDedup


def expected(rows, size):
    ws = [(k, (t or "").encode().split()) for k, t, *_ in rows]
    n = Counter(tuple(w[i : i + size]) for _, w in ws for i in range(len(w) - size + 1))
    out = Counter()
    for k, w in ws:
        gone = set()
        for i in range(len(w) - size + 1):
            if n[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out[k, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    return out


def got(spark, rows, size):
    return Counter(map(tuple, SubstringDedup(size).remove(awkward(spark, rows).repartition(3)).collect()))


@pytest.mark.parametrize("size", [8, 35])
def test_awkward_rows(spark, size):
    rows = awkward_rows()
    assert got(spark, rows, size) == expected(rows, size)


@pytest.mark.parametrize(("alphabet", "seed"), [("ab", 1), ("abcdefghijklmnop", 2)])
def test_shared_and_periodic_passages(spark, alphabet, seed):
    rng = random.Random(seed)
    passage = [rng.choice(alphabet) for _ in range(50)]
    rows = []
    for k in range(80):
        own = [rng.choice(alphabet) + str(k) for _ in range(rng.randint(0, 40))]
        if k % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = passage[rng.randint(0, 20) :]
        if k % 7 == 0:
            own += ["p", "q", "r"] * rng.randint(1, 20)
        if k % 11 == 0:
            own += [rng.choice(alphabet) for _ in range(300)]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(own), None))
    assert got(spark, rows, 12) == expected(rows, 12)


def test_hot_passage_with_heavy_mers(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 8)
    rng = random.Random(4)
    passage = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([f"d{k}x{j}" for j in range(rng.randint(1, 6))] + passage + [f"e{k}"]), None) for k in range(150)]
    assert got(spark, rows, 35) == expected(rows, 35)


def test_two_windows_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "_runs", lambda h, size: np.zeros(max(0, len(h) - size + 1), dtype=np.uint64))
    found = {k: flat for _, k, flat in substrings.repeated_stretches(2, [(1, 1, 1, b"a b c"), (1, 2, 1, b"x a b"), (1, 3, 1, b"q r")])}
    assert found == {1: [0, 1], 2: [1, 2]}


def test_nothing(spark):
    assert SubstringDedup().remove(empty(spark)).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_sums_of_powers_confuse(spark):
    rest = [f"w{k}" for k in range(34)]
    rows = [(2 * n + k, " ".join([thue_morse(n, letters), *(w + str(n) for w in rest)]), None) for n in (1024, 2048, 4096) for k, letters in enumerate(("ab", "ba"))]
    found = got(spark, rows, 35)
    assert found == expected(rows, 35) and all(removed == 0 for _, _, removed, _ in found)


def test_hot_buckets_are_counted_as_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT", 100)
    test_shared_and_periodic_passages(spark, "ab", 1)
    rng = random.Random(5)
    passage = [f"w{k}" for k in range(14)]
    rows = [(k % 70, " ".join([f"d{k}x{j}" for j in range(rng.randint(1, 6))] + passage + [f"e{k}", f"f{k}"]), None) for k in range(90)]
    rows += rows[:3] + [(None, rows[4][1], None), (None, rows[5][1], None)]
    assert got(spark, rows, 12) == expected(rows, 12)
    assert got(spark, awkward_rows(), 8) == expected(awkward_rows(), 8)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    assert got(spark, rows, 35) == expected(rows, 35)


def test_repeated_rows_are_linear(spark):
    """20,000 equal rows under one id and as many under null: places are counted once each, with their number."""
    import time

    rng = random.Random(6)
    body = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    single = [(k, " ".join(f"x{k}y{j}" for j in range(60)), None) for k in range(50)]
    rows = [(1, body, None)] * 10_000 + [(None, body, None)] * 10_000 + [(2, body + " end", None)] + single
    began = time.perf_counter()
    got = SubstringDedup().remove(awkward(spark, rows).repartition(8)).groupBy("id", "n_words", "n_removed").count().collect()
    assert time.perf_counter() - began < 60  # a list of all places for every row takes hours
    want = Counter({(1, 300, 300): 10_000, (None, 300, 300): 10_000, (2, 301, 300): 1} | {(k, 60, 0): 1 for k in range(50) if k not in (1, 2)})
    want[1, 60, 0] += 1
    want[2, 60, 0] += 1
    assert Counter({tuple(r[:3]): r[3] for r in got}) == want
