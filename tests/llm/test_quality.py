import random
import re

import pytest
from frames import awkward, awkward_rows, empty, words
from shared import DATA

from marlstone.llm import quality


def expected(text):
    ws = words(text)
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            n += line in seen
            seen.add(line)
    at = {}
    for i in range(len(ws) - 4):
        at.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), n, len(covered)


def check(spark, rows):
    docs = awkward(spark, rows)
    got = sorted((tuple(r) for r in quality.counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    assert got == sorted(((k, *expected(t)) for k, t, *_ in rows), key=str)


def test_counts_on_awkward_rows(spark):
    check(spark, awkward_rows())


def test_counts_on_random_rows(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n\t#|𝒳") for _ in range(rng.randint(0, 120))) for _ in range(200)]
    check(spark, [(k, t, None) for k, t in enumerate(texts)])


def test_counts_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"]: expected(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.counts(docs).collect()}
    assert got == want


def test_scores_follow_the_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = quality.score(docs).collect()
    names = [f"vote_{k}" for k in quality.rules()]
    patterns = {}
    for r in rows:
        votes = tuple(r[c] for c in names)
        patterns[votes] = patterns.get(votes, 0) + 1
    model = quality.estimate(sorted(patterns.items()))
    for r in rows:
        p = quality.posterior(tuple(r[c] for c in names), model["good"], model["chance"])
        assert r["p_good"] == pytest.approx(p, abs=1e-9)
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["p_good"] >= 0.5)


def test_labels_agree(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs).join(labels, "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert right >= 0.97 * len(judged)


def test_em_recovers_reliabilities():
    rng = random.Random(2)
    patterns = {}
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = tuple((-1 if rng.random() < (0.01 if good else 0.4) else rng.choice((0, 1))) for _ in range(8))
        patterns[votes] = patterns.get(votes, 0) + 1
    model = quality.estimate(sorted(patterns.items()))
    assert abs(model["good"] - 0.85) < 0.03
    assert all(abs(c[0][0] - 0.4) < 0.1 and c[1][0] < 0.03 for c in model["chance"])


def test_nothing(spark):
    assert quality.score(empty(spark)).count() == 0


def test_main_path_has_no_python(spark):
    plan = quality.score(awkward(spark))._jdf.queryExecution().toString() + quality.counts(awkward(spark))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and "PythonUDF" not in plan
