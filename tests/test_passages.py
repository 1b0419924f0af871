import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import passages, review
from marlstone.operators.passages import classes_of, near_classes

DOCS = "doc_id long, text string, body string, item_id int, class_id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "b", 1, 2) for k, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "item_id long, text string, doc_id string")


def held(rows, items):
    return sorted({(str(k), str(i)) for k, t in rows for i, p in items if t is not None and p and p.split() and p in t})


AWKWARD = [(1, "the cat sat"), (2, None), (3, ""), (4, "thecat"), (4, "a cat"), (None, "the cat"), (5, "日本語 text"), (6, "x" * 5000 + " cat " + "y" * 5000)]
ITEMS = [(1, "cat"), (2, "the cat"), (3, None), (4, ""), (5, " "), (6, "cat"), (7, "本"), (8, "e c"), (9, "nowhere to be found"), (10, "the cat sat on the mat"), (11, "t")]


def found(frame):
    return sorted((str(r["doc_id"]), str(r["item_id"])) for r in frame.collect())


@pytest.mark.parametrize("part", [1 << 20, 12])
def test_contained_by_automata(spark, monkeypatch, part):
    """One automaton, and many of a few characters each."""
    monkeypatch.setattr(passages, "PART", part)
    monkeypatch.setattr(review, "PASSES", 100)
    got = found(review.contained(docs_of(spark, AWKWARD), items_of(spark, ITEMS)))
    assert got == held(AWKWARD, ITEMS)
    assert found(review.contained(docs_of(spark, []), items_of(spark, ITEMS))) == [] == found(review.contained(docs_of(spark, AWKWARD), items_of(spark, [])))


def test_too_many_passages_are_joined(spark, monkeypatch):
    monkeypatch.setattr(passages, "PART", 4)
    monkeypatch.setattr(review, "PASSES", 2)
    rows = [r for r in AWKWARD if r[0] is not None]
    assert found(review.contained(docs_of(spark, rows), items_of(spark, ITEMS))) == held(rows, ITEMS)


def test_ten_thousand_words_in_one_pass(spark):
    rng = random.Random(1)
    items = [(k, f"word{k}") for k in range(10_000)]
    rows = [(k, " ".join(f"word{rng.randint(0, 20_000)}" for _ in range(200))) for k in range(300)]
    docs = docs_of(spark, rows)
    pairs = review.contained(docs, items_of(spark, items))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert found(pairs) == held(rows, items)


def jaccard_classes(paragraphs, size, percent):
    """All pairs, and the least index that can be reached."""
    def runs(p):
        ws = p.split()
        return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}

    sets, parent = [runs(p) for p in paragraphs], list(range(len(paragraphs)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(sets))]


@pytest.mark.parametrize(("size", "percent"), [(1, 50), (1, 80), (2, 60), (5, 80)])
def test_classes_are_brute_force(size, percent):
    rng = random.Random(size * percent)
    for _ in range(150):
        base = [[f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 25))] for _ in range(4)]
        lines = []
        for _ in range(rng.randint(0, 25)):
            own = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 12)}"
            lines.append(" ".join(own[: rng.randint(1, 25)]))
        assert classes_of(lines, size, percent) == jaccard_classes(lines, size, percent)


def test_like_lines_are_linear():
    """10,000 lines that are all like each other, and 10,000 that share half of their words but are unlike."""
    body = [f"w{k}" for k in range(60)]
    like = [" ".join(body + [f"x{k}"]) for k in range(10_000)]
    began = time.perf_counter()
    assert set(classes_of(like, 5, 80)) == {0}
    assert time.perf_counter() - began < 20
    rng = random.Random(3)
    half = [" ".join(body[:30] + [f"y{rng.randint(0, 10**6)}" for _ in range(30)]) for _ in range(2_000)]
    began = time.perf_counter()
    assert len(set(classes_of(half, 5, 80))) == 2_000
    assert time.perf_counter() - began < 20


def test_near_classes_of_awkward_rows(spark):
    text = "one two three four five six seven\n\n  \nsomething else here\none two three four five six seven\n"
    rows = [(1, text), (2, None), (3, ""), (None, "a\na"), (1, "a\nb\na"), (4, "　\n\x85 x \n")]
    got = Counter(tuple(r) for r in near_classes(docs_of(spark, rows)).collect())
    want = Counter([(1, 0, 0, 2), (1, 1, 1, 1), (1, 2, 0, 2), (None, 0, 0, 2), (None, 1, 0, 2), (1, 0, 0, 2), (1, 1, 1, 1), (1, 2, 0, 2), (4, 0, 0, 1)])
    assert got == want
    assert near_classes(docs_of(spark, [])).count() == 0


def test_final_report_takes_all_known_misspellings(spark):
    docs = docs_of(spark, [(1, "I recieve the adress untill tommorow, adress again"), (2, None), (3, "fine")])
    changes = spark.createDataFrame([], "doc_id long, type string, original string, paragraph_index int")
    began = time.perf_counter()
    report = review.final_report(docs, changes, review.TYPOS)
    report._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 3  # a nest of eight took minutes
    want = {1: "I recieve the adress untill tommorow, adress again", 2: None, 3: "fine"}
    for old, new in review.TYPOS.items():
        want = {k: v and v.replace(old, new, 1) for k, v in want.items()}
    assert {r["doc_id"]: r["revised_content"] for r in report.collect()} == want
    assert review.final_report(docs, changes, {}).where(F.col("revised_content") == "fine").count() == 1


def test_near_paragraphs_travel_once(spark):
    from marlstone.operators import review

    rng = random.Random(11)
    rows = [(d, k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for d in (1, 2, None) for k in range(60)] + [(3, 0, "lone a b c d e"), (2, 99, None)]
    paras = spark.createDataFrame(rows, "doc_id long, paragraph_index int, content string")
    found = review.near_pairs(paras, size=2, percent=60)
    want = set()
    for d in (1, 2):
        first = {}
        for e, k, t in rows:
            if e == d and t is not None:
                first[t] = min(k, first.get(t, k))
        sets = {k: {tuple(t.split()[x : x + 2]) for x in range(max(1, len(t.split()) - 1))} for t, k in first.items() if t.split()}
        want |= {(d, i, j, round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])}
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
