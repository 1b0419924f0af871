import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dependencies
from marlstone.operators.replies import Replies


def counting(folder, fails=None):
    """A client that notes every call in a folder and fails on prompts that hold a word; pickled by value."""

    class Counting:
        def complete(self, prompt):
            with open(f"{folder}/{os.getpid()}", "a") as f:
                f.write(f"{prompt}\n")
            if fails and fails in prompt:
                raise ValueError("no answer")
            return prompt.upper()

    return Counting


def calls(folder):
    return sorted(line.strip() for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


def prompts(spark, some):
    return spark.createDataFrame([(k, p, "x", "y") for k, p in enumerate(some)], "id int, prompt string, reply string, address string").drop("reply", "address")


def test_a_rerun_asks_only_what_is_missing(spark, tmp_path):
    noted, other = tmp_path / "a", tmp_path / "b"
    noted.mkdir(), other.mkdir()
    rows = prompts(spark, ["one", "two", "bad one", "two", None, "", "bad two"])
    kept = Replies(spark, str(tmp_path / "kept"), slots=2, batch=2)
    first, second = str(noted), str(other)
    with pytest.raises(RuntimeError, match="2 of the calls failed, ValueError: no answer"):
        kept.complete(rows, "prompt", client=counting(first, "bad"))
    assert calls(noted) == ["", "bad one", "bad two", "one", "two"]
    got = kept.complete(rows, "prompt", client=counting(second))
    assert calls(other) == ["bad one", "bad two"]
    assert sorted((r["id"], r["reply"]) for r in got.collect()) == [(0, "ONE"), (1, "TWO"), (2, "BAD ONE"), (3, "TWO"), (4, None), (5, ""), (6, "BAD TWO")]
    assert sorted(calls(other)) == ["bad one", "bad two"]  # reading the result asks nothing


def test_errors_as_replies_are_not_kept(spark, tmp_path):
    noted = tmp_path / "a"
    noted.mkdir()
    where = str(noted)
    kept = Replies(spark, str(tmp_path / "kept"))
    rows = prompts(spark, ["fine", "bad"])
    got = kept.complete(rows, "prompt", "told", counting(where, "bad"), say_errors=True)
    assert sorted((r["id"], r["told"]) for r in got.collect()) == [(0, "FINE"), (1, "Error: ValueError: no answer")]
    assert [r["reply"] for r in kept.known().collect()] == ["FINE"]
    # another model's replies are its own
    other = Replies(spark, str(tmp_path / "kept"), model="other").complete(rows.where("id = 0"), "prompt", client=counting(where))
    assert other.first()["reply"] == "FINE" and calls(noted) == ["bad", "fine", "fine"]
    assert kept.complete(rows.limit(0), "prompt").count() == 0


def test_calls_go_through_the_slots(spark, tmp_path):
    noted = tmp_path / "a"
    noted.mkdir()
    where = str(noted)
    kept = Replies(spark, str(tmp_path / "kept"), slots=2)
    rows = prompts(spark, [f"p{k}" for k in range(60)]).repartition(16)
    got = kept.complete(rows, "prompt", client=counting(where))
    assert sorted(r["reply"] for r in got.collect()) == sorted(f"P{k}" for k in range(60))
    assert len(os.listdir(noted)) <= 2 and len(calls(noted)) == 60


def brute_edges(paras, most=3, least=4, strong=2):
    import re

    at = defaultdict(set)
    for k, i, content in paras:
        for t in re.findall(r"[^\W_]+", (content or "").lower()):
            if len(t) >= least:
                at[k, t].add(i)
    shared = defaultdict(set)
    for (k, t), own in at.items():
        if 1 < len(own) <= most:
            for a in own:
                for b in own:
                    if a < b:
                        shared[k, a, b].add(t)
    return sorted((k, a, b, "strong" if len(ts) >= strong else "weak", ", ".join(sorted(ts))) for (k, a, b), ts in shared.items())


def brute_reach(edges, changed, hops):
    near = defaultdict(set)
    for k, a, b, *_ in edges:
        near[k, a].add((k, b))
        near[k, b].add((k, a))
    seen = {c: 0 for c in changed}
    for hop in range(1, hops + 1):
        for node in [n for n, h in seen.items() if h == hop - 1]:
            for other in near[node]:
                seen.setdefault(other, hop)
    return sorted((*n, h) for n, h in seen.items())


@pytest.mark.parametrize("hops", [0, 1, 4])
def test_dependencies_and_their_reach(spark, hops):
    rng = random.Random(2)
    paras = [(k, i, " ".join(f"term{rng.randint(0, 25)}" for _ in range(rng.randint(0, 4)))) for k in range(12) for i in range(10)]
    paras += [(50, 0, None), (50, 1, ""), (51, 0, "alpha alpha ALPHA beta"), (51, 1, "Alpha, beta!"), (52, 0, "abc abc"), (52, 1, "abc")]
    frame = spark.createDataFrame([(*p, "x") for p in paras], "doc_id long, paragraph_index int, content string, term string")
    edges = dependencies.edges(frame)
    want = brute_edges(paras)
    assert sorted(map(tuple, edges.collect())) == want and {e[3] for e in want} == {"strong", "weak"}
    changed = [(k, 0) for k in range(0, 12, 2)] + [(51, 1), (99, 5)]
    start = spark.createDataFrame([*changed, changed[0], (3, None)], "doc_id long, paragraph_index int")
    assert sorted(map(tuple, dependencies.reached(edges, start, hops=hops).collect())) == brute_reach(want, changed, hops)
    firm = [e for e in want if e[3] == "strong"]
    assert sorted(map(tuple, dependencies.reached(edges, start, hops=hops, only="strong").collect())) == brute_reach(firm, changed, hops)
    assert dependencies.reached(edges.limit(0), start.limit(0)).count() == 0
    assert edges.where(F.col("source") >= F.col("target")).count() == 0


def test_dependencies_of_changed_documents_alone(spark, monkeypatch):
    from shared import DATA

    from marlstone.plans import impact

    seen = []
    real = dependencies.edges
    monkeypatch.setattr(dependencies, "edges", lambda paras: seen.append({r[0] for r in paras.select("doc_id").distinct().collect()}) or real(paras))
    got = impact.change_impact(spark, DATA)
    changed = {r["doc_id"] for r in got.where("hops = 0").collect()}
    assert changed and seen == [changed] and {r["doc_id"] for r in got.collect()} == changed
