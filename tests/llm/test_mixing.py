import random
from collections import Counter
from fractions import Fraction

from frames import awkward, awkward_rows, empty, words

from marlstone.llm.mixing import Mixer, targets


def by_hand(sizes):
    """Water filling in exact numbers, one cap at a time."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [(5, 2, 1)[k % 3] for k in range(len(ranked))]
    capped = set()
    while True:
        left = Fraction(3, 2) * sum(n for _, n in ranked) - sum(2 * ranked[k][1] for k in capped)
        open_ = [k for k in range(len(ranked)) if k not in capped]
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > 2 * ranked[k][1]]
        if not over:
            return [float(share.get(k, 2 * n)) for k, (_, n) in enumerate(ranked)]
        capped.add(over[0])


def test_targets():
    rng = random.Random(9)
    for _ in range(300):
        sizes = [(rng.choice([f"s{k}", None]) if k == 0 else f"s{k}", rng.choice([0, 1, 10, 1000, 10**6])) for k in range(rng.randint(1, 9))]
        got = targets(sizes)
        want = by_hand(sizes)
        assert all(abs(g[2] - w) <= 1e-6 * max(1, w) for g, w in zip(got, want, strict=True))
        assert all(t <= 2 * n + 1e-6 for _, n, t in got)
    assert [s for s, *_ in targets([("é", 1), ("z", 1), (None, 1), ("Z", 1)])] == ["Z", "z", "é", None]


def test_mix_of_many(spark):
    rng = random.Random(10)
    rows = [(k, "w " * int(rng.lognormvariate(4, 1.2)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for k in range(6000)]
    docs = awkward(spark, rows)
    got = Mixer().mix(docs).collect()
    assert len(got) == 6000
    size = {k: len(words(t)) for k, t, _ in rows}
    source = {k: s for k, _, s in rows}
    totals, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == size[r["id"]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        totals[source[r["id"]]] += r["size"]
        taken[source[r["id"]]] += r["taken"]
        target[source[r["id"]]] = r["target"]
    want = {s: t for s, _, t in targets(list(totals.items()))}
    assert all(abs(target[s] - want[s]) < 1e-3 for s in want)
    assert all(abs(taken[s] - want[s]) <= 0.0005 * want[s] + 2 for s in want)
    again = Mixer().mix(docs.repartition(7)).collect()
    assert sorted((r["id"], r["taken"]) for r in again) == sorted((r["id"], r["taken"]) for r in got)


def test_rates_are_tilted_by_size(spark):
    rows = [(k, "w " * (10 + k % 300), "a") for k in range(900)] + [(1000 + k, "w " * 400, "b") for k in range(900)]
    got = Mixer(weights=(1, 3)).mix(awkward(spark, rows)).collect()
    a = sorted((r["size"], r["rate"]) for r in got if r["id"] < 1000)
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(a, a[1:], strict=False))  # its target is above its size: long ones are taken oftener
    assert 1 <= a[0][1] < a[-1][1] <= 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = Mixer().mix(docs)
    assert sorted(((r["id"], r["size"]) for r in got.collect()), key=str) == sorted(((k, len(words(t))) for k, t, _ in awkward_rows()), key=str)
    copies = Mixer().copies(docs)
    assert copies.columns == docs.columns
    total = got.agg({"copies": "sum"}).first()[0]
    assert copies.count() == total


def test_nothing(spark):
    assert Mixer().mix(empty(spark)).count() == 0 == Mixer().copies(empty(spark)).count()
    blank = awkward(spark, [(1, None, None), (2, "", "a")])
    assert {r["taken"] for r in Mixer().mix(blank).collect()} == {0}


def test_rates_solve_the_dual(spark):
    """Against a plain bisection of each source's tilt."""
    import math

    rng = random.Random(12)
    rows = [(k, "w " * int(rng.lognormvariate(4, 1)), rng.choice("abcd")) for k in range(2500)]
    got = Mixer().mix(awkward(spark, rows)).collect()
    source = {k: s for k, _, s in rows}
    for s in "abcd":
        own = [r for r in got if source[r["id"]] == s]
        target, mean = own[0]["target"], sum(r["size"] for r in own) / len(own)
        if target >= 2 * own[0]["source_size"] - 1e-6:
            assert all(r["rate"] == 2 for r in own)
            continue
        rate = lambda r, x: 2 / (1 + math.exp(-max(-500, min(500, x * r["size"] / mean))))
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(r["size"] * rate(r, mid) for r in own) < target else (low, mid)
        assert all(abs(rate(r, low) - r["rate"]) < 1e-4 for r in own)
