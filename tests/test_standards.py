import itertools
import random
from decimal import Decimal

import pytest

from marlstone.operators import standards

CASES = [
    ("The gas pressure must be at most 5 MPa.", "gas pressure", "pressure", None, "5000000", False, False),
    ("gas pressure < 5 kPa", "gas pressure", "pressure", None, "5000", False, True),
    ("we found that the seam width is 2.5 m here", "seam width", "length", "2500", "2500", False, False),
    ("Seam width: more than 30 cm", "seam width", "length", "300", None, True, False),
    ("air temperature 20 to 26 ℃", "air temperature", "temperature", "20", "26", False, False),
    ("瓦斯压力大于或等于5MPa", "瓦斯压力", "pressure", "5000000", None, False, False),
    ("瓦斯压力大于5MPa", "瓦斯压力", "pressure", "5000000", None, True, False),
    ("检查间隔不超过2小时", "检查间隔", "time", None, "7200", False, False),
    ("oxygen at least 20%", "oxygen", "share", "20", None, False, False),
    ("check interval of 2 h", "check interval", "time", "7200", "7200", False, False),
]
NONE = ["no number here", "width 5", "width is 5 mmx", "5 mm", "", None, "range 9 to 3 mm", "version 2.0", "width 1.2.3"]


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "t", 1) for k, t in enumerate(texts)], "doc_id long, text string, term string, low int")


def test_what_texts_state(spark):
    got = {r["doc_id"]: r for r in standards.stated(rows(spark, [c[0] for c in CASES]), "doc_id").collect()}
    for k, (text, term, quantity, low, high, low_open, high_open) in enumerate(CASES):
        r = got[k]
        as_number = lambda x: None if x is None else Decimal(x)
        assert (r["quantity"], r["low"], r["high"], r["low_open"], r["high_open"]) == (quantity, as_number(low), as_number(high), low_open, high_open), text
        assert r["term"] == term and r["said"] in text, text
    assert standards.stated(rows(spark, NONE), "doc_id").collect() == []


def test_several_in_one_text(spark):
    text = "The belt speed is 3 m long? The belt width is 80 cm and belt weight is at most 2 t.\nbelt width 0.8 m"
    got = sorted((r["term"], str(r["low"]), str(r["high"])) for r in standards.stated(rows(spark, [text]), "doc_id").collect())
    assert [g[0] for g in got].count("belt width") == 2 and len({g[1:] for g in got if g[0] == "belt width"}) == 1


def within(s, r):
    """Whether all sample points of one interval lie in another."""
    def holds(x, i):
        low, high, low_open, high_open = i
        return (low is None or x > low or (x == low and not low_open)) and (high is None or x < high or (x == high and not high_open))

    points = [Decimal(k) / 4 for k in range(-40, 80)]
    bad = [x for x in points if holds(x, s) and not holds(x, r)]
    return bad


def test_conflicts_are_brute_force(spark):
    rng = random.Random(4)
    ends = [None, *map(Decimal, range(0, 6))]
    intervals = [(a, b, lo, hi) for a, b, lo, hi in itertools.product(ends, ends, (False, True), (False, True)) if (a is None or b is None or a < b or (a == b and not lo and not hi)) and (a is not None or not lo) and (b is not None or not hi)]
    some = [rng.choice(intervals) for _ in range(60)]
    shape = "id long, term string, quantity string, low decimal(38,9), high decimal(38,9), low_open boolean, high_open boolean, said string"
    frame = spark.createDataFrame([(k, "t" if k % 7 else "u", "length" if k % 5 else "mass", *i, f"s{k}") for k, i in enumerate(some)], shape)
    rules = frame.withColumnRenamed("id", "rule")
    got = {(r["id"], r["rule"]): r["side"] for r in standards.conflicts(frame, rules, "id", "rule").collect()}
    for (a, s), (b, r) in itertools.product(enumerate(some), repeat=2):
        same = (a % 7 == 0) == (b % 7 == 0) and (a % 5 == 0) == (b % 5 == 0)
        bad = within(s, r) if same else []
        assert ((a, b) in got) == bool(bad), (s, r)
    assert set(got.values()) == {"low", "high", "both"}
    assert standards.conflicts(frame.limit(0), rules, "id", "rule").count() == 0


def test_long_texts_are_linear(spark):
    import time

    for text in ("a " * 300_000, "a" * 500_000, "1 " * 300_000, "width is " * 60_000, "a-" * 200_000):
        began = time.perf_counter()
        assert standards.stated(rows(spark, [text]), "doc_id").count() == 0
        assert time.perf_counter() - began < 30


@pytest.mark.parametrize(("value", "unit", "kept"), [("2.5", "cm", "25.0"), ("0.025", "m", "25.000"), ("3", "‰", "0.3")])
def test_units(value, unit, kept):
    assert standards.kept_unit(value, unit) == Decimal(kept)


def test_parts_of_one_file_go_to_all_cores(spark):
    from shared import DATA

    from marlstone.plans import standards as plans

    assert plans._statements(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
