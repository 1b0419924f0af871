"""Small tables with the cases every operator must bear."""

import random

SHAPE = "doc_id long, text string, source string, digest string, `row` int, who string, `copy` int, bucket long, body string, version int, id string, node string, n int"


def sentence(rng, n):
    return " ".join(rng.choice(["red", "fox", "Sea", "blue", "runs", "far", "über", "日本", "x1", "end."]) + rng.choice("abcdefgh") for _ in range(n))


def awkward_rows():
    """Nulls, empty, blank and long texts, ties, repeated rows, and copies."""
    rng = random.Random(11)
    base = sentence(rng, 120)
    texts = [None, "", " \n\t", "one", "one two", base, base, base.upper(), base + " more", sentence(rng, 9000), "a " * 500, sentence(rng, 60) + "\n" + sentence(rng, 60), " x", "é" * 3000]
    rows = [(k, t, rng.choice(["s1", "s2", None])) for k, t in enumerate(texts)]
    rows += [rows[5], (None, base, "s1"), (None, None, None), (5, "the same id, another text", "s2")]
    return rows


def awkward(spark, rows=None):
    full = [(*r, "d", 1, "w", 2, 3, "b", 4, "i", "n", 5) for r in (awkward_rows() if rows is None else rows)]
    return spark.createDataFrame(full, SHAPE)


def empty(spark):
    return spark.createDataFrame([], SHAPE)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
