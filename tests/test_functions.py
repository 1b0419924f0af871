import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import chunking, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("value", ["", " a ", "　x　", "  y\n", "\x1cz\x1f", "𝒳 ", "a\r\n"])
def test_strip_is_pythons(spark, value):
    assert one(spark, value, text.strip) == value.strip()


def test_paragraphs_drop_blank_lines_and_strip(spark):
    value = "　第一\r\n\n \t\n b  \n𝒳"
    assert one(spark, value, text.paragraphs) == [x.strip() for x in value.split("\n") if x.strip()]


@pytest.mark.parametrize(("value", "n"), [("a。b！", 3), ("", 1), ("no mark", 1)])
def test_sentence_pieces(spark, value, n):
    assert one(spark, value, text.sentence_pieces) == n == len(re.split("[。！？]", value))


@pytest.mark.parametrize(("name", "parts"), [("a.PDF", ("a", ".PDF", "pdf")), ("noext", ("noext", "", "noext")), ("x.tar.gz", ("x.tar", ".gz", "gz")), (".hidden", (".hidden", "", "hidden"))])
def test_names(spark, name, parts):
    assert (one(spark, name, text.root), one(spark, name, text.suffix), one(spark, name, text.extension)) == parts


def test_replace_first_is_literal_and_once(spark):
    rows = [("a.b a.b", "a.b", "x", "x a.b"), ("axb", "a.b", "x", "axb"), ("abc", "", "x", "abc"), ("𝒳ab", "ab", "", "𝒳")]
    df = spark.createDataFrame(rows, "c string, o string, n string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", text.replace_first(F.col("c"), F.col("o"), F.col("n"))).collect())


def test_first_of_takes_empty_as_missing(spark):
    df = spark.createDataFrame([(None, "", "c"), ("", None, None), ("a", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(text.first_of(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c", None, "a"]


def test_relative_time_edges(spark):
    at = "2024-01-02 00:00:00"
    rows = [("2024-01-01 23:59:30", "just now"), ("2024-01-01 23:59:00", "1 minutes ago"), ("2024-01-01 23:00:00", "1 hours ago"), ("2024-01-01 00:00:00", "1 days ago")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", text.relative_time(F.to_timestamp_ntz("t"), F.to_timestamp_ntz(F.lit(at))))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_unfence(spark):
    assert one(spark, '```json\n[1]\n```', text.unfence) == "[1]"
    assert one(spark, "plain", text.unfence) == "plain"


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 1800, 1801, 5000])
def test_fixed_chunks_cover_the_text(spark, n):
    value = "".join(chr(97 + k % 26) for k in range(n))
    got = one(spark, value, chunking.fixed)
    want = [value[k * 800 : k * 800 + 1000] for k in range(max(0, -(-(n - 1000) // 800)) + 1)] if n else []
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60))
def test_recursive_chunks_keep_limits_and_order(value, size):
    chunks = chunking.recursive(value, size, size // 5)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:
        at = value.find(c, at)
        assert at >= 0
    letters = "".join(value.split())
    assert not letters or set(letters) == set("".join("".join(chunks).split()))


def test_recursive_chunks_prefer_coarse_separators():
    assert chunking.recursive("a" * 8 + "\n\n" + "b" * 8, 10, 2) == ["a" * 8, "b" * 8]
    assert chunking.recursive("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert chunking.recursive(None) == [] == chunking.recursive(" \n ")


def test_embeddings_are_signed_counts_of_hashed_words():
    import hashlib
    import math
    import re

    from marlstone.models import embed_texts

    texts = ["The cat, the CAT sat", None, "", "... !", "ñandú 日本 x_1 x_1", "a" * 5000, "b " * 3000, "the cat"]
    got = embed_texts(texts, 16)
    for text, row in zip(texts, got.tolist(), strict=True):
        want = [0.0] * 16
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[h % 16] += 1.0 if h >= 2**31 else -1.0
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert row == [x / norm for x in want], text
    assert embed_texts([], 16).shape == (0, 16)


def chunks_by_definition(text, size, overlap, separators):
    """Chunks of a text from where they begin and end among its pieces, by sums of lengths."""
    import re

    if not text:
        return []
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    cuts = [0, *(m.start() for m in re.finditer(re.escape(sep), text)), len(text)] if sep else list(range(len(text) + 1))
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    out, run = [], []

    def flush():
        total = lambda a, b: sum(map(len, run[a:b]))
        start = 0
        while start < len(run):
            end = next((k for k in range(start + 1, len(run)) if total(start, k + 1) > size), len(run))
            out.append("".join(run[start:end]))
            if end == len(run):
                break
            start = next(s for s in range(start, end + 1) if total(s, end) <= overlap and total(s, end + 1) <= size or s == end)
        run.clear()

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            flush()
            out.extend(chunks_by_definition(piece, size, overlap, finer) if finer else [piece])
    flush()
    return [c.strip() for c in out if c.strip()]


def test_recursive_chunks_are_as_defined():
    import random

    from marlstone.functions.chunking import SEPARATORS, recursive

    rng = random.Random(7)
    parts = ["word", "a", "日本語", " ", " ", "\n", "\n\n", "x" * 30, "\n\n\n", "end."]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        size = rng.randint(3, 40)
        overlap = rng.randint(0, size - 1)
        got = recursive(text, size, overlap)
        assert got == chunks_by_definition(text, size, overlap, SEPARATORS), (text, size, overlap)
        assert all(len(c) <= size for c in got)
        # nothing but white space is lost, and chunks come in order
        assert set("".join(got)) >= set(text) - {" ", "\n"}
    assert recursive(None) == recursive("") == recursive(" \n\n ") == []


def test_decimals_are_rounded_as_printf_does(spark, duck):
    values = [k / 8 for k in range(-20, 20)] + [k / 20 for k in range(50)] + [1.005, 2.675, 0.045, 1e-20, -0.001, 0.995, 9.995, 99.5, 123456.125, 2.0**52 + 0.5, 2.0**53, 0.0005, 1.0005]
    for digits in (0, 1, 2, 3):
        got = spark.createDataFrame([(v,) for v in values], "c double").select(text.fixed(F.col("c"), digits).alias("r")).collect()
        assert [r["r"] for r in got] == [f"{v:.{digits}f}" for v in values]
    assert duck.execute("SELECT printf('%.2f MB', 131072 / 1048576.0)").fetchall()[0][0] == one(spark, 131072, text.megabytes, "bigint") == "0.12 MB"
    assert one(spark, None, text.megabytes, "bigint") is None
