import random
import zlib
from collections import Counter

import numpy as np
import pytest
from frames import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from marlstone.llm.language import BITS, UNKNOWN, LanguageId, machine, profile, shares, slope

SYLLABLES = {
    "en": ["the", "and", "ing", "sh", "wh", "ou", "ea", "th"],
    "de": ["der", "und", "ung", "sch", "pf", "ei", "ie", "ch"],
    "fr": ["les", "eau", "que", "oi", "ç", "é", "ment", "aux"],
    "es": ["los", "que", "ción", "ñ", "rr", "ll", "ado", "os"],
    "xx": ["zug", "kw", "qx", "uu", "jj", "vak"],
}


def text_of(rng, lang, n=60, noise=0.1):
    other = [s for k in SYLLABLES.values() for s in k]
    word = lambda: "".join(rng.choice(SYLLABLES[lang] if rng.random() > noise else other) for _ in range(rng.randint(1, 3)))
    return " ".join(word() for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, family string, score string, id string")


def labelled(rows, seed=1, **more):
    rng = random.Random(seed)
    langs = sorted(SYLLABLES)
    return [(k, text_of(rng, langs[k // 5 % 5], **more), langs[k // 5 % 5], "a", "b", "c") for k in range(rows)]


def plain_profile(text, bits=BITS):
    """n-grams one by one, in Python's own numbers."""
    body = "".join(c.lower() if len(c.lower()) == 1 else c for c in (c if c.isalpha() else " " for c in text))
    body = " " + " ".join(body.split(" ")) + " "
    while "  " in body:
        body = body.replace("  ", " ")
    out = Counter()
    for n in range(1, 5):
        for i in range(len(body) - n + 1):
            h = 0
            for c in body[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            out[((h ^ (h >> 29)) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - bits)] += 1
    return out


@pytest.mark.parametrize("size", [5, 8, 1 << 20])
def test_profiles(monkeypatch, size):
    monkeypatch.setattr("marlstone.llm.language.SLICE", size)
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "1", "-", "é", "ß", "İ", "日", "𝒳", "𐐀", "👍", "́", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        got = profile(text)
        if got is None:
            assert not any(c.isalpha() for c in text)
        else:
            assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == plain_profile(text), repr(text)


def test_families_then_languages(spark):
    docs = frame(spark, labelled(600))
    usable = F.col("doc_id") % 5 != 0
    model = LanguageId().fit(docs, usable)
    assert model.fitted.families == ["germanic", "romance", "xx"]
    assert sorted(model.fitted.machines) == [("de", "en"), ("es", "fr")]
    got = {r["id"]: r for r in model.predict(docs).collect()}
    want = {r[0]: r[2] for r in labelled(600)}
    held = [k for k in want if k % 5 == 0]
    assert sum(got[k]["lang_pred"] == want[k] for k in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {(r["lang_pred"], r["family"]) for r in got.values()} == {("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance"), ("xx", "xx")}


def test_scores_follow_accuracy(spark):
    """Short noisy texts are less sure, and the mean score is near the share of right answers."""
    docs = frame(spark, labelled(1500, 3, n=2, noise=0.5))
    model = LanguageId().fit(docs, F.col("doc_id") % 3 != 0)
    got = {r["id"]: r for r in model.predict(docs.where("doc_id % 3 = 0")).collect()}
    want = {r[0]: r[2] for r in labelled(1500, 3, n=2, noise=0.5)}
    right = np.mean([got[k]["lang_pred"] == want[k] for k in got])
    assert 0.4 < right < 0.999
    assert abs(np.mean([r["score"] for r in got.values()]) - right) < 0.15


def test_only_usable_rows_are_learned_from(spark):
    """Labels of other rows, and texts without a label, change nothing."""
    rows = labelled(300)
    usable = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True))
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    other = [(k, t, "en" if k in held else lang, *r) for k, t, lang, *r in rows] + [(9999, "zug zug", None, "", "", "")]
    a, b = (sorted(tuple(r) for r in LanguageId().fit(d, usable).predict(frame(spark, rows)).collect()) for d in (frame(spark, rows), frame(spark, other)))
    assert a == b


def test_sample_is_bounded_and_of_distinct_texts(spark):
    rows = labelled(400) + [(1000 + k, labelled(1)[0][1], "de", "", "", "") for k in range(2000)]
    model = LanguageId(examples=30)
    docs = frame(spark, rows)
    sample = model._sample(docs.selectExpr("lang AS name", "text AS body"), sorted(SYLLABLES)).collect()
    n = Counter(r["name"] for r in sample)
    assert set(n) == set(SYLLABLES) and max(n.values()) <= 30 and min(n.values()) >= 20
    assert len({(r["name"], r["h"]) for r in sample}) == len(sample)


def test_awkward_rows(spark):
    rows = [(r[0], r[1], [None, "en", "fr"][k % 3], "x", "y", "z") for k, r in enumerate(awkward_rows())]
    docs = frame(spark, rows)
    got = sorted((r["id"], r["lang_pred"], r["score"]) for r in LanguageId().fit(docs).predict(docs.where("doc_id IS NOT NULL")).collect())
    assert [r[0] for r in got] == sorted(r[0] for r in rows if r[0] is not None)
    blank = {r[0] for r in rows if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    assert blank and all((p == UNKNOWN and s == 0) == (k in blank) for k, p, s in got)
    assert all(p in ("en", "fr", UNKNOWN) for _, p, _ in got)


def test_nothing_is_labelled(spark):
    got = LanguageId().fit(empty(spark).selectExpr("text", "who AS lang")).predict(awkward(spark)).collect()
    assert len(got) == len(awkward_rows()) and {(r["lang_pred"], r["family"], r["score"]) for r in got} == {(UNKNOWN, None, 0.0)}
    docs = frame(spark, [(1, "hello there", "en", "", "", ""), (2, "12 34", "de", "", "", "")])
    assert [r["lang_pred"] for r in LanguageId().fit(docs).predict(docs).orderBy("id").collect()] == ["en", UNKNOWN]
    assert LanguageId().fit(docs).predict(frame(spark, [])).count() == 0


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(80, 50))).astype(np.float32)
    x[:40, :10] += 2
    y = np.repeat([1, -1], 40).astype(np.float32)
    x = np.stack([shares(r) for r in x])
    w = machine(x, y)
    assert ((x @ w > 0) == (y > 0)).all() and slope(x @ w, y) > 1


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = LanguageId().fit(docs, usable)
    held = docs.where(~usable)
    got = model.predict(held).join(held.selectExpr("doc_id AS id", "lang", "length(text) AS n"), "id").toPandas()
    right = got["lang_pred"] == got["lang"]
    assert right.mean() >= 0.97 and right[got["n"] >= 200].mean() >= 0.99
    assert right.groupby(got["lang"]).mean().min() >= 0.95
