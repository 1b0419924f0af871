import gzip
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from frames import empty  # noqa: F401
from pyspark.sql import functions as F

from marlstone.llm import warc

T0 = datetime(2024, 3, 1, tzinfo=UTC)
SHAPE = warc.RECORD + ", payload_sha256 string, canonical_url string, answer string, bin string, `at` string"


def record(k, kind, url, minute, headers=(), status=None, payload=b"", profile=warc.NOT_MODIFIED, digest=None):
    date = None if minute is None else T0 + timedelta(minutes=minute)
    status = status if status is not None else (304 if kind == "revisit" else 200)
    return (f"r{k:03}", kind, url, date, profile if kind == "revisit" else None, status, [{"name": n, "value": v} for n, v in headers], digest, payload, "sha" + str(k), "x", "x", "x", "x")


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE).drop("payload")


def test_round_trip(spark):
    html = "<p>é\r\n\r\nx</p>".encode() * 1000
    body = warc.record_bytes("urn:1", "response", "http://a.b/ü", T0, "200 OK", [("ETag", '"1"'), ("X", "a: b")], html)
    body += warc.record_bytes("urn:2", "revisit", "http://a.b/ü", T0, "304 Not Modified", [("etag", "W/1")])
    files = spark.createDataFrame([(body,), (gzip.compress(body[:-400] + body[-400:]),), (b"",), (None,), (b"no warc",), (body[:-60],)], "content binary")
    got = warc.records(files).collect()
    assert Counter(r["record_id"] for r in got) == {"urn:1": 3, "urn:2": 2}
    one = next(r for r in got if r["record_id"] == "urn:1")
    assert bytes(one["payload"]) == html and one["status"] == 200 and one["target_uri"] == "http://a.b/ü"
    assert [(h["name"], h["value"]) for h in one["headers"]] == [("ETag", '"1"'), ("X", "a: b")] and one["date"] == T0.replace(tzinfo=None)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://WWW.Example.com:443/A/b/?b=2&a=1&utm_source=x#top", "example.com/A/b?a=1&b=2"),
        ("http://example.com", "example.com"),
        ("http://example.com:8080//", "example.com:8080"),
        ("example.com/?", "example.com"),
        ("http://www2.e.org/x?gclid=1", "e.org/x"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical(F.col("u"))).first()[0] == want


def by_hand(rows):
    """Each record's (response, resolution)."""
    out = []
    url = lambda r: None if r[2] is None else r[2].split("://")[-1].rstrip("/")
    tag = lambda r: next((h["value"].removeprefix("W/") for h in r[6] if h["name"].lower() == "etag"), None)
    for r in rows:
        if r[1] == "response" and r[5] == 200:
            out.append((r[0], r[0], "response"))
        elif r[1] == "revisit":
            before = [s for s in rows if s[1] == "response" and s[5] == 200 and r[3] and s[3] and url(s) is not None and url(s) == url(r) and s[3] < r[3]]
            if not before:
                out.append((r[0], None, "no response"))
                continue
            s = max(before, key=lambda s: (s[3], s[0]))
            how = "unchecked" if tag(r) is None else "resolved" if tag(r) == tag(s) else "validators differ"
            out.append((r[0], s[0] if how != "validators differ" else None, how))
    return Counter(out)


def test_as_of_join_is_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        url = rng.choice(["http://hot.org/a", "https://hot.org/a/", "http://b.org", "c.org/x", None])
        minute = rng.choice([None, *range(0, 4000, 7)])
        headers = [("ETag", rng.choice(['"1"', 'W/"1"', '"2"']))] if rng.random() < 0.8 else []
        rows.append(record(k, kind, url, minute, headers, status=rng.choice([200, 200, 404]) if kind == "response" else None))
    rows += rows[:5]
    got = Counter(tuple(r) for r in warc.resolve(table(spark, rows)).select("record_id", "response_id", "resolution").collect())
    want = by_hand(rows)
    # of repeated responses of one id any stands for the other
    assert got == want
    hourly = warc.resolve(table(spark, rows), stretch=3600).select("record_id", "response_id", "resolution").collect()
    assert Counter(map(tuple, hourly)) == want


def test_headers_and_payloads(spark):
    first = [("Content-Type", "text/html"), ("Date", "d1"), ("eTag", '"1"'), ("Content-Length", "9")]
    second = [("date", "d2"), ("ETag", '"1"'), ("Content-Type", "text/plain"), ("Vary", "x"), ("Content-Length", "0"), ("Expires", "e")]
    rows = [record(1, "response", "http://a/", 0, first, payload=b"full body"), record(2, "revisit", "http://a", 5, second)]
    full = spark.createDataFrame(rows, SHAPE)
    got = {r["record_id"]: r for r in warc.with_payload(warc.resolve(full), full).collect()}
    assert [(h["name"], h["value"]) for h in got["r002"]["headers"]] == [("Content-Type", "text/html"), ("Date", "d2"), ("eTag", '"1"'), ("Content-Length", "9"), ("Vary", "x"), ("Expires", "e")]
    assert bytes(got["r002"]["payload"]) == b"full body" and got["r002"]["status"] == 200 and got["r002"]["payload_sha256"] == "sha1"


def test_other_validators(spark):
    rows = [
        record(1, "response", "http://a/", 0, [("Last-Modified", "m")], digest="sha1:A"),
        record(2, "revisit", "http://a/", 1, [("Last-Modified", "m")], digest="sha1:A"),
        record(3, "revisit", "http://a/", 2, [("Last-Modified", "n")]),
        record(4, "revisit", "http://a/", 3, [("Last-Modified", "m")], digest="sha1:B"),
        record(5, "revisit", "http://a/", 4, [("ETag", "e")]),
        record(6, "revisit", "http://a/", 0, []),
    ]
    got = {r["record_id"]: r["resolution"] for r in warc.resolve(table(spark, rows)).collect()}
    assert got == {"r001": "response", "r002": "resolved", "r003": "validators differ", "r004": "validators differ", "r005": "validators differ", "r006": "no response"}


def test_nothing(spark):
    assert warc.resolve(table(spark, [])).count() == 0
    assert warc.records(spark.createDataFrame([], "content binary")).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://x/", "")], "page_id long, url string, html string")
    assert warc.records(warc.captures(pages)).count() == 4


def test_cut_and_joined_gzip_files():
    one, two = (warc.record_bytes(f"urn:{k}", "response", "http://a/", T0, "200 OK", [], b"x" * 5000) for k in (1, 2))
    joined = gzip.compress(one) + gzip.compress(two)
    ids = lambda content: [r[0] for r in warc.parse(content)]
    assert ids(joined) == ids(gzip.compress(one + two)) == ["urn:1", "urn:2"]
    assert ids(joined[:-20]) == ["urn:1"] and ids(joined[: len(gzip.compress(one)) // 2]) == []
    assert ids(joined[:-30] + b"broken") == ["urn:1"] and ids(gzip.compress(one) + b"\0" * 10 + gzip.compress(two)) == ["urn:1", "urn:2"]
    assert ids(b"\x1f\x8b") == ids(b"\x1f\x8bxxxx") == []


def test_pages_of_any_key(spark):
    pages = spark.createDataFrame([(None, "http://x/", "a"), (10**12, "http://x/", "b"), (-(10**12), "http://x/", "c"), (5, "http://x/", "d")], "page_id long, url string, html string")
    got = warc.records(warc.captures(pages)).collect()
    assert sorted((str(r["record_id"]), r["date"] is None) for r in got) == sorted([("None", True)] * 2 + [(f"urn:page:{k}:{w}", k != 5) for k in (10**12, -(10**12), 5) for w in ("response", "revisit")])
    small = spark.createDataFrame([(5, "http://x/", "d")], "page_id int, url string, html string")
    assert warc.records(warc.captures(small)).count() == 2


def test_a_hot_url_in_short_stretches(spark):
    rng = random.Random(6)
    rows = [record(k, rng.choice(["response", "revisit"]), "http://hot.org/a", rng.choice([*range(0, 90)]), [("ETag", rng.choice(['"1"', '"2"']))]) for k in range(300)]
    rows += [record(300 + k, rng.choice(["response", "revisit"]), rng.choice(["http://b.org", None]), k * 50, []) for k in range(40)]
    got = Counter(tuple(r) for r in warc.resolve(table(spark, rows), most=20).select("record_id", "response_id", "resolution").collect())
    assert got == by_hand(rows)
