"""WARC records, and the resolution of not-modified revisits.

A revisit whose server answered "not modified" holds no payload. It stands for
the latest earlier full response of its canonical URL, provided that their
validators agree (entity tags by weak comparison; else times of last change; and
payload digests where both records have one). The resolved record has the
response's status and payload, and its headers with those that a 304 may
replace taken from the revisit.

The as-of join is by URL and stretch of time: each stretch's last response is
found by an aggregation and carried on to later stretches as one row each, so
that a URL captured very often is split over its stretches. Payloads take no
part; they are joined by the response's id where wanted. A stretch is a day, or
of a URL with very many captures so much less that a stretch holds about
``FULL`` of them.

Records without a URL or a date are never resolved nor resolved to. Of responses
of one date the greatest id counts; a response of the revisit's own date is not
earlier. Repeated rows give a result each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import written

#: The profile of such revisits, and the headers that a 304 response may bring up to date.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that only track.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|mc_[ce]id)(=|$)"

RECORD = (
    "record_id string, warc_type string, target_uri string, date timestamp, profile string, status int, "
    "headers array<struct<name:string,value:string>>, payload_digest string, payload binary"
)
#: Seconds of a stretch, and captures of a URL beyond which its stretches are shorter.
STRETCH, FULL = 86_400, 20_000


def record_bytes(record_id: str | None, warc_type: str, uri: str, date: datetime | None, status: str, headers: list[tuple[str, str]], payload: bytes = b"") -> bytes:
    """One record of WARC/1.1; without a field where its value is None."""
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers) + "\r\n"
    block = http.encode() + payload
    named = [("WARC-Record-ID", record_id and f"<{record_id}>"), ("WARC-Date", date and date.strftime("%Y-%m-%dT%H:%M:%SZ"))]
    fields = [("WARC-Type", warc_type), *((n, v) for n, v in named if v), ("WARC-Target-URI", uri)]
    if warc_type == "revisit":
        fields.append(("WARC-Profile", NOT_MODIFIED))
    else:
        fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:  # a folded line goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _date(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC) if text else None
    except ValueError:
        return None


def _unzipped(content: bytes) -> bytes:
    """All members of a gzip file. Of one that is cut off, what there is of it; one that is broken and what follows it are left out."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data.lstrip(b"\0") if member.eof else b""
    return b"".join(out)


def parse(content: bytes) -> Iterator[tuple]:
    """The records of a WARC file, gzipped or plain, as tuples in the order of RECORD. A cut-off last record is left out."""
    if content[:2] == b"\x1f\x8b":
        content = _unzipped(content)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            return
        warc = {n.lower(): v for n, v in _fields(content[at:head].split(b"\r\n")[1:])}
        length = int(warc["content-length"]) if warc.get("content-length", "").isdigit() else 0
        block = content[head + 4 : head + 4 + length]
        if len(block) < length:
            return
        at = head + 4 + length
        status, headers, payload = None, [], block
        if block.startswith(b"HTTP/"):
            top, _, payload = block.partition(b"\r\n\r\n")
            lines = top.split(b"\r\n")
            code = re.match(rb"HTTP/\S+ (\d{3})", lines[0])
            status, headers = (int(code[1]) if code else None), _fields(lines[1:])
        bare = lambda s: s.strip("<>") if s else None
        yield bare(warc.get("warc-record-id")), warc.get("warc-type"), bare(warc.get("warc-target-uri")), _date(warc.get("warc-date")), warc.get("warc-profile"), status, headers, warc.get("warc-payload-digest"), payload


def records(files: DataFrame, content: str = "content") -> DataFrame:
    """All records of WARC files (binary). A file is held in memory whole; its records leave in batches."""
    header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    shape = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("date", pa.timestamp("us", tz="UTC")), ("profile", pa.string()), ("status", pa.int32()), ("headers", header), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for body in batch.column(0):
                for r in parse(body.as_py() or b""):
                    rows.append((*r[:6], [{"name": n, "value": v} for n, v in r[6]], *r[7:]))
                    size += len(r[8])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return files.select(content).mapInArrow(run, RECORD)


def canonical(url: Column) -> Column:
    """Host (in lower case, without www and default ports), path without a slash at its end, and parameters in order without those that track; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, with those a 304 may replace taken from it: in the stored one's place, or at the end."""
    name = lambda h: F.lower(h["name"])
    usable = F.filter(fresh, lambda h: name(h).isin(*PERMITTED))
    value = lambda h: F.get(F.filter(usable, lambda u: name(u) == name(h)), 0)["value"]
    kept = F.transform(stored, lambda h: F.struct(h["name"].alias("name"), F.coalesce(value(h), h["value"]).alias("value")))
    new = F.filter(usable, lambda u: ~F.exists(stored, lambda h: name(h) == name(u)))
    return F.concat(kept, new)


def _differ(a: Column, b: Column) -> Column:
    """True where a says something and b doesn't say the same."""
    return a.isNotNull() & ~a.eqNullSafe(b)


def resolve(rows: DataFrame, stretch: int = STRETCH, most: int = FULL) -> DataFrame:
    """rows: the columns of RECORD but payload, and any others. Every response of status 200, and every not-modified revisit with its response.

    Responses of any other status, other revisits and other records are left out,
    and a revisit is never resolved to them.


    record_id, warc_type, canonical_url, date, response_id, resolution, status,
    headers, payload_sha256. resolution: response, resolved, unchecked (the
    revisit has no validator), validators differ, or no response.
    """
    plain = rows.select("record_id", "warc_type", canonical(F.col("target_uri")).alias("canonical_url"), "date", "profile", "status", F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"), "payload_digest", "payload_sha256")
    plain = plain.withColumn("at", F.unix_micros("date"))
    plain = written(plain)  # read several times below
    hot = plain.where("canonical_url IS NOT NULL AND at IS NOT NULL").groupBy("canonical_url").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("n") > most)
    hot = written(hot.select("canonical_url", "low", F.greatest(F.lit(1), F.least(F.lit(stretch * 1_000_000), F.expr(f"(high - low) * {most} div n"))).alias("width")))
    if hot.isEmpty():
        plain = plain.withColumn("bin", F.floor(F.col("at") / (stretch * 1_000_000)))
    else:
        plain = plain.join(hot, "canonical_url", "left")
        plain = plain.withColumn("bin", F.floor((F.col("at") - F.coalesce("low", F.lit(0))) / F.coalesce("width", F.lit(stretch * 1_000_000)))).drop("low", "width")
    is_revisit = (F.col("warc_type") == "revisit") & F.coalesce(F.col("profile").contains("not-modified") | (F.col("status") == 304), F.lit(False))
    full = plain.where((F.col("warc_type") == "response") & (F.col("status") == 200))
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    answer = F.struct("at", "record_id", "status", "headers", "payload_digest", "payload_sha256")

    last = full.where(known).groupBy("canonical_url", "bin").agg(F.max(answer).alias("answer"))
    asked = plain.where(is_revisit & known)
    bins = last.unionByName(asked.select("canonical_url", "bin").distinct(), allowMissingColumns=True)
    before = Window.partitionBy("canonical_url").orderBy("bin").rangeBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("answer", F.max("answer").over(before)).where("answer IS NOT NULL").distinct()
    events = asked.select("*", F.lit(None).cast(last.schema["answer"].dataType).alias("answer"))
    stored = full.where(known).select("canonical_url", "bin", "at", answer.alias("answer"))
    stored = stored.unionByName(carried.select("canonical_url", "bin", F.col("answer.at").alias("at"), "answer"))
    earlier = Window.partitionBy("canonical_url", "bin").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    met = events.unionByName(stored, allowMissingColumns=True).withColumn("answer", F.max("answer").over(earlier)).where("warc_type IS NOT NULL")
    met = met.unionByName(plain.where(is_revisit & ~known), allowMissingColumns=True)

    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    own, other = tag(F.col("headers")), tag(F.col("answer.headers"))
    changed = header(F.col("headers"), "last-modified")
    wrong = F.when(own.isNotNull(), _differ(own, other)).otherwise(_differ(changed, header(F.col("answer.headers"), "last-modified")))
    wrong = wrong | (F.col("payload_digest").isNotNull() & F.coalesce(F.col("answer.payload_digest") != F.col("payload_digest"), F.lit(False)))
    none = own.isNull() & changed.isNull() & F.col("payload_digest").isNull()
    how = F.when(F.col("answer").isNull(), "no response").when(wrong, "validators differ").when(none, "unchecked").otherwise("resolved")
    met = met.withColumn("resolution", how)
    good = F.col("resolution").isin("resolved", "unchecked")
    pick = lambda yes, no: F.when(good, yes).otherwise(no)
    revisits = met.select("record_id", "warc_type", "canonical_url", "date", pick(F.col("answer.record_id"), F.lit(None)).alias("response_id"), "resolution", pick(F.col("answer.status"), F.col("status")).alias("status"), pick(merged(F.col("answer.headers"), F.col("headers")), F.col("headers")).alias("headers"), pick(F.col("answer.payload_sha256"), F.lit(None)).alias("payload_sha256"))
    responses = full.select("record_id", "warc_type", "canonical_url", "date", F.col("record_id").alias("response_id"), F.lit("response").alias("resolution"), "status", "headers", "payload_sha256")
    return responses.unionByName(revisits)


def with_payload(resolved: DataFrame, rows: DataFrame) -> DataFrame:
    """Resolved records with their response's payload."""
    return resolved.join(rows.select(F.col("record_id").alias("response_id"), "payload").dropDuplicates(["response_id"]), "response_id", "left")


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", again_after: int = 7 * 1440) -> DataFrame:
    """Small WARC files (content) of pages: each captured at the minute its key says, and found not modified again_after minutes later.

    A page whose key is null has records without id and date, one whose minute the calendar doesn't reach (years 1 to 9999) without a date.
    """

    def run(batches):
        start = datetime(2024, 1, 1, tzinfo=UTC)

        def moment(k, after):
            try:
                return None if k is None else start + timedelta(minutes=k + after)
            except OverflowError:
                return None

        http = "%a, %d %b %Y %H:%M:%S GMT"
        for batch in batches:
            out = []
            for k, u, h in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                body = (h or "").encode()
                tag = f'"{hashlib.md5(body).hexdigest()}"'
                at, later = (moment(k, d) for d in (0, again_after))
                dated = lambda name, t: [] if t is None else [(name, t.strftime(http))]
                first = [*dated("Date", at), ("Content-Type", "text/html; charset=utf-8"), ("ETag", tag), *dated("Last-Modified", at), ("Cache-Control", "max-age=60"), ("Content-Length", str(len(body)))]
                second = [*dated("Date", later), ("ETag", f"W/{tag}"), ("Cache-Control", "max-age=604800"), ("Vary", "Accept-Encoding"), ("Content-Length", "0")]
                name = lambda what: None if k is None else f"urn:page:{k}:{what}"  # noqa: E731, B023
                out.append(record_bytes(name("response"), "response", u or "", at, "200 OK", first, body) + record_bytes(name("revisit"), "revisit", u or "", later, "304 Not Modified", second))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    return pages.select(key, url, html).mapInArrow(run, "content binary")
