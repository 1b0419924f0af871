"""Personal data by weak supervision.

Four kinds have fixed patterns (email, ip, card, phone); their spans stand as
they are. Candidates of further kinds (secrets, long numbers, bank accounts,
national ids, dates of birth, postal addresses and persons) are voted on by six
labelers each: regular expressions and check digits for shapes, gazetteers of
names, places of streets, countries and words that announce such data, and the
context around. Votes are 1, -1 or 0 (abstains). Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is. Its
posteriors are the soft labels from which a logistic classifier of spans is
trained, on features that are not the votes: the form of the span and of what
stands next to it, and a bucket of the word before. Candidates to which it gives
0.5 or more become spans.

Patterns of votes and of features are bounded by their number, whatever the
corpus holds; only their counts reach the driver. Matching is linear in the text
and in the candidates; of candidates that overlap, the first and then the
longest stays, and none may touch a base span. Offsets are code points. Null
texts are empty and have no spans. Rows are judged one by one, repeated ones
alike. An empty table gives no rows; without candidates nothing is added.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "iban", "national_id", "birth_date", "address", "person")
Span = tuple[str, int, int]

# The patterns of the contract; possessive where no shorter match can succeed.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Words that announce such data, in several languages.
_SECRET_WORDS = "token secret password passwort passwd pwd contraseña clave apikey api_key api-key auth bearer credential key jeton schlüssel".split()
_NUMBER_WORDS = "card account iban konto cuenta compte tarjeta carte karte phone tel telefon teléfono téléphone ssn passport id no nr".split()
_IBAN_WORDS = "iban konto account cuenta compte bank banco banque überweisung transfer".split()
_ID_WORDS = "ssn social security dni nif nie nir insee sécurité sociale steuer-id steuerid steueridentifikationsnummer ausweis passport national id identity identidad identité tax".split()
_BIRTH_WORDS = "born birth birthday dob geboren geburtsdatum geburtstag né née naissance nacido nacida nacimiento".split()
_HOME_WORDS = "address lives living resides home wohnt wohnhaft anschrift adresse adress domicile habite demeurant dirección domicilio vive ship deliver".split()
_NAME_WORDS = "name named contact signed author patient client customer employee nombre llamado nom nommé kunde mitarbeiter verfasser".split()
_TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña".split()
# Frequent given names of four languages, and words that are no names.
_GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Emma Oliver Anna Peter "
    "Hans Klaus Jürgen Wolfgang Heike Sabine Petra Ursula Monika Stefan Andreas Matthias Jean Pierre Marie Michel Philippe Nathalie Isabelle Catherine Nicolas Julien Camille Chloé "
    "José María Carlos Carmen Juan Ana Luis Laura Manuel Lucía Francisco Pilar Javier Marta Antonio Elena"
).split()
_NO_NAMES = "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday The This That And But".split()
# Lengths of bank account numbers by country.
_IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_UP = "A-ZÀ-ÖØ-Þ"
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]|[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2})(?![\w-])")
_DATE = re.compile(r"(?<![\w./-])(?:([0-9]{1,2})[./-]([0-9]{1,2})[./-]([12][0-9]{3})|([12][0-9]{3})-([0-9]{2})-([0-9]{2}))(?![\w/-])")
_ADDRESS = re.compile(
    rf"(?<!\w)(?:[0-9]{{1,5}} (?:[{_UP}][\w'-]{{0,30}} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?!\w)"
    rf"|[0-9]{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse) (?:d[eu] |des |de la |de l')?[{_UP}][\w'-]{{0,30}}(?: [{_UP}][\w'-]{{0,30}}){{0,2}}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino) (?:de |del |de la )?[{_UP}]\w{{0,30}}(?: [{_UP}]\w{{0,30}}){{0,2}},? [0-9]{{1,4}}(?![\w])"
    rf"|[{_UP}]\w{{1,30}}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?(?!\w))"
)
_CAPITALS = re.compile(rf"(?<!\w)[{_UP}][\w'-]{{0,40}}\.?(?: [{_UP}][\w'-]{{0,40}}){{1,3}}")
_WORD_BEFORE = re.compile(r"([^\W\d_][\w-]*)\W{0,4}\Z")
_VALUE = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+")
_ANNOUNCED = re.compile(r"(?i)\b(?:" + "|".join(_SECRET_WORDS) + r")\b\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,}+)")
#: Texts without these have neither base spans nor candidates; the second part is how _CAPITALS begins, bounded as it is there.
_MAY = re.compile(rf"[0-9@+=:]|(?<!\w)[{_UP}][\w'-]{{0,40}}\.? [{_UP}]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, low = text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low = end = m.end()
            yield start, end
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    """The spans of the four fixed kinds, by start, then kind."""
    out: list[Span] = [("email", *e) for e in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _persons(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words that a title or a given name leads, or that are announced; without the title."""
    for m in _CAPITALS.finditer(text):
        first, _, rest = m[0].partition(" ")
        if first.rstrip(".") in _TITLES:
            yield m.end() - len(rest), m.end()
        elif first in _GIVEN or _before(text, m.start()) in _NAME_WORDS:
            yield m.span()


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal and touch none of base, by start; of those that overlap, the first and then the longest."""
    found: dict[tuple[int, int], str] = {}
    digits = any(c in text for c in "0123456789")
    if digits:
        for kind, pattern in (("iban", _IBAN), ("national_id", _ID), ("birth_date", _DATE), ("address", _ADDRESS)):
            for m in pattern.finditer(text):
                found.setdefault(m.span(), kind)
        for m in _VALUE.finditer(text):
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                found.setdefault(m.span(), "secret")
    if "=" in text or ":" in text:
        for m in _ANNOUNCED.finditer(text):
            found.setdefault(m.span(1), "secret")
    if digits:
        for m in _CARD.finditer(text):
            if 9 <= len(_digits(m[0])) <= 19:
                found.setdefault(m.span(), "number")
    for span in _persons(text):
        found.setdefault(span, "person")
    taken: list[list[int]] = []  # base spans, those that overlap as one
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    out, end, k = [], 0, 0
    for (a, b), kind in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= end and (k == len(taken) or b <= taken[k][0]):
            out.append((kind, a, b))
            end = b
    return out


def _entropy(s: str) -> float:
    n = [s.count(c) / len(s) for c in set(s)]
    return -sum(p * math.log2(p) for p in n)


def _before(text: str, a: int) -> str:
    """The word before a place, in lower case."""
    m = _WORD_BEFORE.search(text[max(0, a - 24) : a])
    return m[1].lower() if m else ""


def _near(text: str, a: int, b: int, words: list[str]) -> bool:
    """Whether one of the words stands in the 40 characters before a or the 20 after b."""
    return any(w in words for part in (text[max(0, a - 40) : a], text[b : b + 20]) for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", part.lower()))


def _mod97(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _id_checks(s: str) -> bool:
    """Whether the check letter or key of a national id is right, or its parts are given out."""
    if s[-1].isalpha():
        return _DNI_LETTERS[int(_digits(s)) % 23] == s[-1]
    plain = _digits(s)
    if len(plain) == 15:
        return 97 - int(plain[:13]) % 97 == int(plain[13:])
    return plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"


def _day(s: str) -> date | None:
    m = _DATE.fullmatch(s)
    y, x, z = (m[3], m[2], m[1]) if m[3] else (m[4], m[5], m[6])
    for month, day in ((x, z), (z, x)):
        try:
            return date(int(y), int(month), int(day))
        except ValueError:
            pass
    return None


def judge(text: str, span: Span) -> list[int]:
    """The labelers' votes on a candidate: 1, -1 or 0 each."""
    kind, a, b = span
    s = text[a:b]
    before, after, word = text[max(0, a - 24) : a], text[b : b + 2], _before(text, a)
    assigned = bool(re.search(r"[=:]\s{0,3}[\"']?\Z", before))
    yes = lambda c: 1 if c else 0
    sure = lambda c: 1 if c else -1
    no = lambda c: -1 if c else 0
    plain = _digits(s)
    if kind == "secret":
        digits, entropy = len(plain) / len(s), _entropy(s)
        quoted = before[-1:] in ("'", '"') and before[-1:] == after[:1]
        shape = 1 if entropy >= 3.2 and digits > 0.1 else -1 if entropy < 2.5 else 0
        return [yes(re.fullmatch(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})", s)), shape, yes(word in _SECRET_WORDS), sure(assigned), yes(quoted), no(re.fullmatch(r"[a-z]+(?:[-_/][a-z]+)*[0-9]{0,2}", s))]
    if kind == "number":
        return [sure(12 <= len(plain) <= 19), sure(_luhn(plain)), yes(word in _NUMBER_WORDS), yes(assigned), no(len(set(plain)) <= 3), no(after[:1] in ("%", "$", "€") or before[-1:] in ("$", "€"))]
    if kind == "iban":
        bare = s.replace(" ", "")
        return [sure(_mod97(bare)), sure(_IBAN_LENGTHS.get(bare[:2]) == len(bare)), yes(_near(text, a, b, _IBAN_WORDS)), yes(assigned), yes(re.fullmatch(r"(?:\S{4} )+\S{1,4}", s)), no(len(set(bare)) <= 4)]
    if kind == "national_id":
        return [sure(_id_checks(s)), yes(_near(text, a, b, _ID_WORDS)), yes(assigned), no(len(set(plain)) <= 3), no(after[:1] in ("%", "$", "€")), no(before[-2:] in ("# ", "v ", "p."))]
    if kind == "birth_date":
        day, told = _day(s), _near(text, a, a, _BIRTH_WORDS)
        return [sure(day), sure(told), yes(day and 1900 <= day.year <= 2015), yes(assigned and told), no(re.match(r"[ T][0-9]{1,2}:", text[b : b + 4])), no(not day or day.year > 2025)]
    if kind == "address":
        number = int(plain[:5] or 0)
        return [sure(0 < number < 10_000), yes(_near(text, a, b, _HOME_WORDS)), yes(re.match(r"\W{1,3}(?:[0-9]{4,5}|[A-Z]{1,2}[0-9])", text[b : b + 10])), yes(assigned), yes(before[-1:] in ("\n", "") or before[-2:] == ", "), no(len(s) > 60)]
    names = s.split()
    titled = before.rstrip(" .").rpartition(" ")[2] in _TITLES
    return [yes(titled), yes(names[0] in _GIVEN), yes(_near(text, a, a, _NAME_WORDS)), sure(len(names) in (2, 3) or titled), no(any(n in _NO_NAMES for n in names)), no(not titled and any(len(n) < 3 for n in names))]


def features(text: str, span: Span) -> int:
    """The form of a span and of its surroundings, as bits."""
    _, a, b = span
    s = text[a:b]
    digits = sum(c.isdigit() for c in s) / len(s)
    form = (
        len(s) >= 12, len(s) >= 20, len(s) >= 32, digits > 0.2, digits > 0.6, s != s.lower(), s != s.upper(),
        any(c in " -./" for c in s), text[a - 1 : a] in ("", "\n"), text[b : b + 1] in ("", "\n", ".", ",", ";", '"', "'"),
    )
    return sum(int(f) << k for k, f in enumerate(form)) | 1 << (FORMS + zlib.crc32(_before(text, a).encode()) % BUCKETS)


#: Labelers of each kind; features of form, buckets of the word before, and both.
LABELERS, FORMS, BUCKETS = 6, 10, 8
FEATURES = FORMS + BUCKETS
#: Shares of true candidates to start from: most long numbers and dates are nobody's.
PRIORS = {"secret": 0.5, "number": 0.2, "iban": 0.5, "national_id": 0.3, "birth_date": 0.2, "address": 0.5, "person": 0.4}


def _code(votes: list[int]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def _votes(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(LABELERS)]


def reliabilities(patterns: list[tuple[list[int], float]], prior: float = 0.5, rounds: int = 100, weight: float = 8.0, first: float = 0.75) -> tuple[float, list[float]]:
    """Expectation-maximisation: the share of true candidates and each labeler's accuracy where it votes.

    weight is the number of made-up votes of accuracy first that each labeler starts from.
    """
    accuracy, share = [first] * LABELERS, prior
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        right, cast, true = [weight * first] * LABELERS, [weight] * LABELERS, weight * prior
        for votes, n in patterns:
            p = belief(votes, share, accuracy)
            true += n * p
            for k, v in enumerate(votes):
                if v:
                    cast[k] += n
                    right[k] += n * (p if v > 0 else 1 - p)
        before, share = share, true / (total + weight)
        accuracy = [min(0.99, max(0.5, r / c)) for r, c in zip(right, cast, strict=True)]
        if abs(before - share) < 1e-9:
            break
    return share, accuracy


def belief(votes: list[int], share: float, accuracy: list[float]) -> float:
    odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def train(rows: list[tuple[list[int], float, float]], rounds: int = 400, rate: float = 0.5, penalty: float = 1e-3) -> list[float]:
    """Logistic weights (bias last) from (features, soft label, count)."""
    w = [0.0] * ((len(rows[0][0]) if rows else FEATURES) + 1)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [penalty * x for x in w]
        for f, p, n in rows:
            miss = n / total * (chance(w, f) - p)
            for k, x in enumerate([*f, 1]):
                slope[k] += miss * x
        w = [x - rate * s for x, s in zip(w, slope, strict=True)]
    return w


def chance(w: list[float], f: list[int]) -> float:
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*f, 1], strict=True))))


class PiiFinder:
    """find() gives every row its base spans and the spans that the trained classifier adds."""

    def __init__(self, text: str = "text", key: str = "doc_id", least: float = 0.5):
        self.text, self.key, self.least = text, key, least

    def candidates(self, docs: DataFrame) -> DataFrame:
        """id, base and more (kind, start, end, votes, features) of every row."""
        rows = docs.select(F.col(self.key).alias("id"), F.col(self.text).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches):
            span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
            base_type, more_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.int32()), ("features", pa.int32())]))
            named = lambda s: dict(zip(("kind", "start", "end"), s, strict=True))
            for batch in batches:
                base, more = [], []
                for text in batch.column("text").to_pylist():
                    own, extra = [], []
                    if text and _MAY.search(text):
                        own = base_spans(text)
                        for c in candidates(text, own):
                            extra.append(named(c) | {"votes": _code(judge(text, c)), "features": features(text, c)})
                    base.append([named(s) for s in own])
                    more.append(extra)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, base_type), pa.array(more, more_type)], names=["id", "base", "more"])

        return rows.mapInArrow(run, f"id {kind}, base array<struct<kind:string,start:bigint,end:bigint>>, more array<struct<kind:string,start:bigint,end:bigint,votes:int,features:int>>")

    def fit(self, found: DataFrame) -> dict[tuple[str, int], float]:
        """The classifier's chance for every pattern of features that occurs, by kind."""
        counted = found.select(F.explode("more").alias("c")).groupBy("c.kind", "c.votes", "c.features").count().collect()  # at most 3^labelers * 2^forms * buckets rows a kind
        out = {}
        for kind in KINDS[len(BASE) :]:
            own = sorted((r["votes"], r["features"], r["count"]) for r in counted if r["kind"] == kind)
            share, accuracy = reliabilities([(_votes(v), n) for v, _, n in own], PRIORS[kind])
            bits = lambda f: [f >> k & 1 for k in range(FEATURES)]
            w = train([(bits(f), belief(_votes(v), share, accuracy), n) for v, f, n in own])
            out |= {(kind, f): chance(w, bits(f)) for _, f, _ in own}
        return out

    def find(self, docs: DataFrame) -> DataFrame:
        """One row per row: id, base, spans (base ones and those added)."""
        found = written(self.candidates(docs))
        model = {k for k, p in self.fit(found).items() if p >= self.least}
        good = sorted(KINDS.index(kind) << FEATURES | f for kind, f in model) or [-1]
        rank = F.array(*(F.lit(k) for k in KINDS))
        kept = lambda c: F.shiftleft(F.array_position(rank, c["kind"]).cast("int") - 1, FEATURES).bitwiseOR(c["features"]).isin(good)
        added = F.transform(F.filter("more", kept), lambda c: F.struct(c["start"].alias("start"), F.array_position(rank, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
        own = F.transform("base", lambda c: F.struct(c["start"].alias("start"), F.array_position(rank, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
        return found.select("id", F.array_sort(own).alias("base"), F.array_sort(F.concat(own, added)).alias("spans"))


def written_out(spans: str):
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
