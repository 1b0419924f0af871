import hashlib
import random
import re

from frames import awkward, awkward_rows, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import pii

# The contract's patterns, plainly.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def expected(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@-+ ()5%ü", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == expected(text)


def test_base_spans_of_likely_texts():
    rng = random.Random(1)
    parts = ["a.b+c@x-y.example.com", "@", "a@b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1", "x", " ", ",", "é", "0000000000000000", "999999999999999999999"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randint(1, 6)))
        assert pii.base_spans(text) == expected(text), text


def test_long_texts_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+" * 100_000, "1 " * 100_000, "-" * 100_000):
        pii.candidates(text, pii.base_spans(text))


def test_rows_and_digests(spark):
    rows = [*awkward_rows(), (100, 'mail a@b.co, call +1 (555) 010-9999; token = "0123456789abcdef0123456789abcdef01234567" 10.0.0.1', "s")]
    got = pii.PiiFinder().find(awkward(spark, rows)).select("id", pii.written_out("base").alias("base"), pii.written_out("spans").alias("spans")).collect()
    assert sorted(((r["id"], r["base"]) for r in got), key=str) == sorted(((k, ",".join(f"{a}:{b}:{c}" for a, b, c in expected(t))) for k, t, *_ in rows), key=str)
    mine = next(r for r in got if r["id"] == 100)
    assert "secret:" in mine["spans"] and set(mine["base"].split(",")) <= set(mine["spans"].split(","))
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(next(r for r in got if r["id"] == 1)["base"].encode()).hexdigest()


def test_secrets_are_found_and_words_left_alone(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        secret = "".join(rng.choice("0123456789") + rng.choice("abcdef") for _ in range(20))
        rows.append((2 * k, f'some words token = "{secret}" and more', None))
        rows.append((2 * k + 1, f"the long-hyphenated-compound-words see version{k % 10} chapter {k} page 12345", None))
    got = {r["id"]: [s["kind"] for s in r["spans"]] for r in pii.PiiFinder().find(awkward(spark, rows)).collect()}
    assert all(got[2 * k] == ["secret"] and got[2 * k + 1] == [] for k in range(60))


def test_em_and_classifier():
    rng = random.Random(3)
    patterns = {}
    for _ in range(3000):
        true = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < a) == true else -1) if rng.random() < 0.8 else 0 for a in (0.9, 0.85, 0.8, 0.9, 0.75, 0.7))
        patterns[votes] = patterns.get(votes, 0) + 1
    share, accuracy = pii.reliabilities([(list(v), n) for v, n in sorted(patterns.items())])
    assert abs(share - 0.4) < 0.05 and all(abs(a - b) < 0.06 for a, b in zip(accuracy, (0.9, 0.85, 0.8, 0.9, 0.75, 0.7), strict=True))
    w = pii.train([([1, 0, 0, 0, 0, 0, 0], 0.95, 50), ([0, 1, 0, 0, 0, 0, 0], 0.05, 50)])
    assert pii.chance(w, [1, 0, 0, 0, 0, 0, 0]) > 0.7 > 0.3 > pii.chance(w, [0, 1, 0, 0, 0, 0, 0])


def test_nothing(spark):
    assert pii.PiiFinder().find(empty(spark)).count() == 0


def test_a_long_announced_secret_is_whole():
    value = ".".join(("abX9" * 84)[k:] for k in range(3))
    text = f"token: {value} and more"
    assert len(value) > 1000
    assert pii.candidates(text, pii.base_spans(text)) == [("secret", 7, 7 + len(value))]


def test_many_candidates_are_linear():
    import time

    text = " ".join(f"{k:05}{rng_digits(k)} x" for k in range(16_000))
    base = pii.base_spans(text)
    began = time.perf_counter()
    found = pii.candidates(text, base)
    assert time.perf_counter() - began < 2  # a quadratic search takes over 9 s
    assert len(found) + sum(k == "card" for k, *_ in base) == 16_000


def rng_digits(k):
    return str(10**9 + k * 7_919_993 % (9 * 10**9))


def test_spans_never_overlap():
    rng = random.Random(9)
    parts = ["Mr. John Smith", "12 Main Street", "DE89 3704 0044 0532 0130 00", "born 12.03.1980", "123-45-6789", "token: abcdefgh12345678", "1.2.3.4", "a@b.co", "4111 1111 1111 1111", "Hauptstraße 5", "x"]
    for _ in range(400):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        base = pii.base_spans(text)
        found = pii.candidates(text, base)
        assert all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False))
        assert all(b <= x or a >= y for _, a, b in found for _, x, y in base)


PLANTED = {
    "iban": ("please pay to IBAN {} today", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]),
    "national_id": ("her ssn is {} as said", ["123-45-6789", "219-09-9999", "457-55-5462"]),
    "birth_date": ("she was born {} in town", ["12.03.1980", "1975-11-30", "04/07/1969"]),
    "address": ("the patient lives at {} since then", ["12 Main Street", "7 Old Mill Road", "221 Baker Street"]),
    "person": ("we met Mr {} at noon", ["John Smith", "Peter Jones", "William Brown"]),
    "secret": ('the token = "{}" is set', ["0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", "ffee0011ddcc2233bbaa4455998866770a0b0c0d"]),
}
CLEAN = ["sold on 2031-05-06 10:30 for 1200", "see page 12 of chapter 34", "The Main Street was long", "order 12345678 of The March", "on 01.02.2030 the shop opens", "AB12 is a room"]


def test_planted_data_by_kind(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for k in range(600):
        words = [rng.choice(["sun", "sea", "hill", "tree", "road"]) for _ in range(rng.randint(5, 30))]
        kind = rng.choice([*PLANTED, None, None])
        if kind:
            frame, values = PLANTED[kind]
            text = frame.format(v := rng.choice(values))
        else:
            text = rng.choice(CLEAN)
        at = rng.randint(0, len(words))
        whole = " ".join([*words[:at], text, *words[at:]])
        rows.append((k, whole, None))
        want[k] = (kind, whole.index(v), whole.index(v) + len(v)) if kind else None
    got = {r["id"]: [tuple(s[c] for c in ("kind", "start", "end")) for s in r["spans"]] for r in pii.PiiFinder().find(awkward(spark, rows)).collect()}
    hit = sum(w in got[k] for k, w in want.items() if w)
    extra = sum(s != want[k] for k, spans in got.items() for s in spans)
    planted = sum(w is not None for w in want.values())
    assert hit >= 0.95 * planted and extra <= 0.03 * planted, (hit, extra, planted)


def test_whole_rows_are_linear(spark):
    """A megabyte of one class of characters each, and of what candidates begin with, through the whole operator."""
    import time

    n = 1_000_000
    texts = ["ACGT" * (n // 4), "A-" * (n // 2), "A'" * (n // 2), "A." * (n // 2), "A " * (n // 2), "Ab " * (n // 3), "a" * n, "é" * n, "1" * n, "1-" * (n // 2), "1." * (n // 2), "@" * n, "a@" * (n // 2), "+" * n, "+1 " * (n // 3), "=" * n, " " * n, "\n" * n, "-" * n, "_" * n]
    finder = pii.PiiFinder()
    assert finder.candidates(awkward(spark, [(1, "x", None)])).count() == 1
    for text in texts:
        docs = awkward(spark, [(1, text, None)])
        began = time.perf_counter()
        assert finder.candidates(docs).count() == 1
        assert time.perf_counter() - began < 4, text[:6]


def test_prefilter_lets_every_candidate_through():
    rng = random.Random(12)
    parts = ["Mr.", "Dr", "John", "Smith", "O'Neil", "a-Anna", "élan", "Élise", " ", " ", ". ", "-", "'", "x", "12 Main Street", "x" * 50, "A" * 45]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        base = pii.base_spans(text)
        assert pii._MAY.search(text) or not (base or pii.candidates(text, base)), text
