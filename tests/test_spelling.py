import math
import random
from collections import Counter

from marlstone.operators import review, spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def slip_of(a, b):
    """The slip that made a of b, by trying all of them."""
    if any(b[:k] + b[k + 1] + b[k] + b[k + 2 :] == a for k in range(len(b) - 1)):
        return "swapped"
    if any(b[:k] + b[k + 1 :] == a for k in range(len(b))):
        return "left out"
    if any(a[:k] + a[k + 1 :] == b for k in range(len(a))):
        return "added"
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
        return "mistaken"
    return None


def by_hand(words, rare, ratio):
    out = {}
    for a, m in words.items():
        found = [(-round(math.log(n) - spelling.SLIPS[s], 9), b, s) for b, n in words.items() if m <= rare and n >= max(rare + 1, ratio) and n >= ratio * m and a != b and (s := slip_of(a, b))]
        if found:
            out[a] = min(found)[1:]
    return out


def test_corrections_are_brute_force(spark):
    rng = random.Random(1)
    words = {}
    for _ in range(120):
        word = "".join(rng.choice("abcñé") for _ in range(rng.randint(2, 6)))
        words[word] = rng.choice([1, 2, 3, 50, 100, 250, 1000])
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["original"]: (r["corrected"], r["slip"]) for r in spelling.corrections(frame, 2, 100.0).collect()}
    want = by_hand(words, 2, 100.0)
    assert got == want and {s for _, s in want.values()} == set(spelling.SLIPS)
    assert spelling.corrections(frame.limit(0)).count() == 0


def mistaken(rng, word):
    k = rng.randrange(1, len(word))
    kind = rng.randrange(4)
    if kind == 0 and word[k - 1] != word[k]:
        return word[: k - 1] + word[k] + word[k - 1] + word[k + 1 :]
    if kind == 1:
        return word[:k] + word[k + 1 :]
    if kind == 2:
        return word[:k] + rng.choice(LETTERS) + word[k:]
    return word[:k] + rng.choice(LETTERS.replace(word[k], "")) + word[k + 1 :]


def test_planted_misspellings_are_found(spark):
    """Of 200 slips in words of a vocabulary with rare words of its own: recall and precision of at least 0.95."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    common, scarce = [word(rng.randint(6, 10)) for _ in range(60)], [word(rng.randint(6, 10)) for _ in range(2000)]
    texts = [[rng.choice(common) for _ in range(60)] + [rng.choice(scarce)] for _ in range(900)]
    planted = {}
    for k in range(200):
        right = rng.choice(common)
        wrong = mistaken(rng, right)
        planted[k] = (wrong, right)
        texts[k].insert(rng.randrange(60), wrong.capitalize())
    docs = spark.createDataFrame([(k, "\n".join([" ".join(t[:30]) + ".", " ".join(t[30:])]), "x", "y") for k, t in enumerate(texts)] + [(5000, None, "x", "y"), (5001, "", "x", "y")], "doc_id long, text string, original string, n string")
    found = spelling.learned(docs.select("doc_id", "text"), review.split_paragraphs(docs)).collect()
    told = Counter((r["doc_id"], r["original"], r["corrected"]) for r in found)
    want = Counter((k, w, r) for k, (w, r) in planted.items() if w != r)
    hit = sum((told & want).values())
    assert hit >= 0.95 * want.total() and hit >= 0.95 * told.total(), (hit, want.total(), told.total())
    assert {r["paragraph_index"] for r in found} == {0, 1}
