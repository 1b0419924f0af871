import random

import numpy as np
import pytest
from frames import LOWER, awkward, awkward_rows, empty, words
from shared import DATA

from marlstone.llm import minhash
from marlstone.llm.hashing import shingles, words_of
from marlstone.llm.minhash import NearDedup


def shingle_set(text, size):
    ws = words((text or "").translate(LOWER))
    return frozenset(tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def expected(rows, size):
    """(id, set size, component) of every row, by all pairs of distinct sets."""
    sets = [shingle_set(t, size) for _, t, *_ in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    part = {s: s for s in kinds}

    def find(s):
        while part[s] != s:
            s = part[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            n = len(a & b)
            if 100 * n >= 80 * (len(a) + len(b) - n):
                part[find(a)] = find(b)
    least = {}
    for (k, *_), s in zip(rows, sets, strict=True):
        if s and k is not None:
            least[find(s)] = min(k, least.get(find(s), k))
    return sorted(((k, len(s), least.get(find(s)) if s else k) for (k, *_), s in zip(rows, sets, strict=True)), key=str)


def got(spark, rows, size):
    return sorted((tuple(r) for r in NearDedup(size).decide(awkward(spark, rows).repartition(3)).select("id", "n_shingles", "component_id").collect()), key=str)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = rng.choice("uvwxyz") + str(rng.randrange(50))
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_awkward_rows(spark, size):
    assert got(spark, awkward_rows(), size) == expected(awkward_rows(), size)


def test_families_of_all_distances(spark):
    rng = random.Random(12)
    texts = []
    for f in range(6):
        base = [f"{f}-{rng.randrange(400)}" for _ in range(80)]
        texts += family(rng, base, 40, 4 + 3 * f)
    rng.shuffle(texts)
    rows = [(k, t, None) for k, t in enumerate(texts)]
    assert got(spark, rows, 2) == expected(rows, 2)


def test_the_exact_rest_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rng = random.Random(13)
    base = [f"b{k}" for k in range(60)]
    rows = [(k, t, None) for k, t in enumerate(family(rng, base, 120, 9))]
    assert got(spark, rows, 2) == expected(rows, 2)


def stranger(rng, passage, least, band, n):
    """passage and n more words none of whose shingles is among the minima of band, so that texts of the passage share its bucket."""
    ws = passage + ["-"] * n
    at = list(range(len(passage), len(ws)))
    while at:
        for k in at:
            ws[k] = f"{rng.getrandbits(48):x}"
        own, _ = shingles(words_of([" ".join(ws).encode()]), 2)
        low = (own[:, None] * minhash._A[4 * band : 4 * band + 4] + minhash._B[4 * band : 4 * band + 4]) >> np.uint64(32)
        at = sorted({k + 1 for k in np.flatnonzero((low < least[4 * band : 4 * band + 4]).any(axis=1)) if k + 1 >= len(passage)})
    return " ".join(ws)


def test_near_copies_among_strangers_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CENTRES", 1)
    rng = random.Random(15)
    rows, pairs = [], []
    for p in range(4):
        passage = [f"p{p}-{rng.getrandbits(30):x}" for _ in range(20)]
        two = [" ".join([*passage, *(f"{c}{p}{k}" for k in range(2))]) for c in "ab"]
        sets = minhash._sets([" ".join(passage), *two], 2)
        low = minhash.minima(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
        same = [b for b in range(24) if (low[:, 4 * b : 4 * b + 4] == low[0, 4 * b : 4 * b + 4]).all()]
        for band in same:
            n = 0
            while n < 30:
                text = stranger(rng, passage, low[0], band, 95)
                own = minhash.minima(x := minhash._sets([text], 2)[0], np.array([0, len(x)]))[0]
                if all(((own & np.uint64(3)) == (s & np.uint64(3))).mean() < 0.37 for s in low[1:]):  # an estimate below 0.16
                    rows.append((len(rows), text, None))
                    n += 1
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + k, t, None) for k, t in enumerate(two)]
    found = {k: c for k, _, c in got(spark, rows, 2)}
    assert [found[b] for _, b in pairs] == [a for a, _ in pairs]
    assert sum(k == c for k, c in found.items()) == len(rows) - len(pairs)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert got(spark, rows, 2) == expected(rows, 2)


def test_estimates_are_unbiased():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a = {rng.getrandbits(60) for _ in range(400)}
        b = set(list(a)[: rng.randint(100, 400)]) | {rng.getrandbits(60) for _ in range(rng.randint(0, 200))}
        both = [np.array(sorted(x), dtype=np.uint64) for x in (a, b)]
        low = minhash.minima(np.concatenate(both), np.array([0, len(both[0]), len(both[0]) + len(both[1])]))
        x, y = minhash.signatures(low).view(np.uint64)
        lanes = lambda s: [int(s[k]) >> (2 * j) & 3 for k in range(3) for j in range(32)]
        equal = np.mean([p == q for p, q in zip(lanes(x), lanes(y), strict=True)])
        errors.append((equal - 0.25) / 0.75 - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_shingles_are_those_of_words():
    texts = ["", "a", "a b", " a  b\tc ", "x", "b c d e", "a b"]
    values, firsts = shingles(words_of([t.encode() for t in texts]), 2)
    groups = [values[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    assert [len(g) for g in groups] == [0, 1, 1, 2, 1, 3, 1]
    assert groups[2] == groups[6] == groups[3][:1] and groups[1] != groups[4] and groups[3][1] == groups[5][0]


def test_kept_rows(spark):
    docs = awkward(spark)
    kept = NearDedup(2).keep(docs)
    assert kept.columns == docs.columns
    want = {k for k, _, c in expected(awkward_rows(), 2) if k == c}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_kept_rows_of_null_and_shared_ids(spark):
    rng = random.Random(14)
    base = [f"w{k}" for k in range(60)]
    plain = [" ".join(f"{k}-{rng.randrange(900)}" for _ in range(30)) for k in range(12)]
    rows = [(None, t, None) for t in plain[:6]] + [(7, t, None) for t in plain[6:]]  # linked with nothing
    rows += [(None, plain[0], None), (7, plain[6], None)]  # repeated rows
    rows += [(None, t, None) for t in family(rng, base, 4, 2)]  # a component of null ids alone
    rows += [(k, t, None) for k, t in zip((None, 7, 7, 9), family(rng, ["x" + w for w in base], 4, 2), strict=True)]
    rows += [(None, None, None), (None, "", None), (None, " \t", None), (8, None, None), (8, "", None)]
    got = [(r["doc_id"], r["text"]) for r in NearDedup(2).keep(awkward(spark, rows).repartition(3)).collect()]
    lone = [(None, t) for t in plain[:6]] + [(7, t) for t in plain[6:]] + [(None, None), (None, ""), (None, " \t"), (8, None), (8, "")]
    families = [r for r in got if r[1] and r[1] not in plain and r[1].strip()]
    assert sorted((r for r in got if r not in families), key=str) == sorted(lone, key=str)
    assert sorted((k for k, _ in families), key=str) == [7, None]


def test_nothing(spark):
    assert NearDedup().decide(empty(spark)).count() == 0 == NearDedup().keep(empty(spark)).count()


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_sums_of_powers_confuse(spark):
    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rows = [(0, f"{a} x", None), (1, f"{b} x", None), (2, f"{a} x", None), (3, " ".join([a, *"cdefghijklmnop"]), None), (4, " ".join([b, *"cdefghijklmnop"]), None)]
    found = got(spark, rows, 2)
    assert found == expected(rows, 2) and {k: c for k, _, c in found} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}  # 13 of 15 shingles


def linked_components(rows, size, percent=80):
    """As expected(), of many rows: sets that are linked share one of their rarest shingles."""
    sets = [shingle_set(t, size) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    often = {}
    for s in kinds:
        for x in s:
            often[x] = often.get(x, 0) + 1
    part = list(range(len(kinds)))

    def find(k):
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    having, links = {}, 0
    for k, s in enumerate(kinds):
        near = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]:
            near.update(having.setdefault(x, []))
            having[x].append(k)
        for m in near:
            both = len(s & kinds[m])
            if 100 * both >= percent * (len(s) + len(kinds[m]) - both):
                links += 1
                part[find(k)] = find(m)
    place, least = {s: k for k, s in enumerate(kinds)}, {}
    for (k, _), s in zip(rows, sets, strict=True):
        if s:
            root = find(place[s])
            least[root] = min(k, least.get(root, k))
    return {k: least[find(place[s])] if s else k for (k, _), s in zip(rows, sets, strict=True)}, links


def test_no_link_of_many_documents_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(4)
    want, links = linked_components([tuple(r) for r in docs.collect()], 2)
    found = {r["id"]: r["component_id"] for r in NearDedup(2).decide(docs).collect()}
    wrong = sum(found[k] != c for k, c in want.items())
    assert links > 500 and wrong <= 0.01 * links, (wrong, links)


def test_templates_are_no_links(spark):
    rng = random.Random(16)
    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*base, *(f"{rng.getrandbits(40):x}" for _ in range(30))]), None) for k in range(400)]
    rows += [(400 + k, f"{rows[k][1]} {k}", None) for k in range(0, 400, 40)]
    found = {k: c for k, _, c in got(spark, rows, 2)}
    assert all(found[k] == (k - 400 if k >= 400 else k) for k in found)


def test_texts_go_to_a_bounded_number_of_cells(spark, monkeypatch):
    """Blocks grow with the group: of 4,000 and of 16,000 texts each is sent to at most 16 cells in either role."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "BLOCK_CHARS", 10_000)
    for n in (4_000, 16_000):
        texts = spark.range(n).select(F.col("id").alias("node"), F.repeat(F.lit("x"), 100).alias("text"))
        rows = texts.select("node", F.lit(1).cast("long").alias("centre"), F.col("node").alias("part"), F.length("text").alias("chars"))
        cells = NearDedup(2)._cells(rows, texts, small=False)
        sent = cells.groupBy("node", "role").count().agg(F.max("count"), F.count("*")).first()
        assert sent[0] <= 16 and sent[1] == 2 * n - 1


def test_text_cells_of_a_template(spark, monkeypatch):
    """Estimates between the two bounds call for texts; in many small cells no link is lost or made up."""
    monkeypatch.setattr(minhash, "BLOCK_CHARS", 2_000)
    rng = random.Random(23)
    body = [f"t{k}" for k in range(100)]
    rows = [(k, " ".join(body + [f"v{rng.randint(0, 10**6)}" for _ in range(21)]), None) for k in range(150)]
    rows += [(200 + k, t + f" z{k}", None) for k, (_, t, _) in enumerate(rows[:10])]
    assert got(spark, rows, 2) == expected(rows, 2)
