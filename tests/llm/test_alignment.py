import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from frames import awkward, awkward_rows, empty
from pyspark.sql import functions as F
from shared import DATA

from marlstone.llm import alignment
from marlstone.llm.alignment import Aligner, Fragment, Tokens, compose, finished, fragment, ranges, score_links, sides, tokens


@lru_cache(1)
def plain():
    """The tokenizers as they come."""
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(printable)))}
    return a, b, byte


def by_hand(text):
    """Groups and links of one text, from ends of tokens as Python sets."""
    if not text:
        return [], [], 0, 0
    a, b, byte = plain()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], 0, 0
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[i:k], ids_b[j:m]))
        links.append((ids_a[k - 1], ids_b[m - 1]))
        i, j = k, m
    return groups, links, len(ids_a), len(ids_b)


def written_out(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows):
    """Rows of the query, repeats and all."""
    told = [(k, *by_hand(t)) for k, t in rows]
    counts = Counter(x for _, _, links, *_ in told for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for k, groups, links, n_a, n_b in told:
        digest = hashlib.sha256(written_out(groups).encode()).hexdigest() if groups else ""
        out.append((k, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def got_rows(aligner, docs):
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    got = score_links(aligner.align(docs).withColumn("sha", digest).drop("groups"))
    return sorted((tuple(r) for r in got.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()), key=str)


PARTS = ["the cat", " runs", "'s", "'re", "'", "é", "é", "日本語", "👍🏽", "\n", "\r\n", "\t", "  ", " ", "12345", "<|endoftext|>", "<s>", "<0x41>", "!!", "...", "\xa0", "　", "​", "ﬁ", "x" * 40, "internationalisation", "\x00", "ñandú", "ß", "\x85", "᠎"]


def odd_texts(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def cut_up(text, chunk):
    """Fragments of a text's ranges."""
    both = sides(*Aligner().files)
    whole, at, out, sizes = " " + text, [0, 0], [], []
    for k, (a0, a1, b0, b1) in enumerate(ranges(both, whole, chunk)):
        t = tokens(both, whole[a0:a1], whole[b0:b1], *at, k == 0)
        assert t is not None
        at = [at[0] + len(whole[a0:a1].encode()), at[1] + len(whole[b0:b1].encode())]
        out.append(fragment(t))
        sizes.append((len(t.a), len(t.b)))
    return out, sizes


def fold(parts, rng):
    """Composes neighbours in a random order."""
    parts = list(parts)
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [compose(parts[k], parts[k + 1])]
    return parts[0]


@pytest.mark.parametrize("chunk", [2, 3, 7, 50])
def test_fragments_compose_in_any_order(chunk):
    rng = random.Random(chunk)
    for text in filter(None, odd_texts(chunk, 150)):
        groups, links, n_a, n_b = by_hand(text)
        assert groups, repr(text)
        parts, sizes = cut_up(text, chunk)
        for _ in range(3):
            told, n, pairs = finished(fold(parts, rng))
            assert told == written_out(groups) and n == len(groups), repr(text)
            assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in pairs] == links
        assert np.sum(sizes, axis=0).tolist() == [n_a, n_b]


def random_tokens(rng, n):
    """Tokens of two invented vocabularies over n bytes."""
    ends = [sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}) for _ in range(2)]
    ids = [[rng.randint(0, 9) for _ in e] for e in ends]
    return Tokens(np.array(ids[0], "<u4"), np.array(ends[0], "<i8"), np.array(ids[1], "<u4"), np.array(ends[1], "<i8"))


def test_monoid():
    """Cuts that differ between the two sides, neutral elements, and all ways to set brackets."""
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 30)
        t = random_tokens(rng, n)
        edges = [[0, *sorted(rng.randint(0, len(x)) for _ in range(4)), len(x)] for x in (t.a, t.b)]
        parts = [fragment(t.part(slice(edges[0][k], edges[0][k + 1]), slice(edges[1][k], edges[1][k + 1]))) for k in range(5)]
        parts.insert(rng.randint(0, 5), Fragment(Tokens()))
        want = finished(fragment(t))
        for _ in range(4):
            got = finished(fold(parts, rng))
            assert got[:2] == want[:2] and got[2].tolist() == want[2].tolist()


def test_ranges_have_open_ends():
    """The two sides are cut at different characters, so prefixes and suffixes of both kinds occur."""
    text = "year 1234567890 end! " * 60
    parts, _ = cut_up(text, 9)
    assert any(len(p.suffix.a) or len(p.suffix.b) for p in parts[:-1])
    edges = list(ranges(sides(*Aligner().files), " " + text, 9))
    assert any(a1 != b1 for _, a1, _, b1 in edges)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + list(enumerate(odd_texts(3, 60), 100)) + [(7, "a▁b"), (8, "▁"), (9, " ")]
    docs = awkward(spark, [(k, t, None) for k, t in rows])
    want = expected(rows)
    assert got_rows(Aligner(), docs) == want
    assert sum(r[1] == 0 for r in want) >= 5


def test_long_texts_over_many_tasks(spark):
    """Every text is cut into ranges, and composed in several rounds."""
    rng = random.Random(8)
    texts = odd_texts(4, 20, 300) + ["a" * 3000, "日本語" * 900, " " * 500, "the cat's " * 700, "a▁b " * 300, "".join(rng.choice("abc ") for _ in range(4000))]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    docs = awkward(spark, [(k, t, None) for k, t in rows])
    assert got_rows(Aligner(chunk=17), docs) == expected(rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = expected(rows)
    assert got_rows(Aligner(), docs) == want
    assert got_rows(Aligner(chunk=700), docs) == want
    assert sum(r[4] for r in want) > 10_000


def test_rare_pairs_are_joined(spark, monkeypatch):
    rows = list(enumerate(odd_texts(6, 80)))
    docs = awkward(spark, [(k, t, None) for k, t in rows])
    want = expected(rows)
    for hot in (1, 20):
        monkeypatch.setattr(alignment, "HOT", hot)
        assert got_rows(Aligner(), docs) == want


def test_nothing(spark):
    assert got_rows(Aligner(), empty(spark)) == []
    assert got_rows(Aligner(), awkward(spark, [(1, None, None), (2, "", None)])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
