"""Texts held against many passages, and paragraphs of a text held against each other, each text read once."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import WHITE
from marlstone.session import small_batches

#: Characters of passages in one automaton (some 70 bytes each in a task), and automata at most: a pass over the texts each.
PART, PASSES = 1 << 20, 16


@lru_cache(maxsize=1)
def _automaton(pairs: tuple[tuple[str, tuple], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for passage, items in pairs:
        out.add_word(passage, items)
    out.make_automaton()
    return out


def parts_of(passages: DataFrame, text: str) -> int:
    """How many automata the passages take: about half of PART each, so that none is over it by chance; a longer passage is alone too long."""
    total = passages.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    return 1 if total <= PART else -(-2 * total // PART)


def contained(docs: DataFrame, passages: DataFrame, key: str, item: str, text: str, parts: int) -> DataFrame:
    """Pairs of a document and a passage that it contains, letter for letter: key, item, once for each row of docs.

    All passages of a part stand in one automaton, which a text runs through once,
    whatever their number and lengths. Null texts hold nothing and null passages
    are nowhere; equal passages are found each.
    """
    found = None
    rows = docs.select(key, F.col(text).alias("body")).where("body IS NOT NULL")
    shape = docs.select(key).schema.add(passages.schema[item])
    for part in range(parts):
        own = passages.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(text), F.lit(parts)) == part)).select(item, text).collect()  # characters of one part
        by_text: dict[str, list] = {}
        for i, t in own:
            if t:
                by_text.setdefault(t, []).append(i)
        pairs = tuple((t, tuple(i)) for t, i in sorted(by_text.items()))

        def run(batches, pairs=pairs):
            machine = _automaton(pairs) if pairs else None
            for batch in batches:
                if machine is None:
                    return
                at, items = [], []
                for k, body in enumerate(batch.column(1).to_pylist()):
                    hits = {own for _, own in machine.iter(body)}
                    for i in (i for own in hits for i in own):
                        at.append(k)
                        items.append(i)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items)], names=[key, item])

        one = rows.mapInArrow(run, shape)
        found = one if found is None else found.unionByName(one)
    return found


_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")


def _shingles(paragraph: str, size: int) -> set[str]:
    ws = [w for w in _BLANKS.split(paragraph) if w]
    return {" ".join(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()


def classes_of(paragraphs: list[str], size: int, percent: int) -> list[int]:
    """For each paragraph the least index of its class: those that similar ones (or chains of them) reach.

    Sets at the threshold share a shingle of their prefixes when both are ordered
    by rarity. Under every such shingle, those met before stand by class; one
    similar member settles a class, so likes are compared once each and not in
    pairs. A member whose place in its order, or whose size, leaves too little to
    share is passed over.
    """
    first_of: dict[str, int] = {}
    own_class = [first_of.setdefault(p, k) for k, p in enumerate(paragraphs)]
    kinds = {k: _shingles(paragraphs[k], size) for k in set(own_class)}
    rarity = Counter(s for own in kinds.values() for s in own)
    parent = {k: k for k in kinds}
    # by shingle: classes, each with its members as (index, place of the shingle)
    under: dict[str, dict[int, list[tuple[int, int]]]] = {}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in sorted(kinds):
        own = kinds[k]
        order = sorted(own, key=lambda s: (rarity[s], s))
        n, tried = len(own), set()
        prefix = order[: n - -(-n * percent // 100) + 1]
        for place, shingle in enumerate(prefix):
            if rarity[shingle] < 2:
                continue
            stand = under.setdefault(shingle, {})
            for name in list(stand):
                now = root(name)
                if now != name:  # its class has grown into another
                    members = stand.pop(name)
                    stand.setdefault(now, []).extend(members)
            for name, members in stand.items():
                mine = root(k)
                if name == mine:
                    continue
                for other, at in members:
                    m = len(kinds[other])
                    if other in tried or 100 * min(n, m) < percent * max(n, m):
                        continue
                    most = 1 + min(n - place - 1, m - at - 1)  # the first shared one is this, if it is the first
                    if (100 + percent) * (min(place, at) + most) < percent * (n + m):
                        continue
                    tried.add(other)
                    both = len(own & kinds[other])
                    if 100 * both >= percent * (n + m - both):
                        parent[max(root(other), mine)] = min(root(other), mine)
                        break
        mine = root(k)
        for place, shingle in enumerate(prefix):
            if rarity[shingle] > 1:
                under[shingle].setdefault(mine, []).append((k, place))
    return [root(c) for c in own_class]


def pairs_of(paragraphs: list[tuple[int, str]], size: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Of one document's paragraphs (index, content) the unlike ones whose shingle sets are similar: index < index, shingles of both, shingles of either.

    Equal paragraphs stand for their least index. A paragraph of which too few
    shingles stand elsewhere meets none; the others meet under the rarest of
    theirs, of which two sets at the threshold share one.
    """
    index: dict[str, int] = {}
    for k, content in paragraphs:
        index[content] = min(k, index.get(content, k))
    kinds = {k: own for content, k in index.items() if (own := _shingles(content, size))}
    rarity = Counter(s for own in kinds.values() for s in own)
    under: dict[str, list[int]] = {}
    out = []
    for k in sorted(kinds):
        own = kinds[k]
        n = len(own)
        least = -(-n * percent // 100)
        shared = [s for s in own if rarity[s] > 1]
        if len(shared) < least:
            continue
        # those that stand once come first in the order of all, and take their places in the prefix
        shared.sort(key=lambda s: (rarity[s], s))
        prefix = shared[: len(shared) - least + 1]
        for other in {o for s in prefix for o in under.get(s, ())}:
            m = len(kinds[other])
            if 100 * min(n, m) >= percent * max(n, m):
                both = len(own & kinds[other])
                if 100 * both >= percent * (n + m - both):
                    out.append((other, k, both, n + m - both))
        for s in prefix:
            under.setdefault(s, []).append(k)
    return out


def near_pairs(paras: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """pairs_of() each document: key, i, j, both, all. paras: key, paragraph_index, content; null keys and contents meet nothing. A document's paragraphs are held in one row."""
    known = paras.where(F.col(key).isNotNull() & F.col("content").isNotNull())
    gathered = known.groupBy(key).agg(F.collect_list(F.struct(F.col("paragraph_index").alias("k"), "content")).alias("own")).where(F.size("own") > 1)
    place = paras.schema["paragraph_index"].dataType
    shape = paras.select(key).schema.add("i", place).add("j", place).add("both", T.LongType()).add("all", T.LongType())

    def run(batches):
        for batch in batches:
            own = batch.column(1)
            index, contents = own.flatten().field(0).to_pylist(), own.flatten().field(1).to_pylist()
            at, found, start = [], [], 0
            for row, n in enumerate(own.value_lengths().to_pylist()):
                pairs = pairs_of(list(zip(index[start : start + n], contents[start : start + n], strict=True)), size, percent)
                start += n
                at += [row] * len(pairs)
                found += pairs
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (own.type.value_type[0].type,) * 2 + (pa.int64(),) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, "i", "j", "both", "all"])

    return small_batches(gathered).mapInArrow(run, shape)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Every paragraph (non-blank line) of every document with the class of its likes: key, paragraph_index (from 0), class_id (the least index of it), class_size.

    Equal paragraphs are of one class. A null text has no paragraphs; rows of one
    key are judged each. A text and its paragraphs are held by one task, and no
    row meets another.
    """
    shape = docs.select(key).schema.add("paragraph_index", T.IntegerType()).add("class_id", T.IntegerType()).add("class_size", T.LongType())

    def run(batches):
        for batch in batches:
            at, index, names, sizes = [], [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                paragraphs = [p for line in (body or "").split("\n") if (p := line.strip(WHITE))]
                own = classes_of(paragraphs, size, percent)
                n = Counter(own)
                at += [k] * len(own)
                index += range(len(own))
                names += own
                sizes += [n[c] for c in own]
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(names, pa.int32()), pa.array(sizes, pa.int64())], names=[key, "paragraph_index", "class_id", "class_size"])

    return docs.select(key, text).mapInArrow(run, shape)
