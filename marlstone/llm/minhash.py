"""Near-duplicates by b-bit MinHash.

1. Each document's distinct shingles give 352 minima. Documents of equal sets are
   one class (a digest of both halves of the shingles' 128-bit hashes); only
   classes go on, so a group of copies costs one row.
2. 48 bands of 7 minima each name a bucket; buckets with one class go. In every
   bucket, each class meets three centres (the least by three hashes of the
   class, so that one family mostly has the same ones): pairs grow with the rows,
   not with their square.
3. The low 2 bits of the minima, packed into eleven longs, estimate each pair's
   similarity from the number of equal lanes, corrected for chance (a quarter
   of unequal minima agree). Pairs below the threshold by over six standard
   errors go.
4. What is left is confirmed on the full sets of both texts, by the words
   themselves and not by their hashes; components follow.
5. The exact rest: all classes that share a bucket with its first centre are
   around it, like it or not. Where they still fall into several components,
   those outside the most frequent one are a query set that is held against all
   of them in blocks of bounded size, first by their estimates (as in 3), and
   what may be linked with a class of another component then on full sets. It
   reports one link per query and component, so no family is written out as pairs.
   The bands are steep: of a family that shares half of its shingles (a
   template), one in seventeen is in a given bucket of the template. Those are
   compared by their signatures, each sent to at most sixteen cells, and their
   estimates are over five standard errors below what may be a link, so their
   texts don't travel. Texts that do travel go to cells of a quarter megabyte and more,
   which grow with their group up to sixteen megabytes of queries.
6. Components by alternating stars.

Two sets at 0.8 share no band with a chance of 1.3e-5. Null, empty and blank texts
have an empty set and are linked with nothing. Repeated rows share a class.
Null ids don't count as least; a component of null ids alone has a null id. An
empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.hashing import digest, mix, shingle_set, shingles, words_of
from marlstone.llm.store import drop, written

BANDS, ROWS, BITS = 48, 7, 2
#: Minima: those of the bands, and more to fill whole longs.
HASHES = 352
CENTRES = 3
#: Shingles of the sets that a task remembers while it confirms pairs.
MEMORY = 500_000
#: Sets of one block of queries, and rows that a cell streams past them.
BLOCK_QUERIES, BLOCK_ROWS = 256, 512
#: Blocks that a group is dealt into at most, while a block holds no more than so many signatures or characters of texts.
MOST_BLOCKS, MOST_SIGNATURES, BLOCK_CHARS, MOST_CHARS = 16, 16_384, 1 << 18, 1 << 24
_LANES = 64 // BITS
_LONGS = HASHES // _LANES
_draw = np.random.Generator(np.random.PCG64(77))
_A = _draw.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _draw.integers(0, 2**64, HASHES, dtype=np.uint64)
_ROW = _draw.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _draw.integers(0, 2**64, BANDS, dtype=np.uint64)


def minima(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The HASHES minima of each run of values; no run may be empty."""
    out = np.empty((len(firsts) - 1, HASHES), dtype=np.uint64)
    work = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, _A[k], out=work)
        work += _B[k]
        out[:, k] = np.minimum.reduceat(work, firsts[:-1])
    return out >> np.uint64(32)


def signatures(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed into _LONGS longs a row."""
    lanes = (low & np.uint64((1 << BITS) - 1)).reshape(len(low), _LONGS, _LANES)
    return np.bitwise_or.reduce(lanes << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS) * _ROW).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)


def estimated(a: str, b: str) -> Column:
    """The similarity of two rows by their packed signatures (columns a_0.., b_0..)."""
    unequal = F.lit(0)
    for k in range(_LONGS):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        unequal = unequal + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def slack(percent: int) -> float:
    """Six standard errors of an estimate of percent / 100."""
    equal = percent / 100 + (1 - percent / 100) * 0.5**BITS
    return 6 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - 0.5**BITS)


def _linked(a: set[bytes], b: set[bytes], percent: int) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _sets(texts: list[str | None], size: int):
    """Sorted distinct shingles of each text."""
    values, firsts = shingles(words_of([(t or "").encode().lower() for t in texts]), size)
    return [np.unique(values[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


class NearDedup:
    """Groups of documents linked by a Jaccard similarity of their shingle sets of at least percent / 100."""

    def __init__(self, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id"):
        self.size, self.percent, self.text, self.key = size, percent, text, key

    def sketch(self, docs: DataFrame) -> DataFrame:
        """id, body (a hash that tells texts of one id apart), n_shingles, class, s0.., bands; an empty set has no class."""
        size = self.size
        rows = docs.select(F.col(self.key).alias("id"), F.xxhash64(self.text).alias("body"), F.col(self.text).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        longs = [f"s{k}" for k in range(_LONGS)]

        def run(batches):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                at = 0
                while at < len(texts):
                    to, chars = at, 0
                    while to < len(texts) and (to == at or chars < 300_000):
                        chars += len(texts[to] or "")
                        to += 1
                    yield sketched([batch.column(c)[at:to] for c in ("id", "body")], texts[at:to])
                    at = to

        def sketched(own, texts):
            ws = words_of([(t or "").encode().lower() for t in texts])
            (values, firsts), (others, _) = shingles(ws, size), shingles(ws, size, ws.others)
            sets, halves = ([np.unique(x[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)] for x in (values, others))
            n = np.array([max(len(s), len(o)) for s, o in zip(sets, halves, strict=True)])
            full = np.flatnonzero(n)
            names, sigs, keys = [None] * len(sets), np.zeros((len(sets), _LONGS), dtype=np.int64), [None] * len(sets)
            if len(full):
                low = minima(np.concatenate([sets[k] for k in full]), np.concatenate(([0], np.cumsum([len(sets[k]) for k in full]))))
                sigs[full] = signatures(low)
                for k, row in zip(full, band_keys(low), strict=True):
                    names[k], keys[k] = digest(sets[k].tobytes() + halves[k].tobytes()), row
            return pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(names, pa.binary()), *(pa.array(sigs[:, k]) for k in range(_LONGS)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "body", "n_shingles", "class", *longs, "bands"])

        return rows.mapInArrow(run, f"id {kind}, body bigint, n_shingles bigint, class binary, {', '.join(f'{c} bigint' for c in longs)}, bands array<bigint>")

    def _confirm(self, pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
        """pairs: u, v, a written table. Those whose full sets are similar enough."""
        size, percent = self.size, self.percent
        texts = self._texts(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs)
        left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
        right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
        met = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")

        def run(batches):
            known: OrderedDict[str, set[bytes]] = OrderedDict()
            held = 0

            def set_of(text):
                nonlocal held
                if text not in known:
                    known[text] = shingle_set(text.encode().lower(), size)
                    held += len(known[text])
                    while held > MEMORY and len(known) > 2:
                        held -= len(known.popitem(last=False)[1])
                known.move_to_end(text)
                return known[text]

            for batch in batches:
                yes = []
                for a, b in zip(batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist(), strict=True):
                    yes.append(_linked(set_of(a), set_of(b), percent))
                yield batch.select(["u", "v"]).filter(pa.array(yes, pa.bool_()))

        out = written(met.mapInArrow(run, "u bigint, v bigint").distinct())
        drop(texts, pairs)
        return out

    def links(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The sketches, the nodes (node, class, id: the least of the class) and the components of nodes (u, v)."""
        sketches = written(self.sketch(docs))
        longs = [f"s{k}" for k in range(_LONGS)]
        named = sketches.where("class IS NOT NULL")
        classes = named.groupBy("class").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in longs)).withColumn("node", F.monotonically_increasing_id())
        named_nodes = written(classes)  # from here on node numbers are data
        first = named.select("class", F.struct("id").alias("who"), "body", "bands").join(named_nodes.select("class", F.struct("id").alias("who"), "node"), ["class", "who"])
        nodes = written(named_nodes.join(first.groupBy("node").agg(F.min("body").alias("body")), "node"))
        # rows of one id and class have one list of bands
        every = written(first.dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket")))
        shared = written(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
        members = written(every.join(shared, "bucket"))
        drop(named_nodes, every, shared)
        by = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node")).alias(f"c{k}") for k in range(CENTRES)]
        centre = members.groupBy("bucket").agg(*by)
        centre = centre.select("bucket", F.col("c0.node").alias("home"), F.array_distinct(F.array(*(F.col(f"c{k}.node") for k in range(CENTRES)))).alias("centres"))
        star = members.join(centre, "bucket").select("node", F.explode("centres").alias("centre"), "home").where("node <> centre")
        pairs = star.groupBy("node", "centre").agg(F.max(F.col("home") == F.col("centre")).alias("home"))
        signed = nodes.select("node", *longs)
        for side, name in (("a", "node"), ("b", "centre")):
            pairs = pairs.join(signed.select(F.col("node").alias(name), *(F.col(c).alias(f"{side}_{c[1:]}") for c in longs)), name)
        met = written(pairs.select("node", "centre", "home", (estimated("a_", "b_") >= self.percent / 100 - slack(self.percent)).alias("near")).where("near OR home"))
        drop(members)
        close = written(met.where("near").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct())
        parts = components(self._confirm(close, nodes, docs))
        around = met.where("home").select("node", "centre")
        around = around.unionByName(around.select(F.col("centre").alias("node"), "centre").distinct())
        rest = self._rest(around, nodes, parts, docs)
        if not rest.isEmpty():
            parts = components(parts.unionByName(rest))
        drop(met, rest)
        return sketches, nodes, parts

    def _texts(self, wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
        """wanted: node. One row (node, text) each."""
        needed = wanted.join(nodes, "node").select("node", "body", F.struct("id").alias("who"))
        rows = docs.select(F.struct(F.col(self.key).alias("id")).alias("who"), F.xxhash64(self.text).alias("body"), F.col(self.text).alias("text"))
        return written(needed.join(rows, ["who", "body"]).select("node", "text").dropDuplicates(["node"]))

    def _cells(self, rows: DataFrame, carried: DataFrame, small: bool) -> DataFrame:
        """rows: node, centre, part; carried: node and what else is needed. Around each centre, the queries (role 0) and the rows (role 1) that they are held against, in sorted cells.

        Blocks grow with the group, so that a row is sent to few of them: by their
        number where what is carried is small, else by the characters of texts, in
        a column chars of rows.
        """
        sizes = rows.groupBy("centre", "part").agg((F.count("*") if small else F.sum("chars")).alias("n"))
        mixed = sizes.groupBy("centre").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        mixed = written(mixed.select("centre", F.col("top.part").alias("top"), (F.col("n") - F.col("top.n")).alias("queries"), "n"))  # so that the join may split a hot centre

        def blocks(n: str, least: int) -> Column:
            least, most = (least, MOST_SIGNATURES) if small else (BLOCK_CHARS, MOST_CHARS)
            size = F.greatest(F.lit(least), F.least(F.ceil(F.col(n) / MOST_BLOCKS), F.lit(most)))
            return F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")

        rows = rows.join(mixed, "centre").select("node", "centre", "part", (F.col("part") != F.col("top")).alias("query"), blocks("n", BLOCK_ROWS).alias("salts"), blocks("queries", BLOCK_QUERIES).alias("blocks"))
        rows = written(rows)
        spread = F.xxhash64("node", "centre")
        # a query stands in its block under every salt; a row under its salt in every block
        each = lambda n, own: F.array(F.pmod(spread, F.col(n)).cast("int")) if own else F.sequence(F.lit(0), F.col(n) - 1)
        cell = lambda own: (F.explode(each("blocks", own)).alias("block"), each("salts", not own).alias("salts"))
        asked = rows.where("query").select("node", "centre", "part", F.lit(0).alias("role"), *cell(True))
        told = rows.select("node", "centre", "part", F.lit(1).alias("role"), *cell(False))
        cells = asked.unionByName(told).select("node", "centre", "part", "role", "block", F.explode("salts").alias("salt")).join(carried, "node")
        # by range of a hash, whose sampled bounds make tasks even where a hash of few cells would not
        dealt = cells.withColumn("deal", F.xxhash64("centre", "block", "salt")).repartitionByRange("deal", "centre", "block", "salt")
        return dealt.sortWithinPartitions("centre", "block", "salt", "role", "node")

    def _alike(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """rows: node, centre, part. Those whose estimate to one of another part around their centre may be a link."""
        longs = [f"s{k}" for k in range(_LONGS)]
        own = ["centre", "block", "salt", "role", "node", "part", *longs]
        most = int(HASHES * (1 - 0.5**BITS) * (1 - (self.percent / 100 - slack(self.percent))) + 1e-9)  # unequal lanes

        def judged(cell):
            asked, told = cell[cell[:, 3] == 0], cell[cell[:, 3] == 1]
            if not len(asked):
                return []
            like, met = np.zeros(len(asked), dtype=bool), np.zeros(len(told), dtype=bool)
            step = max(1, 1_000_000 // max(1, len(told)))
            sides = [(np.ascontiguousarray(asked[:, k]).view(np.uint64), np.ascontiguousarray(told[:, k]).view(np.uint64)) for k in range(6, 6 + _LONGS)]
            for at in range(0, len(asked), step):
                unequal = np.zeros((min(step, len(asked) - at), len(told)), dtype=np.uint16)
                for a, b in sides:
                    x = a[at : at + step, None] ^ b[None]
                    unequal += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
                hit = (unequal <= most) & (asked[at : at + step, 5][:, None] != told[:, 5][None])
                like[at : at + step] = hit.any(axis=1)
                met |= hit.any(axis=0)
            found = np.unique(np.concatenate((asked[like, 4], told[met, 4])))
            return [pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), cell[0, 0]))], names=["node", "centre"])] if len(found) else []

        def run(batches):
            held = np.empty((0, len(own)), dtype=np.int64)
            for batch in batches:
                held = np.concatenate((held, np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in own])))
                edges = [0, *(1 + np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)))]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    yield from judged(held[a:b])
                held = held[edges[-1] :]
            if len(held):
                yield from judged(held)

        cells = self._cells(rows, nodes.select("node", *longs), small=True).select(own)
        return rows.join(written(cells.mapInArrow(run, "node bigint, centre bigint")).distinct(), ["node", "centre"], "left_semi")

    def _rest(self, around: DataFrame, nodes: DataFrame, parts: DataFrame, docs: DataFrame) -> DataFrame:
        """around: node, centre. Links (u, v) between components of the nodes around one centre."""
        size, percent = self.size, self.percent
        part = parts.select(F.col("u").alias("node"), F.col("v").alias("part"))
        rows = written(around.join(part, "node", "left").withColumn("part", F.coalesce("part", "node")))
        before, rows = rows, written(self._alike(rows, nodes))
        drop(before)
        texts = self._texts(rows.select("node").distinct(), nodes, docs)
        rows = rows.join(texts.select("node", F.length("text").alias("chars")), "node")
        dealt = self._cells(rows, texts, small=False)

        def run(batches):
            own, queries, index, seen = None, [], None, set()
            for batch in batches:
                out = []
                texts = batch.column("text").to_pylist()
                for text, values, node, centre, p, role, block, salt in zip(texts, _sets(texts, size), *(batch.column(c).to_pylist() for c in ("node", "centre", "part", "role", "block", "salt")), strict=True):
                    if (centre, block, salt) != own:
                        own, queries, index, seen = (centre, block, salt), [], None, set()
                    if role == 0:
                        queries.append((node, p, values, text))
                        continue
                    if index is None and queries:
                        owner = np.repeat(np.arange(len(queries)), [len(q[2]) for q in queries])
                        flat = np.concatenate([q[2] for q in queries])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], owner[order], np.array([len(q[2]) for q in queries]), np.array([q[1] for q in queries])
                    if index is None:
                        continue
                    low, high = np.searchsorted(index[0], values, "left"), np.searchsorted(index[0], values, "right")
                    n = high - low
                    total = int(n.sum())
                    if not total:
                        continue
                    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    both = np.bincount(index[1][at], minlength=len(queries))
                    linked = (both > 0) & (100 * both >= percent * (len(values) + index[2] - both)) & (index[3] != p)
                    for k in np.flatnonzero(linked):
                        if (k, p) not in seen and _linked(*(shingle_set(t.encode().lower(), size) for t in (text, queries[k][3])), percent):
                            seen.add((k, p))
                            out.append((max(node, queries[k][0]), min(node, queries[k][0])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

        return written(dealt.select("node", "centre", "part", "role", "block", "salt", "text").mapInArrow(run, "u bigint, v bigint"))

    def decide(self, docs: DataFrame) -> DataFrame:
        """One row per row: id, n_shingles, component_id, kept."""
        sketches, nodes, parts = self.links(docs)
        whole = nodes.select("class", "node", "id").join(parts.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
        least = written(whole.groupBy("part").agg(F.min("id").alias("component_id")))  # so that the join may split a hot component
        by_class = whole.join(least, "part").select("class", "component_id")
        some = sketches.select("id", "n_shingles", "class").where("class IS NOT NULL").join(by_class, "class").drop("class")
        none = sketches.where("class IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
        return some.unionByName(none).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows that stay, with the columns of docs: of each component one row of the least id (and of the least body), and all rows with an empty set."""
        _, nodes, parts = self.links(docs)
        whole = nodes.select("node", "id", "body").join(parts.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
        best = whole.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("b"))
        best = written(best.select(F.struct(F.col("b.id").alias(self.key)).alias("who"), F.col("b.body").alias("body")))
        rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(self.key)).alias("who"), F.xxhash64(self.text).alias("body"), F.coalesce(F.col(self.text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
        some = rows.where("worded").withColumn("copy", F.row_number().over(Window.partitionBy("who", "body").orderBy(F.lit(0)))).where("copy = 1")
        return some.join(best, ["who", "body"], "left_semi").select("row.*").unionByName(rows.where("NOT worded").select("row.*"))
