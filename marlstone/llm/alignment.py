"""Alignment of two tokenizers' tokens by the bytes they cover, as an associative composition of fragments.

Both tokenizers see a space and the text. Byte offsets where a token of A and one
of B both end cut the tokens into groups; the last two tokens of a group end
together and are a link.

A fragment is what a range of bytes tells: an open prefix (tokens up to the first
shared end, whose beginning may lie further left), closed groups, and an open
suffix (tokens after the last shared end). Two neighbours compose: the left
suffix and the right prefix are searched for shared ends anew, since the two
tokenizers may be cut at different bytes. Composition is associative, so texts
of over `chunk` characters are cut into ranges, tokenised by different tasks and
composed by a tree, eight fragments a group and round.

A range is cut for each tokenizer where no token can lie across: two neighbouring
characters that no entry of its vocabulary holds together, and for A no place
where the splitting pattern looks across. A stretch without such a place, as one
letter a million times, is tokenised by one task.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte,
have no tokens: zeros and ''. Repeated rows and ids are aligned each; a null id is
an id like others; an empty table gives no rows. A document's groups are held in
one row, as its text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.store import drop, written
from marlstone.llm.tokens import default_files, encoder

#: Characters of a range, fragments composed at once, and the share of all links from which a pair's count travels to every task: at most HOT pairs have it.
CHUNK, FAN, HOT = 1 << 16, 8, 1 << 14
#: Pairs a task counts before it hands them on, and bytes of a batch.
HELD, BATCH = 1 << 19, 1 << 23
SPACE = "▁"


class SideA:
    """A byte-level BPE vocabulary: ids of a piece of text, each id's bytes, and where a text may be cut."""

    def __init__(self, json_file: str, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.ids = encoder(json_file, ranks_file, True)
        vocabulary = Tokenizer.from_file(json_file).get_vocab()
        # byte-level BPE shows printable bytes as themselves and the others as the characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes = np.empty(max(vocabulary.values()) + 1, dtype=object)
        self.bytes[:] = b""
        for piece, k in vocabulary.items():
            self.bytes[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.together = {b[k : k + 2] for b in self.bytes for k in range(len(b) - 1)}

    @staticmethod
    def _sure(c: str) -> bool:
        """A character that no version of Unicode takes for white space."""
        return c.isalnum() or "!" <= c <= "~"

    def safe(self, whole: str, p: int) -> bool:
        x, y = whole[p - 1], whole[p]
        if not self._sure(x):
            return False
        if y in " \t\n\r":
            return True
        return self._sure(y) and "'" not in whole[max(0, p - 3) : p + 1] and x.encode()[-1:] + y.encode()[:1] not in self.together

    def encode(self, whole: str, starts: bool) -> np.ndarray:
        return self.ids(whole)


class SideB:
    """A vocabulary of pieces with a space before the text; bytes of pieces, and where a text may be cut."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        n = self.model.get_piece_size()
        self.bytes, self.together = np.empty(n, dtype=object), set()
        for k in range(n):
            piece = self.model.id_to_piece(k)
            self.bytes[k] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace(SPACE, " ").encode()
            if not self.model.is_byte(k):
                self.together |= {piece[i : i + 2] for i in range(len(piece) - 1)}
        #: A line feed joins with nothing, so that what follows it is encoded as if it stood alone; two ids come before.
        self.before = self.model.encode("\n")

    def safe(self, whole: str, p: int) -> bool:
        return whole[p - 1 : p + 1].replace(" ", SPACE) not in self.together

    def encode(self, whole: str, starts: bool) -> np.ndarray:
        if starts:
            return np.array(self.model.encode(whole[1:]), dtype="<u4")
        ids = self.model.encode("\n" + whole)
        return np.array(ids[len(self.before) :] if ids[: len(self.before)] == self.before else [], dtype="<u4")


@lru_cache(maxsize=2)
def sides(json_file: str, ranks_file: str | None, model_file: str) -> tuple[SideA, SideB]:
    return SideA(json_file, ranks_file), SideB(model_file)


@lru_cache(maxsize=4)
def _numerals(n: int, after: str) -> np.ndarray:
    out = np.empty(n, dtype=object)
    out[:] = [f"{k}{after}" for k in range(n)]
    return out


def _none(kind: str) -> np.ndarray:
    return np.zeros(0, dtype=kind)


@dataclass
class Tokens:
    """Tokens of both sides in order, with the byte each ends at in the document."""

    a: np.ndarray = field(default_factory=lambda: _none("<u4"))
    a_ends: np.ndarray = field(default_factory=lambda: _none("<i8"))
    b: np.ndarray = field(default_factory=lambda: _none("<u4"))
    b_ends: np.ndarray = field(default_factory=lambda: _none("<i8"))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate((getattr(self, c), getattr(other, c))) for c in ("a", "a_ends", "b", "b_ends")))

    def part(self, a: slice, b: slice) -> Tokens:
        return Tokens(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])


@dataclass
class Fragment:
    """Open prefix, closed groups as text with their links, open suffix; without a shared end all is prefix."""

    prefix: Tokens
    closed: bool = False
    groups: str = ""
    n_groups: int = 0
    links: np.ndarray = field(default_factory=lambda: _none("<u8"))
    suffix: Tokens = field(default_factory=Tokens)

    @property
    def tail(self) -> Tokens:
        return self.suffix if self.closed else self.prefix


def _link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype("<u8") << np.uint64(32)) | b.astype("<u8")


def _text(a: np.ndarray, last_a: np.ndarray, b: np.ndarray, last_b: np.ndarray) -> str:
    """Groups that end at the given places, as a1,a2|b1;a3|b2,b3; nothing comes after the last."""
    if not len(last_a):
        return ""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    top = int(max(a.max(), b.max())) + 1
    size = 1 << max(16, top.bit_length())
    out = np.empty(len(a) + len(b), dtype=object)
    at_a = np.arange(len(a)) + np.repeat(ends_b - n_b, n_a)
    at_b = np.arange(len(b)) + np.repeat(ends_a, n_b)
    comma = _numerals(size, ",")
    out[at_a], out[at_b] = comma[a], comma[b]
    out[at_a[last_a]], out[at_b[last_b]] = _numerals(size, "|")[a[last_a]], _numerals(size, ";")[b[last_b]]
    return "".join(out.tolist())[:-1]


def fragment(t: Tokens) -> Fragment:
    """Tokens of a range, searched for shared ends."""
    place = np.searchsorted(t.b_ends, t.a_ends)
    if len(t.b_ends):
        own = np.flatnonzero((place < len(t.b_ends)) & (t.b_ends[np.minimum(place, len(t.b_ends) - 1)] == t.a_ends))
    else:
        own = place[:0]
    if not len(own):
        return Fragment(t)
    other = place[own]
    a0, b0, a1, b1 = own[0] + 1, other[0] + 1, own[-1] + 1, other[-1] + 1
    inner = t.part(slice(a0, a1), slice(b0, b1))
    last_a, last_b = own[1:] - a0, other[1:] - b0
    return Fragment(
        t.part(slice(0, a0), slice(0, b0)), True, _text(inner.a, last_a, inner.b, last_b), len(last_a), _link(inner.a[last_a], inner.b[last_b]), t.part(slice(a1, None), slice(b1, None))
    )


def _whole(t: Tokens) -> tuple[str, np.ndarray]:
    """A group, as text, and its link."""
    return ",".join(map(str, t.a.tolist())) + "|" + ",".join(map(str, t.b.tolist())), _link(t.a[-1:], t.b[-1:])


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of both ranges; associative, and Fragment(Tokens()) changes nothing."""
    mid = fragment(left.tail + right.prefix)
    if not left.closed and not right.closed:
        return mid
    groups, links, n = [], [], 0

    def take(text, link, k):
        nonlocal n
        if k:
            groups.append(text)
            links.append(link)
            n += k

    if left.closed:
        take(left.groups, left.links, left.n_groups)
        if mid.closed:
            take(*_whole(mid.prefix), 1)
    take(mid.groups, mid.links, mid.n_groups)
    if right.closed:
        take(right.groups, right.links, right.n_groups)
    prefix = left.prefix if left.closed else mid.prefix
    suffix = right.suffix if right.closed else (mid.suffix if mid.closed else mid.prefix)
    return Fragment(prefix, True, ";".join(groups), n, np.concatenate(links) if links else _none("<u8"), suffix)


def finished(f: Fragment) -> tuple[str, int, np.ndarray]:
    """Groups, their number and links of a whole document."""
    if not f.closed:
        return "", 0, _none("<u8")
    first, link = _whole(f.prefix)
    return f"{first};{f.groups}" if f.n_groups else first, f.n_groups + 1, np.concatenate((link, f.links))


def _encoded(side, whole: str, raw: bytes, at: int, starts: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and ends of a piece, or None where its bytes don't come back."""
    ids = side.encode(whole, starts) if whole else _none("<u4")
    parts = side.bytes[ids].tolist()
    if b"".join(parts) != raw:
        return None
    return ids, at + np.cumsum(np.fromiter(map(len, parts), dtype="<i8", count=len(parts)))


def tokens(both: tuple[SideA, SideB], whole_a: str, whole_b: str, at_a: int = 0, at_b: int = 0, starts: bool = True) -> Tokens | None:
    """Tokens of a piece for A and one for B, that start at the given bytes; None where bytes don't come back."""
    a = _encoded(both[0], whole_a, whole_a.encode(), at_a, starts)
    b = a and _encoded(both[1], whole_b, whole_b.encode(), at_b, starts)
    return None if b is None else Tokens(*a, *b)


def ranges(both: tuple[SideA, SideB], whole: str, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of characters (a_from, a_to, b_from, b_to) of about chunk characters; each side is cut where its tokens may be."""
    before, n = [0, 0], len(whole)
    for edge in range(chunk, n + chunk, chunk):
        now = []
        for side, last in zip(both, before, strict=True):
            p = max(edge, last)
            while p < n and p != last and not side.safe(whole, p):
                p += 1
            now.append(min(p, n))
        yield before[0], now[0], before[1], now[1]
        if now == [n, n]:
            return
        before = now


_TOKENS = ("a", "a_ends", "b", "b_ends")
_FRAGMENT = [("ok", T.BooleanType(), pa.bool_()), ("n_a", T.LongType(), pa.int64()), ("n_b", T.LongType(), pa.int64()), ("closed", T.BooleanType(), pa.bool_()), ("groups", T.StringType(), pa.string()), ("n_groups", T.LongType(), pa.int64()), ("links", T.BinaryType(), pa.binary())]
_FRAGMENT += [(f"{end}_{c}", T.BinaryType(), pa.binary()) for end in ("prefix", "suffix") for c in _TOKENS]


def _packed(f: Fragment | None, n_a: int, n_b: int) -> tuple:
    if f is None:
        return False, 0, 0, False, "", 0, b"", *[b""] * 8
    return True, n_a, n_b, f.closed, f.groups, f.n_groups, f.links.tobytes(), *(getattr(t, c).tobytes() for t in (f.prefix, f.suffix) for c in _TOKENS)


def _unpacked(row: tuple) -> Fragment:
    _, _, _, closed, groups, n_groups, links, *ends = row
    ends = [np.frombuffer(x, dtype="<u4" if k % 2 == 0 else "<i8") for k, x in enumerate(ends)]
    return Fragment(Tokens(*ends[:4]), closed, groups, n_groups, np.frombuffer(links, dtype="<u8"), Tokens(*ends[4:]))


def _batch(rows: list[tuple], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])


def _sized(rows: Iterator[tuple], types: list) -> Iterator[pa.RecordBatch]:
    """Batches of a few megabytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if size > BATCH or len(out) >= 4096:
            yield _batch(out, types)
            out, size = [], 0
    if out:
        yield _batch(out, types)


class Aligner:
    """files: the JSON file of A, its vocabulary as ranks or None, the model file of B."""

    def __init__(self, files: tuple[str, str | None, str] | None = None, chunk: int = CHUNK):
        if files is None:
            import public_tokenizers

            files = (*default_files(), public_tokenizers.path("piece_bpe_32k.model"))
        self.files, self.chunk = files, chunk

    def align(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """One row a document: id, n_a, n_b, n_groups, groups (as text), links (little-endian 64-bit: A's id above B's 32 bits)."""
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
        size = F.coalesce(F.length("body"), F.lit(0))
        return self._short(rows.where(size <= self.chunk)).unionByName(self._long(rows.where(size > self.chunk)))

    def _shape(self, docs: DataFrame, columns: list) -> tuple[T.StructType, list]:
        kind = docs.schema["id"].dataType
        from pyspark.sql.pandas.types import to_arrow_type

        return T.StructType([T.StructField("id", kind), *(T.StructField(n, t) for n, t, _ in columns)]), [("id", to_arrow_type(kind)), *((n, p) for n, _, p in columns)]

    _RESULT = [("n_a", T.LongType(), pa.int64()), ("n_b", T.LongType(), pa.int64()), ("n_groups", T.LongType(), pa.int64()), ("groups", T.StringType(), pa.string()), ("links", T.BinaryType(), pa.binary())]

    def _short(self, rows: DataFrame) -> DataFrame:
        files = self.files
        shape, types = self._shape(rows, self._RESULT)

        def run(batches):
            both = sides(*files)

            def each():
                for batch in batches:
                    for who, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        body = body.as_py()
                        t = tokens(both, " " + body, " " + body) if body else None
                        if t is None:
                            yield who, 0, 0, 0, "", b""
                        else:
                            groups, n, links = finished(fragment(t))
                            yield who, len(t.a), len(t.b), n, groups, links.tobytes()

            yield from _sized(each(), types)

        return rows.mapInArrow(run, shape)

    def _long(self, rows: DataFrame) -> DataFrame:
        files, chunk = self.files, self.chunk
        piece = [("who", T.LongType(), pa.int64()), ("seq", T.LongType(), pa.int64()), ("body", T.StringType(), pa.string()), *((c, T.LongType(), pa.int64()) for c in ("a_from", "a_to", "b_from", "b_to", "a_at", "b_at"))]
        shape, types = self._shape(rows, piece)

        def cut(batches):
            both = sides(*files)

            def each():
                for batch in batches:
                    for who, body, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                        whole, a_at, b_at = " " + body.as_py(), 0, 0
                        for seq, (a0, a1, b0, b1) in enumerate(ranges(both, whole, chunk)):
                            low, high = min(a0, b0), max(a1, b1)
                            yield who, number, seq, whole[low:high], a0 - low, a1 - low, b0 - low, b1 - low, a_at, b_at
                            a_at += len(whole[a0:a1].encode())
                            b_at += len(whole[b0:b1].encode())

            yield from _sized(each(), types)

        pieces = written(rows.withColumn("number", F.monotonically_increasing_id()).mapInArrow(cut, shape))
        most = pieces.agg(F.max("seq")).first()[0]
        who = [("who", T.LongType(), pa.int64()), ("seq", T.LongType(), pa.int64())]
        whole, whole_types = self._shape(rows, who + _FRAGMENT)

        def tell(batches):
            both = sides(*files)

            def each():
                for batch in batches:
                    for row in batch.to_pylist():
                        body = row["body"]
                        t = tokens(both, body[row["a_from"] : row["a_to"]], body[row["b_from"] : row["b_to"]], row["a_at"], row["b_at"], row["seq"] == 0)
                        yield row["id"], row["who"], row["seq"], *(_packed(None, 0, 0) if t is None else _packed(fragment(t), len(t.a), len(t.b)))

            yield from _sized(each(), whole_types)

        def join(group: pa.Table) -> pa.Table:
            own = sorted((tuple(r.values()) for r in group.to_pylist()), key=lambda r: r[2])
            total = _packed(None, 0, 0)
            if all(r[3] for r in own):
                f = _unpacked(own[0][3:])
                for r in own[1:]:
                    f = compose(f, _unpacked(r[3:]))
                total = _packed(f, sum(r[4] for r in own), sum(r[5] for r in own))
            return pa.Table.from_batches([_batch([(own[0][0], own[0][1], own[0][2] // FAN, *total)], whole_types)])

        found = pieces.repartition("who", "seq").mapInArrow(tell, whole)
        while most:
            found = found.groupBy("who", F.floor(F.col("seq") / FAN).alias("part")).applyInArrow(join, whole)
            most //= FAN
        shape, types = self._shape(rows, self._RESULT)

        def end(batches):
            def each():
                for batch in batches:
                    for row in batch.to_pylist():
                        own = tuple(row.values())
                        if row["ok"]:
                            groups, n, links = finished(_unpacked(own[3:]))
                            yield row["id"], row["n_a"], row["n_b"], n, groups, links.tobytes()
                        else:
                            yield row["id"], 0, 0, 0, "", b""

            yield from _sized(each(), types)

        return found.mapInArrow(end, shape)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair (A's id above B's 32 bits), n: how many links of all documents hold it."""

    def run(batches):
        held: np.ndarray = _none("<u8")
        counts: np.ndarray = _none("<i8")

        def merged(new):
            pairs, n = np.unique(new, return_counts=True)
            both = np.concatenate((held, pairs))
            values, at = np.unique(both, return_inverse=True)
            return values, np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(values)).astype("<i8")

        for batch in batches:
            new = np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), dtype="<u8")
            held, counts = merged(new)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held.astype("<i8")), pa.array(counts)], names=["pair", "n"])
                held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype("<i8")), pa.array(counts)], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame) -> DataFrame:
    """aligned with n_links, n_best (links whose pair is counted most of its B id's pairs, ties included) and count_sum (of counts over links), without links.

    Pairs with at least a share 1 / HOT of all links, at most HOT of them, are sent
    to every task; no other pair is a hot key, and these are joined.
    """
    aligned = written(aligned.withColumn("who", F.monotonically_increasing_id()))
    pairs = written(count_pairs(aligned))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    known = written(pairs.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * HOT >= total
    hot = sorted(tuple(r) for r in known.where(often).collect())  # at most HOT rows: their counts add up to no more than all
    keys, ns, best = (np.array([r[k] for r in hot], dtype="<i8") for k in range(3))

    def run(batches):
        for batch in batches:
            who, n_links, hot_best, hot_sum, pair, times = [], [], [], [], [], []
            for number, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, count = np.unique(np.frombuffer(links or b"", dtype="<i8"), return_counts=True)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                is_hot = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
                who.append(number)
                n_links.append(int(count.sum()))
                hot_best.append(int((best[at[is_hot]] * count[is_hot]).sum()))
                hot_sum.append(int((ns[at[is_hot]] * count[is_hot]).sum()))
                pair.append(own[~is_hot])
                times.append(count[~is_hot])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_links, hot_best, hot_sum)), *(pa.array(x, pa.list_(pa.int64())) for x in (pair, times))], names=["who", "n_links", "hot_best", "hot_sum", "pairs", "times"])

    told = written(aligned.select("who", "links").mapInArrow(run, "who long, n_links long, hot_best long, hot_sum long, pairs array<long>, times array<long>"))
    rare = told.select("who", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("who", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(known.where(~often), "pair").groupBy("who").agg(F.sum(F.col("times") * F.col("best")).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    added = lambda x: (F.col(f"hot_{x}") + F.coalesce(f"rare_{x}", F.lit(0))).alias({"best": "n_best", "sum": "count_sum"}[x])
    sums = told.drop("pairs", "times").join(rare, "who", "left").select("who", "n_links", added("best"), added("sum"))
    drop(pairs)
    return aligned.drop("links").join(sums, "who").drop("who")
