"""Mixing sources to target token counts by entropy balancing.

A document may be taken 0 to ``most`` times. Of all rates that give each source
its target, those nearest in (bounded) entropy to taking every document once are
tilted exponentially by size: rate = most * sigmoid(lambda * size / mean +
offset). Newton steps, safeguarded by a bracket, solve the convex dual for each
source's lambda at once; each step is one aggregation over counts by source and
size, summed in whole thousandths so that reruns agree to the last bit.

Rates become whole copies by systematic rounding in strata of like size: within
a stratum, ordered by size, the copies of any stretch differ from its summed
rates by less than one. What a source still lacks or has too much is then made up
with a few documents of each power of two of sizes, that of the nearest size first.

Sources are ranked by code point, null last, and weigh as ``weights`` says,
repeating. Their totals and targets are held by the driver: sources are things a
person gives weights to. Null texts have size 0. Repeated rows count each, and
null ids are ids like others. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import written
from marlstone.llm.text import words

#: Documents of a stratum, about.
STRATUM = 4096
#: Sources up to which a table of them is broadcast; beyond, it is joined by exchange.
BROADCAST = 10_000
THOUSANDTHS = 1000
#: Documents of a power of two of sizes that may be moved by a copy, by source.
PICKS = 6


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target), ranked; a target stops at most times its size, and the excess is shared anew by weight."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(ranked))]
    out = [0.0] * len(ranked)
    left, active = budget * sum(n for _, n in ranked), set(range(len(ranked)))
    while active:
        unit = left / sum(weight[k] for k in active)
        above = {k for k in active if unit * weight[k] > most * ranked[k][1]}
        for k in above or active:
            out[k] = float(most * ranked[k][1] if above else unit * weight[k])
            left -= out[k]
        if not above:
            break
        active -= above
    return [(s, n, t) for (s, n), t in zip(ranked, out, strict=True)]


class Mixer:
    def __init__(self, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2):
        self.text, self.key, self.source = text, key, source
        self.weights, self.budget, self.most = weights, budget, most

    def _with(self, rows: DataFrame, params: list[tuple], shape: str) -> DataFrame:
        """rows with the columns of params, which are led by the source."""
        table = rows.sparkSession.createDataFrame(params, shape)
        if len(params) <= BROADCAST:
            table = F.broadcast(table)
        return rows.join(table, rows["source"].eqNullSafe(table["of"])).drop("of")

    def _solve(self, sizes: DataFrame, ranked: list[tuple[str | None, int, float]], rounds: int = 60) -> list[float]:
        """lambda of each source; infinite where its target takes all it may."""
        offset = -math.log(self.most - 1) if self.most > 1 else 0.0
        counts = dict.fromkeys(range(len(ranked)), 0)
        at = {s: k for k, (s, _, _) in enumerate(ranked)}
        for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect():
            counts[at[r["source"]]] = r["n"]
        mean = [max(1.0, n / max(1, counts[k])) for k, (_, n, _) in enumerate(ranked)]
        value = [math.inf if t >= self.most * n else (-math.inf if t <= 0 else 0.0) for _, n, t in ranked]
        low, high = [-math.inf] * len(ranked), [math.inf] * len(ranked)
        open_ = {k for k in range(len(ranked)) if math.isfinite(value[k])}
        x = F.col("size") / F.col("mean")
        rate = self.most / (1 + F.exp(-(F.col("value") * x + offset)))
        thousandths = lambda c: F.sum(F.round(F.col("n") * c * THOUSANDTHS).cast("bigint"))
        for _ in range(rounds):
            if not open_:
                break
            step = self._with(sizes, [(ranked[k][0], k, mean[k], value[k]) for k in sorted(open_)], "of string, k int, mean double, value double")
            sums = step.groupBy("k").agg(thousandths(F.col("size") * rate).alias("f"), thousandths(F.col("size") * x * rate * (1 - rate / self.most)).alias("slope"))
            for r in sums.collect():
                k, target = r["k"], ranked[r["k"]][2]
                miss = r["f"] / THOUSANDTHS - target
                if abs(miss) <= 1e-6 * target + 0.01:
                    open_.discard(k)
                    continue
                if miss > 0:
                    high[k] = value[k]
                else:
                    low[k] = value[k]
                new = value[k] - miss / (r["slope"] / THOUSANDTHS) if r["slope"] > 0 else math.nan
                if not low[k] < new < high[k] or abs(new - value[k]) > 20:
                    new = (low[k] + high[k]) / 2 if math.isfinite(low[k]) and math.isfinite(high[k]) else value[k] - math.copysign(max(1.0, abs(value[k])), miss)
                if new == value[k] or abs(new) > 1e6:
                    open_.discard(k)
                value[k] = new
        return value

    def mix(self, docs: DataFrame) -> DataFrame:
        """One row per row: id, body (a hash of the text), row, size, source_size, target, rate, copies, taken."""
        body = F.xxhash64(self.text)
        rows = docs.select(F.col(self.key).alias("id"), F.col(self.source).cast("string").alias("source"), body.alias("body"), F.size(words(F.col(self.text))).cast("long").alias("size"))
        rows = written(rows.withColumn("mark", F.xxhash64(F.struct("id"), "body")).withColumn("row", F.monotonically_increasing_id()))
        sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
        totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()
        ranked = targets([(r["source"], r["size"]) for r in totals], self.weights, self.budget, self.most)
        values = self._solve(sizes, ranked)
        n = {r["source"]: r["n"] for r in totals}
        clip = lambda v: max(-1e9, min(1e9, v))
        params = [(s, size, t, max(1.0, size / n[s]), clip(v), -(-n[s] // STRATUM), math.isinf(v)) for (s, size, t), v in zip(ranked, values, strict=True)]
        if not params:
            params = [(None, 0, 0.0, 1.0, 0.0, 1, False)]
        rows = self._with(rows, params, "of string, source_size long, target double, mean double, value double, strata long, edge boolean")
        offset = -math.log(self.most - 1) if self.most > 1 else 0.0
        smooth = self.most / (1 + F.exp(-(F.col("value") * F.col("size") / F.col("mean") + offset)))
        rows = rows.withColumn("rate", F.when(F.col("edge"), F.when(F.col("value") > 0, float(self.most)).otherwise(0.0)).otherwise(smooth))
        rows = rows.withColumn("stratum", F.pmod("mark", "strata"))
        whole = F.floor("rate")
        part = F.round(F.col("rate") - whole, 9)
        order = Window.partitionBy("source", "stratum").orderBy("size", "mark", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # whole billionths, so that sums are exact in any order
        summed = F.sum(F.round(part * 1_000_000_000).cast("bigint")).over(order)
        start = F.pmod(F.xxhash64("source", "stratum"), F.lit(1_000_000_000))
        rows = rows.withColumn("part", F.round(part * 1_000_000_000).cast("bigint")).withColumn("sum", summed + start)
        up = F.floor(F.col("sum") / 1_000_000_000) - F.floor((F.col("sum") - F.col("part")) / 1_000_000_000)
        rows = written(rows.withColumn("copies", (whole + up).cast("long")).select("id", "body", "row", "mark", "source", "size", "source_size", "target", "rate", "copies"))
        return self._made_up(rows).select("id", "body", "row", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))

    def _made_up(self, rows: DataFrame) -> DataFrame:
        """Copies moved by one for a few documents, so that sources meet their targets."""
        bins = rows.where("size > 0").groupBy("source", F.floor(F.log2("size")).alias("bin"))
        pick = lambda ok, k: F.min(F.when(ok, F.struct(F.xxhash64(F.lit(k), "mark").alias("h"), "row", "size")))
        more, less = F.col("copies") < self.most, F.col("copies") > 0
        found = bins.agg(*(pick(ok, k).alias(f"{name}{k}") for name, ok in (("more", more), ("less", less)) for k in range(PICKS))).collect()  # powers of two of sizes, by source
        taken = rows.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
        by_source: dict = {}
        for y in found:
            by_source.setdefault(y["source"], []).append(y)
        moves = []
        for r in taken:
            lack, own = r["target"] - r["taken"], {}
            for name in ("more", "less"):
                own[name] = {x["row"]: x for y in by_source.get(r["source"], ()) for k in range(PICKS) if (x := y[f"{name}{k}"])}
            while True:  # each move brings the source nearer, to and fro, and no document is moved twice
                sign, name = (1, "more") if lack > 0 else (-1, "less")
                near = [x for x in own[name].values() if x["size"] < 2 * abs(lack)]
                if not near:
                    break
                x = min(near, key=lambda x: (abs(abs(lack) - x["size"]), x["h"]))
                lack -= sign * x["size"]
                moves.append((x["row"], sign))
                for side in own.values():
                    side.pop(x["row"], None)
        if not moves:
            return rows
        # a few documents of each power of two of sizes by source: a bounded table, checked as the table of sources is
        table = rows.sparkSession.createDataFrame(moves, "row long, move long")
        table = F.broadcast(table) if len(moves) <= BROADCAST else table
        return rows.join(table, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move")

    def copies(self, docs: DataFrame) -> DataFrame:
        """The rows of docs, each as often as it is taken."""
        taken = self.mix(docs).groupBy(F.struct(F.col("id").alias(self.key)).alias("who"), "body").agg(F.sum("copies").alias("copies")).where("copies > 0")
        rows = docs.select(F.struct("*").alias("doc"), F.struct(F.col(self.key)).alias("who"), F.xxhash64(self.text).alias("body"))
        # the first of repeated rows stands for all
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("who", "body").orderBy(F.lit(0)))).where("copy = 1")
        return rows.join(taken, ["who", "body"]).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
