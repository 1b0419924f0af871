"""Exact nearest neighbours by an inverted file: cells of near vectors, rings within a cell, and bounds that tell which ones can hold a hit.

A coarse quantiser is fitted on a bounded sample and every row is filed under its
nearest centre. A row at radius r from its centre is no nearer to a query at
distance D from that centre than |D - r|, so a query first reads its nearest
cells and then only the rings that may hold something nearer than its k-th hit.
The answer is that of a scan of all rows, whatever the sample gave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.retrieval import BLOCK_QUERIES, BLOCK_ROWS, best_of, nearest_in_cells
from marlstone.session import stored

#: Rows that centres are fitted on, numbers of them all, cells and rings of a cell at most, rows that a ring has on average at least, and rounds of fitting.
SAMPLE, SAMPLE_NUMBERS, CELLS, RINGS, RING_ROWS, ROUNDS = 20_000, 1 << 25, 1024, 16, 1024, 12
#: Numbers that a task holds at once of what its rows, or its queries with the vectors it sends to rings, are to centres.
HELD = 1 << 20


def centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from random rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    own = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(ROUNDS):
        near = distances(sample, own).argmin(axis=1)
        n = np.bincount(near, minlength=len(own))
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        own = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], own)
    return own


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of all rows to all others."""
    squares = (rows**2).sum(axis=1)[:, None] + (to**2).sum(axis=1)[None] - 2 * rows @ to.T
    return np.sqrt(np.maximum(squares, 0))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def slices(batches, rows: int):
    """Batches of so many rows at most."""
    for batch in batches:
        for start in range(0, len(batch), max(1, rows)):
            yield batch.slice(start, max(1, rows))


class CellIndex:
    """Rows filed by cell and ring. Rows with null or empty vectors are in no cell, as nothing is near them; vectors have one length."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE):
        self.key, self.vector = key, vector
        rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.size("v") > 0)
        n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        self.n_rows = n
        wanted = min(cells or CELLS, max(1, round(n**0.5)))
        some = rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, max(wanted, SAMPLE_NUMBERS // max(1, width or 1)))).select("v")
        fit = some.toPandas()["v"]  # at most SAMPLE rows
        self.centres = centres(np.stack([np.asarray(v, dtype=float) for v in fit]), wanted) if len(fit) else np.zeros((0, 1))
        middle = self.centres
        kind = rows.schema["id"].dataType.simpleString()

        def file(batches):
            for batch in slices(batches, HELD // max(1, len(middle))):
                if len(batch):
                    away = distances(_numbers(batch.column(1)), middle)
                    cell = away.argmin(axis=1)
                    radius = away[np.arange(len(cell)), cell]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(radius, pa.float64())], names=["id", "v", "cell", "radius"])

        filed = stored(rows.mapInArrow(file, f"id {kind}, v {rows.schema['v'].dataType.simpleString()}, cell int, radius double"))
        rings = min(RINGS, n // (RING_ROWS * max(1, len(middle))))
        ringed = filed.withColumn("ring", F.lit(0))
        if rings > 1:
            edges = filed.groupBy("cell").agg(F.percentile_approx("radius", [k / rings for k in range(1, rings)]).alias("edges"))  # one row a cell
            ring = F.size(F.filter("edges", lambda e: e < F.col("radius")))
            ringed = filed.join(F.broadcast(edges), "cell").withColumn("ring", ring).drop("edges")
        # a range of cell and radius is one file, so that statistics of files tell what to read; a hot cell takes several
        self.rows = stored(ringed.repartitionByRange("cell", "radius", "id").sortWithinPartitions("cell", "radius"))
        rings = self.rows.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        self.rings = sorted(tuple(r) for r in rings.collect())  # at most CELLS times RINGS rows

    def search(self, queries: DataFrame, k: int = 5, first: int = 2) -> DataFrame:
        """The k rows nearest to every query: query_id, key, distance2, rank. first: cells that are read for a start, more if they hold under k rows.

        Queries with null vectors get nothing; ties go to smaller keys.
        """
        asked = queries.select(F.col(self.key).alias("id"), F.col(self.vector).alias("v")).where(F.size("v") > 0)
        near = stored(self._probes(asked.withColumn("most", F.lit(None).cast("double")), k, first))
        found = stored(self._scan(near, k))
        kth = best_of(found, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance2"))).alias("most"))
        bounded = asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        rest = stored(self._probes(bounded.select("id", "v", "most"), k, first))
        self.read = [near, rest]
        return best_of(found.unionByName(self._scan(rest, k)), k).withColumnRenamed("id", self.key)

    def share_read(self, n_queries: int) -> float:
        """Of all pairs of a query and a row, the share whose distance the last search took."""
        sizes = self.rows.sparkSession.createDataFrame([(c, r, n) for c, r, n, *_ in self.rings], "cell int, ring int, n long")
        met = self.read[0].unionByName(self.read[1]).join(F.broadcast(sizes), ["cell", "ring"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return met / max(1, n_queries * self.n_rows)

    def _probes(self, asked: DataFrame, k: int, first: int) -> DataFrame:
        """Rings that a query reads. most is null: all of its nearest cells; a number: those of other cells that may hold a row no further than that."""
        middle, kind = self.centres, asked.schema["id"].dataType.simpleString()
        cell, ring, n, low, high = (np.array(c) for c in zip(*self.rings, strict=True)) if self.rings else (np.zeros(0),) * 5
        cell = cell.astype(int)
        held = np.bincount(cell, weights=n, minlength=len(middle))

        def run(batches):
            # a query's vector may go to every ring
            for batch in slices(batches, HELD // max(1, len(cell) * (middle.shape[1] + 1))):
                if not len(batch) or not len(middle):
                    continue
                away = distances(_numbers(batch.column(1)), middle)
                order = away.argsort(axis=1, kind="stable")
                # cells are taken until they hold k rows, and `first` of them at least
                before = np.cumsum(held[order], axis=1) - held[order]
                start = (before < k) | (np.arange(len(middle)) < first)
                opened = np.zeros_like(start)
                np.put_along_axis(opened, order, start, axis=1)
                most = np.array([np.nan if x is None else x for x in batch.column(2).to_pylist()])
                own = away[:, cell]
                gap = np.maximum(np.maximum(low - own, own - high), 0)
                reach = most[:, None] + 1e-9 * (1 + own + np.where(np.isfinite(most), most, 0)[:, None])
                take = np.where(np.isnan(most)[:, None], opened[:, cell], ~opened[:, cell] & (gap <= reach))
                q, r = np.nonzero(take)
                at = pa.array(q, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell[r], pa.int32()), pa.array(ring[r].astype(int), pa.int32())], names=["id", "v", "cell", "ring"])

        return asked.mapInArrow(run, f"id {kind}, v {asked.schema['v'].dataType.simpleString()}, cell int, ring int")

    def _scan(self, probes: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of every query among the rings it reads."""
        spark = probes.sparkSession
        sizes = {(c, r): n for c, r, n, *_ in self.rings}
        asked = probes.groupBy("cell", "ring").count().collect()  # one row a ring at most
        parts = [(c, r, -(-n // BLOCK_QUERIES), -(-sizes[c, r] // BLOCK_ROWS)) for c, r, n in asked]
        plan = F.broadcast(spark.createDataFrame(parts, "cell int, ring int, blocks int, shares int"))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        by_hash = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        some = probes.join(plan, ["cell", "ring"]).withColumn("block", by_hash("blocks")).withColumn("share", upto("shares"))
        cells = sorted({c for c, *_ in parts})
        rows = self.rows if len(cells) == len(self.centres) else self.rows.where(F.col("cell").isin(cells))
        told = rows.join(plan, ["cell", "ring"]).withColumn("share", by_hash("shares")).withColumn("block", upto("blocks"))
        return nearest_in_cells(some, told, ["cell", "ring", "block", "share"], k)
