"""Neighbours by cosine over a partitioned vector index.

Vectors, divided by their lengths, are dealt to the cells of centroids that a few rounds
of k-means learn over all rows: each partition sends one sum a cell, so the driver holds
the centroids and nothing that grows with the rows. A search compares each query with the
``probes`` nearest cells. To be exact it goes on: a vector of a cell is at least the
distance of query and centroid less the cell's radius away, so every other cell for which
that bound is below the distance of the n-th best so far is compared too.

A cell is compared in parts of at most about ``PART`` vectors with blocks of about
``BLOCK`` queries, as products of matrices, and each such task sends on n rows a query.
Pairs are neither written out nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import staged

CELL = 512  # vectors of a cell, about
MOST_CELLS = 1024
ROUNDS = 3
PROBES = 4
PART = 4096
BLOCK = 8192
ROUNDING = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sane(vectors: DataFrame, id_: str, vector: str, key: str | None) -> DataFrame:
    """(id, v, key) of vectors that have a direction; rows that are null, zero or not finite have none."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v"), (F.col(key).cast("string") if key else F.lit("")).alias("key")).where(whole & F.col("id").isNotNull())


def gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from centroids."""
    return np.sqrt(np.maximum(1 + (centroids**2).sum(1) - 2 * (x @ centroids.T), 0))


def cell_sums(centroids: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, n, total) of a partition."""
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(matrix(batch.column(0)))
                cell = gaps(x, centroids).argmin(1)
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(centroids))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

    return add


def learn(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (one row a cell) of all vectors (id, v), from vectors chosen by a hash of their ids."""
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").toArrow()  # at most MOST_CELLS rows
    centroids = unit_rows(matrix(first.column("v")))
    for _ in range(rounds if len(centroids) > 1 else 0):
        sums = vectors.select("v").mapInArrow(cell_sums(centroids), "cell long, n long, total array<double>")
        summed = sums.select("cell", "n", F.posexplode("total").alias("place", "t")).groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        for r in summed.collect():  # cells times components
            centroids[r["cell"], r["place"]] = r["t"] / r["n"]
    return centroids


def dealing(centroids: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its cell and its distance from the centroid."""
        for batch in batches:
            if batch.num_rows:
                d = gaps(unit_rows(matrix(batch.column(1))), centroids)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "gap"])

    return deal


def reaching(centroids: np.ndarray, radius: np.ndarray, probes: int, beyond: bool):
    """mapInArrow function from queries (id, v, key, far) to one row a cell: the nearest cells, or those beyond them that reach within ``far``."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = gaps(unit_rows(matrix(batch.column(1))), centroids)
            place = d.argsort(1, kind="stable").argsort(1, kind="stable")
            hit = (place >= probes) & (d - radius <= batch.column(3).to_numpy()[:, None] + 1e-6) if beyond else place < probes
            q, cell = np.nonzero(hit)
            taken = batch.take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(cell.astype(np.int32))], names=["id", "v", "key", "cell"])

    return reach


def comparing(n: int):
    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        """The n best of a part of a cell for each query of a block, by rounded cosine and then id; equal ids are no neighbours."""
        out: list[list[np.ndarray]] = [[], [], []]
        if held.num_rows and asked.num_rows:
            ids, x, key = held.column("id").to_numpy(), unit_rows(matrix(held.column("v"))), np.array(held.column("key").to_pylist(), object)
            qids, q, qkey = asked.column("id").to_numpy(), unit_rows(matrix(asked.column("v"))), np.array(asked.column("key").to_pylist(), object)
            for at in range(0, len(qids), 1024):
                part = slice(at, at + 1024)
                exact = q[part] @ x.T
                s = np.round(exact, 9)
                s[(qids[part][:, None] == ids) | (qkey[part][:, None] != key)] = -np.inf
                least = -np.partition(-s, min(n, s.shape[1]) - 1, axis=1)[:, min(n, s.shape[1]) - 1]
                r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((ids[c], -s[r, c], r))
                r, c = r[order], c[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < n
                r, c = r[first], c[first]
                for column, values in zip(out, (qids[part][r], ids[c], exact[r, c]), strict=True):
                    column.append(values)
        return pa.table({name: pa.array(np.concatenate(c) if c else [], kind) for name, c, kind in zip(("query", "vec_id", "similarity"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return compare


@dataclass(frozen=True)
class VectorIndex:
    """Vectors by cell (id, v, key, cell, part), the centroids and the cells' radii and parts."""

    held: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    parts: DataFrame

    def _best(self, asked: DataFrame, n: int, blocks: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
        asked = asked.join(self.parts.select(F.col("cell").alias("of"), "parts"), F.col("cell") == F.col("of")).select("id", "v", "key", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block)
        held = self.held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        at = ["cell", "part", "block"]
        return held.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(comparing(n), "query long, vec_id long, similarity double")

    def search(self, queries: DataFrame, n: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(query, vec_id, similarity, rank): the n nearest of its key to each query (id, v, key), exact or of the probed cells only."""
        w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
        cut = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        if not len(self.centroids):
            return queries.sparkSession.createDataFrame([], "query long, vec_id long, similarity double, rank int")
        cells = "id long, v array<double>, key string, cell int"
        blocks = max(1, -(-queries.count() // BLOCK))
        near = queries.select("id", "v", "key", F.lit(0.0).alias("far")).mapInArrow(reaching(self.centroids, self.radius, probes, False), cells)
        best = cut(self._best(near, n, blocks))
        if not exact or len(self.centroids) <= probes:
            return best
        best = staged(best, "vector-probed")
        # without n neighbours so far every cell is in reach; a cosine of s is a distance of sqrt(2 - 2 s)
        far = best.where(F.col("rank") == n).select(F.col("query").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("similarity") + 4 * ROUNDING, F.lit(0.0))).alias("far"))
        open_ = queries.select("id", "v", "key").join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(2.0)))
        rest = open_.mapInArrow(reaching(self.centroids, self.radius, probes, True), cells)
        return cut(best.drop("rank").unionByName(self._best(rest, n, blocks)))


def build(vectors: DataFrame, cell: int = CELL) -> VectorIndex:
    """The index of vectors (id, v, key) of one length."""
    vectors = staged(vectors, "vectors")
    n = vectors.count()
    centroids = learn(vectors, max(1, min(MOST_CELLS, n // cell))) if n else np.zeros((0, 0))
    dealt = vectors.mapInArrow(dealing(centroids), "id long, v array<double>, key string, cell int, gap double") if n else vectors.withColumns({"cell": F.lit(0), "gap": F.lit(0.0)})
    dealt = staged(dealt, "vector-cells")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    radius = np.zeros(len(centroids))
    for r in sizes.collect():  # one row a cell
        radius[r["cell"]] = r["radius"]
    parts = sizes.select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    held = dealt.join(F.broadcast(parts), "cell").select("id", "v", "key", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    return VectorIndex(held, centroids, radius, F.broadcast(parts))
