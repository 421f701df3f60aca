"""Nearest vectors by largest inner product, with vantage-point trees per shard.

A largest inner product is turned into a smallest distance: every vector of a shard gets
one more component that lifts it to the shard's largest norm M, a query gets a zero there,
and then the squared distance is |q|^2 + M^2 - 2 q.x. A tree node holds a vantage point and
splits its vectors at the median of their distances from it; each half keeps the least and
the largest of these distances. A half is skipped for a query when, by the triangle
inequality, none of its vectors can be among the best so far: ``factor`` times the bound on
their distance exceeds the distance of the k-th best. Factor 1 is exact search; a larger one
prunes more and may miss some.

Vectors are dealt to shards by a hash of vec_id, and one row a shard holds its tree, written
to the shared folder. Queries are dealt to blocks; each block meets each shard in one task,
where all its queries go down the tree together as matrix products. Each task gives k rows a
query, cut to k again before and after the exchange that ranks them.

Every candidate that a product of matrices puts within rounding of the k-th best is scored
again by one sum over the original components in one order, so equal vectors have equal
scores whichever task finds them, and ties go to the smaller vec_id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without vec_id, take no part; vectors are compared with those of their own length only;
of several vectors under one vec_id the least counts; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stage
from quern.llm.vectors import matrix

K = 20
FACTOR = 4.0  # of neighbours in even data of 64 components about one in a thousand is missed
SHARDS = 8  # up to 8 * MOST vectors; more shards beyond that
MOST = 65_536  # vectors of a shard, on average
QUERIES = 8_192  # of a block
LEAF = 64
TRIED = 8  # vantage points that are tried for a node, by the spread of their distances
SEED = 5
EVERY = 20

TREE = "size int, shard int, ids binary, vectors binary, lift binary, nodes binary"
HITS = "query_id long, vec_id long, score double"

#: A node: its vectors are rows lo to hi of the shard; halves are nodes (0: none, it is a leaf) with the range of their distances from the vantage point.
NODE = np.dtype([("lo", "i4"), ("hi", "i4"), ("vantage", "i4"), ("near", "i4"), ("far", "i4"), ("near_lo", "f8"), ("near_hi", "f8"), ("far_lo", "f8"), ("far_hi", "f8")])


def distances(x: np.ndarray, squares: np.ndarray, y: np.ndarray, y_squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares[:, None] + y_squares - 2 * (x @ y.T), 0))


def grow(x: np.ndarray, squares: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the vectors, nodes) of the tree over lifted vectors."""
    order, nodes, rng = np.arange(len(x)), [], np.random.default_rng(SEED)

    def node(lo: int, hi: int) -> int:
        at = len(nodes)
        nodes.append((lo, hi, -1, 0, 0, 0.0, 0.0, 0.0, 0.0))
        if hi - lo <= leaf:
            return at
        here = order[lo:hi]
        tried, some = rng.choice(here, min(TRIED, len(here)), replace=False), rng.choice(here, min(256, len(here)), replace=False)
        spread = distances(x[tried], squares[tried], x[some], squares[some]).var(1)
        vantage = int(tried[spread.argmax()])
        d = distances(x[here], squares[here], x[[vantage]], squares[[vantage]])[:, 0]
        by = np.argsort(d, kind="stable")
        order[lo:hi], d = here[by], d[by]
        half = (hi - lo) // 2
        near, far = node(lo, lo + half), node(lo + half, hi)
        nodes[at] = (lo, hi, vantage, near, far, d[0], d[half - 1], d[half], d[-1])
        return at

    node(0, len(x))
    place = np.empty(len(x), np.int64)  # vantage points are named by their place in the order
    place[order] = np.arange(len(x))
    grown = np.array(nodes, NODE)
    inner = grown["near"] > 0
    grown["vantage"][inner] = place[grown["vantage"][inner]]
    return order, grown


def plant(leaf: int):
    def build(group: pa.Table) -> pa.Table:
        """The tree of one shard (size, shard, id, v) as a row."""
        group = group.sort_by("id")
        ids, v = group.column("id").to_numpy(), matrix(group.column("v"))
        norms = np.einsum("ij,ij->i", v, v)
        lift = np.sqrt(norms.max() - norms)
        order, nodes = grow(np.column_stack([v, lift]), np.full(len(v), norms.max()), leaf)
        row = [group.column("size")[0].as_py(), group.column("shard")[0].as_py(), ids[order].tobytes(), v[order].tobytes(), lift[order].tobytes(), nodes.tobytes()]
        return pa.table([pa.array([c], t) for c, t in zip(row, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=[c.split()[0] for c in TREE.split(", ")])

    return build


class Best:
    """The k best scores of each query so far, for pruning, and all that were seen near them."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, at: int, slack: np.ndarray) -> None:
        """Scores of queries ``rows`` against the vectors x, which start at place ``at`` of the shard."""
        scores = self.queries[rows] @ x.T
        scores[self.own[rows][:, None] == ids] = -np.inf
        both = np.concatenate([self.scores[rows], scores], axis=1)
        self.scores[rows] = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        least = self.scores[rows].min(1) - slack[rows]
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.found.append((rows[r], c + at, scores[r, c]))


def descend(nodes: np.ndarray, v: np.ndarray, lift: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the k best vectors of a shard for each query, by score and then id."""
    top = float(np.einsum("ij,ij->i", v, v).max())
    squares = np.einsum("ij,ij->i", queries, queries)
    slack = 1e-12 * np.sqrt(squares * top)  # of a score, for rounding
    best = Best(queries, own, k)
    margin = 1e-6 * np.sqrt(squares + top)  # of a distance, which loses digits near zero

    def from_vantage(node: np.void, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[rows] + top - 2 * (queries[rows] @ v[node["vantage"]]), 0))

    # each query's own leaf first, so that what follows is held against good scores
    home, open_ = np.empty(len(queries), np.int32), [(0, np.arange(len(queries)))]
    while open_:
        at, rows = open_.pop()
        node = nodes[at]
        if not node["near"]:
            home[rows] = at
            best.add(rows, v[node["lo"] : node["hi"]], ids[node["lo"] : node["hi"]], node["lo"], slack)
            continue
        near = from_vantage(node, rows) <= (node["near_hi"] + node["far_lo"]) / 2
        open_ += [(child, part) for child, part in ((node["near"], rows[near]), (node["far"], rows[~near])) if len(part)]
    open_ = [(0, np.arange(len(queries)))]
    while open_:
        at, rows = open_.pop()
        node = nodes[at]
        if not node["near"]:
            rows = rows[home[rows] != at]
            if len(rows):
                best.add(rows, v[node["lo"] : node["hi"]], ids[node["lo"] : node["hi"]], node["lo"], slack)
            continue
        d = from_vantage(node, rows)
        reach = np.sqrt(np.maximum(squares[rows] + top - 2 * best.scores[rows].min(1), 0))  # infinite while fewer than k are known
        for child, lo, hi in ((node["far"], node["far_lo"], node["far_hi"]), (node["near"], node["near_lo"], node["near_hi"])):
            bound = np.maximum(np.maximum(d - hi, lo - d), 0)
            part = rows[factor * (bound - margin[rows]) <= reach]
            if len(part):
                open_.append((int(child), part))
    q, place, score = (np.concatenate(c) for c in zip(*best.found, strict=True))
    near = score >= best.scores.min(1)[q] - slack[q]
    q, place = q[near], place[near]
    exact = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.einsum("ij,ij->i", queries[q[part]], v[place[part]])
    by = np.lexsort((ids[place], -exact, q))
    q, place, exact = q[by], place[by], exact[by]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], place[rank < k], exact[rank < k]


def searcher(k: int, factor: float):
    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        """The hits of one block of queries (id, v) in one shard."""
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        if not (trees.num_rows and queries.num_rows):
            return empty
        row = {c: trees.column(c)[0].as_py() for c in ("ids", "vectors", "lift", "nodes")}
        ids, lift = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lift"], np.float64)
        v, own = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), queries.column("id").to_numpy()
        q, place, score = descend(np.frombuffer(row["nodes"], NODE), v, lift, ids, matrix(queries.column("v")), own, k, factor)
        return pa.table({"query_id": own[q], "vec_id": ids[place], "score": score})

    return search


def usable(table: DataFrame) -> DataFrame:
    """(id, v, size): the vectors that take part, one for each vec_id."""
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(whole & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))


def build_trees(vectors: DataFrame, n: int, leaf: int = LEAF) -> DataFrame:
    """One row (TREE) for each shard of vectors (id, v, size), of which there are n, in the shared folder."""
    shards = max(SHARDS, -(-n // MOST))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return stage(dealt.groupBy("size", "shard").applyInArrow(plant(leaf), TREE), "trees")


def search_trees(trees: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of all shards for each query (id, v, size)."""
    blocks = -(-max(queries.count(), 1) // QUERIES)
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int"))
    shards = trees.select(F.col("size").alias("of"), F.col("shard").alias("at"))  # one small row a shard
    met = asked.join(F.broadcast(shards), F.col("size") == F.col("of")).select("size", F.col("at").alias("shard"), "block", "id", "v")
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["size", "shard", "block"]
    hits = sent.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(searcher(k, factor), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int = EVERY, k: int = K, factor: float = FACTOR) -> DataFrame:
    """The k nearest vectors to each row of table (vec_id, embedding) whose vec_id is divisible by ``every``."""
    vectors = stage(usable(table), "tree-vectors")
    return search_trees(build_trees(vectors, vectors.count()), vectors.where(F.col("id") % every == 0), k, factor)


def op11_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to each whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
