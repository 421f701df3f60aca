"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is a chain of random hashes (signs of projections of the
vector less the mean of all); the vectors are ordered by that key, so similar ones
stand near each other, and each is compared with the next ``window`` in the order, by
cosine in double precision, across the borders of partitions too. Passes draw other
projections; the verified pairs of all passes are united.

How many passes: two vectors at the wanted cosine meet in a pass if their leading
log2(n / window) signs agree, so a first number of passes follows from the number of
vectors and from MISSED. Dense regions need more. So passes go on in halves while a half
still joins more than one in twenty of the components that it could, or while the vectors
that were linked in one pass only, against those in two, tell that more than UNSEEN of
the vectors that are hard to link (linked in a quarter of the passes or fewer) are linked
in none (Chao's estimate): easy pairs, linked in most passes, do not count there, so they
do not hide hard ones. At MOST_TIMES the first number the passes end.

The window bounds what a pass compares and not what is counted: inside each component
links are counted whole. Members so near to its mean that any two of them must be
linked (half the angle) count each other by one sum; what is left is compared in blocks
of matrix products. So a large group of near copies costs about its size, and no pair
is written out.

Defined cases: equal vectors are folded first and count as links of each other; vectors
are compared with those of their own length only; vectors that are null, empty, zero, or
hold null or non-finite components link with nothing and stay; so does a null vec_id;
rows that share a
vec_id but not a vector are one point for component_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stage
from quern.llm.components import connected

COSINE = 0.95
WINDOW = 16
BITS = 48
MISSED = 0.001  # share of pairs at the wanted cosine that may meet in no pass
LEAST_PASSES = 8
UNSEEN = 0.02  # share of the vectors that are hard to link that may be linked in no pass, by estimate
MOST_TIMES = 5
SEED = 11
BLOCK = 4096
SEAM = "a long, b long, part long, place int, size int, pass int, v array<{}>"


def passes_for(n: int, window: int = WINDOW, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Passes after which two vectors at this cosine have met but for a share of ``missed``."""
    bits = max(0.0, math.log2(max(n, 1) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return LEAST_PASSES if meet >= 1 else max(LEAST_PASSES, math.ceil(math.log(missed) / math.log(1 - meet)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def equal_runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows in which all the columns stay the same."""
    change = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]]).tolist()
    return ((i, j) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i)


def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of one length, as (place, total)."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = unit(matrix(batch.column(0))).sum(0)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "total"])


def keyed(first: int, passes: int, mean: np.ndarray):
    """Each vector once a pass: size, pass, code, id, v."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            order = np.argsort(sizes, kind="stable")
            batch, sizes = batch.take(pa.array(order)), sizes[order]
            for i, j in equal_runs(sizes):
                part = batch.slice(i, j - i)
                x = unit(matrix(part.column(1)))
                x = x - mean if x.shape[1] == len(mean) else x
                for p in range(first, first + passes):
                    planes = np.random.default_rng([SEED, x.shape[1], p]).standard_normal((x.shape[1], BITS))
                    codes = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = len(x)
                    columns = [pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(codes), part.column(0), part.column(1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "pass", "code", "id", "v"])

    return key


def links_of(ids: list[int], x: np.ndarray, window: int, cosine: float) -> tuple[list[int], list[int]]:
    """Links of neighbours in an order, thinned to one tree for each linked run; every linked id is in some link."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for step in range(1, min(window, len(ids) - 1) + 1):
        for i in np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= cosine).tolist():
            r, s = root(i), root(i + step)
            if r != s:
                parent[s] = r
                a.append(ids[i])
                b.append(ids[i + step])
    return a, b


def windows(window: int, cosine: float):
    """mapInArrow function over a sorted partition: its links, and its first and last rows for the seams."""

    def rows(kind, a=(), b=(), part=None, places=(), size=None, turn=None, v=None) -> pa.RecordBatch:
        n = max(len(a), len(places))
        none = lambda t: pa.nulls(n, t)
        columns = [
            pa.array(a, pa.int64()),
            pa.array(b, pa.int64()) if part is None else none(pa.int64()),
            none(pa.int64()) if part is None else pa.array([part] * n, pa.int64()),
            none(pa.int32()) if part is None else pa.array(places, pa.int32()),
            none(pa.int32()) if part is None else pa.array([size] * n, pa.int32()),
            pa.array([turn] * n, pa.int32()),
            none(kind) if part is None else v,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "part", "place", "size", "pass", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        kind, last_ids, last_x, last_v = None, [], None, None
        for batch in batches:
            for i, j in equal_runs(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                run = batch.slice(i, j - i)
                here = (run.column(0)[0].as_py(), run.column(1)[0].as_py())
                ids, x, v = run.column(3).to_pylist(), unit(matrix(run.column(4))), run.column(4)
                if seen < window:  # the first rows of the partition
                    n = min(window - seen, len(ids))
                    yield rows(v.type, ids[:n], part=part, places=list(range(seen, seen + n)), size=here[0], turn=here[1], v=v[:n])
                seen += len(ids)
                if kind == here:
                    ids, x, v = last_ids + ids, np.concatenate([last_x, x]), pa.concat_arrays([last_v, v])
                yield rows(v.type, *links_of(ids, x, window, cosine), turn=here[1])
                kind, last_ids, last_x, last_v = here, ids[-window:], x[-window:], v[-window:]
        if kind:
            n = len(last_ids)
            yield rows(last_v.type, last_ids, part=part, places=list(range(-n, 0)), size=kind[0], turn=kind[1], v=last_v)

    return compare


def seams(found: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links across the borders of partitions, from their first (place >= 0) and last rows."""
    edge = found.where("part is not null")
    order = Window.orderBy("part")  # one row a partition
    follows = edge.select("part").distinct().withColumn("border", F.row_number().over(order))
    edge = edge.join(F.broadcast(follows), "part").withColumn("border", F.col("border") + F.when(F.col("place") < 0, 1).otherwise(0))
    # a partition shorter than the window gives rows to both of its borders

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("place", "ascending")])
        a, b = links_of(group.column("a").to_pylist(), unit(matrix(group.column("v"))), window, cosine)
        turn = group.column("pass")[0].as_py()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "pass": pa.array([turn] * len(a), pa.int32())})

    return edge.groupBy("border", "size", "pass").applyInArrow(across, "a long, b long, pass int")


def half_links(folded: DataFrame, first: int, passes: int, mean: np.ndarray, window: int, cosine: float) -> DataFrame:
    """(a, b, pass): links found in these passes, each at least once."""
    kind = folded.schema["v"].dataType.elementType.simpleString()
    order = folded.select("id", "v").mapInArrow(keyed(first, passes, mean), f"size int, pass int, code long, id long, v array<{kind}>")
    ordered = order.repartitionByRange("size", "pass", "code", "id").sortWithinPartitions("size", "pass", "code", "id")
    found = stage(ordered.mapInArrow(windows(window, cosine), SEAM.format(kind)), "vector-pass")
    return found.where("part is null").select("a", "b", "pass").union(seams(found, window, cosine))


def unseen(seen: DataFrame, passes: int) -> tuple[float, int]:
    """Of vectors seen (id, pass) linked: how many more there are by Chao's estimate, and how many are hard to link."""
    often = seen.groupBy("id").agg(F.count("*").alias("n"))
    r = often.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if(F.col("n") <= max(2, passes // 4)).alias("hard")).first()
    return r["once"] * (r["once"] - 1) / (2 * (r["twice"] + 1)), r["hard"]


def counter(cosine: float):
    def count(group: pa.Table) -> pa.Table:
        """Weighted links between the two sides of one pair of blocks, in a block with itself each pair both ways; two members of the core are left out."""
        ids, side, same = group.column("id").to_numpy(), group.column("side").to_numpy(), group.column("same").to_numpy()
        x, n, core = unit(matrix(group.column("v"))), group.column("n").to_numpy(), group.column("core").to_numpy()
        out = np.zeros(len(ids), np.int64)
        rows, others = (np.arange(len(ids)),) * 2 if same[0] else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for at in range(0, len(rows), 1024):
            r = rows[at : at + 1024]
            hit = (x[r] @ x[others].T >= cosine) & ~(core[r][:, None] & core[others])
            if same[0]:
                hit[np.arange(len(r)), at + np.arange(len(r))] = False
            out[r] += hit @ n[others]
            if not same[0]:
                out[others] += n[r] @ hit
        return pa.table({"id": ids, "k": group.column("k"), "n": out})

    return count


def component_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, place, total): sums of unit vectors, added within a batch before they move."""
    for batch in batches:
        keys, sizes = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        order = np.lexsort((keys, sizes))
        batch, keys, sizes = batch.take(pa.array(order)), keys[order], sizes[order]
        for i, j in equal_runs(sizes):
            x = unit(matrix(batch.column(1).slice(i, j - i)))
            edges = [a for a, _ in equal_runs(keys[i:j])]
            total = np.add.reduceat(x, edges, 0)
            columns = [pa.array(np.repeat(keys[i:j][edges], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1], dtype=np.int32), len(edges))), pa.array(total.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, names=["component_id", "place", "total"])


def link_counts(placed: DataFrame, cosine: float) -> DataFrame:
    """(id, k, linked): weighted links inside the components of placed (component_id, id, k, n, v), the vector's own copies left out."""
    double = "component_id long, place int, total double"
    totals = placed.select("component_id", "v").mapInArrow(component_sums, double).groupBy("component_id", "place").agg(F.sum("total").alias("total"))
    middle = totals.groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("m")).select("component_id", F.col("m.total").alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, x: s + x)
    # two vectors within half the angle of the mean are within the angle of each other; the margin is for rounding
    near = math.cos(math.acos(cosine) / 2) + 1e-9
    is_core = F.coalesce(dot(F.col("v"), F.col("m")) >= near * F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("m"), F.col("m"))), F.lit(False))
    members = stage(placed.join(middle, "component_id").select("component_id", "id", "k", "n", "v", is_core.alias("core")), "vector-members")
    tally = members.groupBy("component_id").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.count_if("core").alias("inner"), F.count("*").alias("all"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    tally = tally.select("component_id", "core_n", blocks(F.col("all") - F.col("inner")).alias("outer_blocks"), blocks(F.col("inner")).alias("core_blocks"), (F.col("all") == F.col("inner")).alias("tight"))
    sized = members.join(tally, "component_id")
    certain = sized.where("core").select("id", "k", (F.col("core_n") - F.col("n")).alias("n"))
    # blocks of the outer members first, then those of the core; blocks of the core do not meet each other
    h = F.xxhash64("id")
    block = F.when(F.col("core"), F.col("outer_blocks") + F.pmod(h, F.col("core_blocks"))).otherwise(F.pmod(h, F.col("outer_blocks"))).cast("int")
    last = F.when(F.col("core"), F.col("outer_blocks") - 1).otherwise(F.col("outer_blocks") + F.col("core_blocks") - 1)
    sent = sized.where("not tight").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    sent = sent.select("component_id", low.alias("low"), high.alias("high"), "id", "k", "n", "v", "core", (F.col("block") == high).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"))
    compared = sent.groupBy("component_id", "low", "high").applyInArrow(counter(cosine), "id long, k long, n long")
    return certain.union(compared).groupBy("id", "k").agg(F.sum("n").alias("linked"))


def near_vectors(table: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of table (vec_id, embedding)."""
    # single-precision components stay so while they move; all sums are in double precision
    narrow = dict(table.dtypes)["embedding"] == "array<float>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    usable = F.coalesce(whole & F.col("vec_id").isNotNull(), F.lit(False))
    folded = stage(rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("k", F.xxhash64("v")), "vectors")
    common = folded.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    n, mean = (0, np.zeros(0)) if common is None else (common["n"], np.zeros(common["size"]))
    if n:
        for r in folded.where(F.size("v") == common["size"]).select("v").mapInArrow(means, "place int, total double").groupBy("place").agg(F.sum("total").alias("t")).collect():  # one row a component of a vector
            mean[r["place"]] = r["t"] / n
    first = passes or passes_for(n, window, cosine)
    half = -(-first // 2)
    links, seen, rank, turn = None, None, 0, 0
    while True:
        found = stage(half_links(folded, turn * half, half, mean, window, cosine).where("a <> b"), "vector-found")
        pairs = found.select("a", "b")
        links = stage((pairs if links is None else links.union(pairs)).distinct(), "vector-links")
        ends = found.select(F.col("a").alias("id"), "pass").union(found.select("b", "pass")).distinct()
        seen = stage(ends if seen is None else seen.union(ends), "vector-seen")
        parts = stage(connected(links), "vector-parts")
        linked = parts.agg(F.count("*") - F.count_distinct("component_id")).first()[0]
        turn += 1
        missing, hard = unseen(seen, turn * half)
        if turn > 1 and ((linked - rank) * 20 <= linked and missing <= 1 + UNSEEN * (hard + missing) or turn * half >= MOST_TIMES * first):
            break
        rank = linked
    counts = link_counts(folded.join(parts, "id").select("component_id", "id", "k", "n", "v"), cosine)
    known = stage(folded.join(counts, ["id", "k"], "left").join(parts, "id", "left").select("v", "n", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component_id", "id").alias("component")), "vector-counts")
    tagged = rows.withColumn("key", F.when(usable, F.col("v")))
    out = tagged.join(known.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("component", "vec_id")
    links_of_row = F.coalesce(F.col("linked") + F.col("n") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", links_of_row.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_vector_neardup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
