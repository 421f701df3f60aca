"""Detection scores, thresholds, classification metrics, curves, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_mean(errors: Column, k: int) -> Column:
    """Mean of the k largest errors of a row."""
    return F.aggregate(F.slice(F.sort_array(errors, False), 1, k), F.lit(0.0), lambda s, e: s + e) / k


def order_threshold(scores: DataFrame, keys: list[str], score: str, percent: float) -> DataFrame:
    """(keys, n, rank, threshold, effective, resolution, is_max): the score at 1-based order ceil((n - 1) p / 100) + 1.

    The order comes from a window over each key, so no key's scores are gathered in one row.
    """
    w = Window.partitionBy(*keys)
    tagged = scores.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(score))).withColumn("most", F.max(score).over(w))
    rank = F.ceil((F.col("n") - 1) * percent / 100) + 1
    at = tagged.withColumn("rank", rank).where(F.col("place") == F.col("rank"))
    return at.select(*keys, "n", "rank", F.col(score).alias("threshold"), (100 * F.col("rank") / F.col("n")).alias("effective"), (F.lit(100.0) / F.col("n")).alias("resolution"), (F.col(score) == F.col("most")).alias("is_max"))


def least_rows(percent: Column) -> Column:
    """The fewest scores for which a percentile's order is not the largest; null at 100."""
    q = percent / 100
    return F.when(percent < 100, F.ceil(F.round((q - 2) / (q - 1), 9))).cast("long")


def confusion(rows: DataFrame, keys: list[str], y: str, flagged: Column) -> DataFrame:
    hit, pos = F.coalesce(flagged, F.lit(False)), F.col(y) == 1
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(*keys).agg(n(~pos & ~hit, "tn"), n(~pos & hit, "fp"), n(pos & ~hit, "fn"), n(pos & hit, "tp"))


def binary_metrics(c: DataFrame) -> DataFrame:
    """c (tn, fp, fn, tp) with its rates; undefined precision is null, undefined F1 is 0."""
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))
    return (
        c.withColumn("sensitivity", sens)
        .withColumn("specificity", spec)
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("f1", F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
        .withColumn("balanced_accuracy", (sens + spec) / 2)
        .withColumn("mcc", mcc)
        .withColumn("fpr", F.try_divide(fp, fp + tn))
    )


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson score interval of a proportion; null for no rows."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits.cast("double") / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n.isNotNull(), F.greatest(middle - half, F.lit(0.0))), F.when(n.isNotNull(), F.least(middle + half, F.lit(1.0)))


def score_steps(rows: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Per distinct score: pos, neg, and tp, fp counted from the highest score down (ties together)."""
    groups = rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return groups.select(*keys, "score", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(w).alias("p"), F.sum("neg").over(w).alias("q"))


def roc_auc(rows: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Exact area with ties: each negative counts the positives above it and half of those beside it."""
    s = score_steps(rows, keys, y, score)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return s.groupBy(*keys).agg(F.try_divide(won, F.max("p") * F.max("q").cast("double")).alias("roc_auc"))


def pr_areas(rows: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """(keys, pr_auc, average_precision): trapezoid from (0, 1), and step."""
    s = score_steps(rows, keys, y, score)
    recall, precision = F.try_divide(F.col("tp").cast("double"), F.col("p")), F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    s = s.select(*keys, "score", recall.alias("r"), precision.alias("c"))
    s = s.withColumn("r0", F.coalesce(F.lag("r").over(w), F.lit(0.0))).withColumn("c0", F.coalesce(F.lag("c").over(w), F.lit(1.0)))
    step = F.col("r") - F.col("r0")
    return s.groupBy(*keys).agg(F.sum(step * (F.col("c") + F.col("c0")) / 2).alias("pr_auc"), F.sum(step * F.col("c")).alias("average_precision"))


def sample_evenly(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly along the order with both ends; halves round to even."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # a place is taken if one of the points k * (n - 1) / (most - 1) rounds to it; such a k lies next to its own
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.bround((F.round(F.col("_i") / step) + d) * (F.col("_n") - 1) / float(most - 1)))
    return placed.where((F.col("_n") <= most) | F.array_contains(near, F.col("_i").cast("double"))).drop("_i", "_n")


#: Poisson resampling: a row counts k times in a replicate if its number in [0, PRIME) passes k of these shares.
PRIME = (1 << 31) - 1
SHARES = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]
BOUNDS = np.array([math.floor(s * PRIME) for s in SHARES])


def resample_counts(place: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row (by its place, a whole number) counts in each replicate; the same wherever and however often it is worked out."""
    r, place = np.arange(replicates, dtype=np.int64)[None, :], (np.abs(place.astype(np.int64)) % PRIME)[:, None]
    a = (place * 16807 % PRIME + r * 48271 + seed) % PRIME
    b = (a * a + r) % PRIME
    c = (b * 69621 + place) % PRIME
    d = (c * c + b) % PRIME
    return np.searchsorted(BOUNDS, d, side="right")


def bootstrap_means(rows: DataFrame, keys: list[str], value: str, place: str, replicates: int = 20_000, seed: int = 42) -> DataFrame:
    """(keys, mean, n_valid, low, high): mean and 2.5 / 97.5 percentiles of resampled means; nulls are left out.

    Rows count by Poisson numbers of mean one drawn from (place, replicate), so every partition
    resamples its own rows and sends one pair of sums a key and replicate; no row is written out
    for a draw and no key is gathered. A replicate that draws nothing has no mean.
    """
    good = rows.where(F.col(value).isNotNull())
    taken = good.select(*keys, F.col(place).cast("long").alias("_p"), F.col(value).cast("double").alias("_v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[: len(keys)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                columns = [pa.array([k] * replicates, taken_types[i]) for i, k in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(replicates, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=[*keys, "_r", "_s", "_w"])
            held.clear()

        taken_types = []
        for batch in batches:
            taken_types = batch.schema.types[: len(keys)]
            key = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)) if keys else [()] * batch.num_rows
            p, v = batch.column(len(keys)).fill_null(0).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(key):
                at.setdefault(k, []).append(i)
            for k, where in at.items():
                if k not in held and len(held) == 64:
                    yield from flush()
                total = held.setdefault(k, np.zeros((2, replicates)))
                for i in range(0, len(where), 64):
                    part = where[i : i + 64]
                    n = resample_counts(p[part], replicates, seed)
                    total += np.stack([v[part] @ n, n.sum(0)])
        yield from flush()

    means = taken.mapInArrow(sums, f"{kinds + ', ' if kinds else ''}_r int, _s double, _w double").groupBy(*keys, "_r").agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias("m"))
    bounds = means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    whole = good.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n_valid"))
    return whole.join(bounds, keys) if keys else whole.join(bounds)


def verdict(low: Column, high: Column) -> Column:
    """Whether a paired difference stays on one side of zero."""
    return F.when(low > 0, "survives").when(high < 0, "does_not_survive").otherwise("inconclusive")
