"""Cycle windows and their features, splits, robust baselines, sequences, injections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def windows(rows: DataFrame, trial: str, order: list[str], size: int) -> DataFrame:
    """rows with ``idx`` and ``window``, full windows of ``size`` consecutive rows of a trial only."""
    idx = F.row_number().over(Window.partitionBy(trial).orderBy(*order)) - 1
    tagged = rows.withColumn("idx", idx.cast("long")).withColumn("n_rows", F.count("*").over(Window.partitionBy(trial)))
    tagged = tagged.withColumn("window", F.expr(f"idx div {size}"))
    return tagged.where((F.col("window") + 1) * size <= F.col("n_rows")).drop("n_rows")


def iqr(x: Column) -> Column:
    """Interquartile range with linear percentiles."""
    return F.percentile(x, 0.75) - F.percentile(x, 0.25)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def unbalance(*phases: Column) -> Column:
    """Population deviation of the phases over their mean."""
    n = len(phases)
    mean = sum(phases[1:], phases[0]) / n
    var = sum(((p - mean) * (p - mean) for p in phases[1:]), (phases[0] - mean) * (phases[0] - mean)) / n
    return F.sqrt(var) / F.greatest(mean, F.lit(EPS))


def harmonic(wave: Column, k: int, size: int) -> Column:
    """Magnitude of bin k of the Fourier transform of a wave of ``size`` samples with its mean removed."""
    part = lambda f: F.aggregate(F.transform(wave, lambda v, i: v.cast("double") * f(F.lit(2 * math.pi * k / size) * i)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2))


def thd(wave: Column, size: int, last: int = 40) -> Column:
    """Total harmonic distortion of one cycle: harmonics 2 to ``last`` over the fundamental."""
    mags = F.array(*[harmonic(wave, k, size) for k in range(1, min(last, size // 2) + 1)])
    power = F.aggregate(F.slice(mags, 2, last), F.lit(0.0), lambda s, m: s + m * m)
    return F.sqrt(power) / F.greatest(F.element_at(mags, 1), F.lit(EPS))


def phase(start: Column, end: Column, middle: Column, healthy: Column) -> Column:
    """Where a window lies against the middle of its record."""
    return F.when(healthy, "healthy").when(end <= middle, "pre_fault").when(start >= middle, "post_fault").otherwise("transition")


BOUNDS = (0.50, 0.65, 0.80, 1.0)
ROLES = ("train", "validation", "calibration", "test")


def purged_split(rows: DataFrame, trial: str, order: list[str], gap: int = 2, least: int = 60, least_role: int = 10) -> DataFrame:
    """rows with idx and ``role``: consecutive blocks that end at shares of the trial, ``gap`` rows purged before each but the first.

    Purged rows have no role, nor has a trial with fewer than ``least`` rows or a role under ``least_role``.
    """
    w = Window.partitionBy(trial)
    tagged = rows.withColumn("idx", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n_rows", F.count("*").over(w))
    role, ok, start = F.lit(None).cast("string"), F.col("n_rows") >= least, F.lit(0)
    for name, share in zip(ROLES, BOUNDS, strict=True):
        end = F.floor(F.col("n_rows") * share)
        role = F.when((F.col("idx") >= start) & (F.col("idx") < end), name).otherwise(role)
        ok = ok & (end - start >= least_role)
        start = end + gap
    return tagged.withColumn("role", F.when(ok, role)).drop("n_rows")


def robust_baseline(rows: DataFrame, trial: str, value: str, floor_share: float = 0.10, least: float = 1e-6) -> DataFrame:
    """(trial, median, scale, n): a trial's median and IQR, the IQR floored at a share of all rows' IQR."""
    overall = rows.agg(iqr(F.col(value)).alias("x")).first()["x"]
    floor = max(floor_share * (overall or 0.0), least)
    return rows.groupBy(trial).agg(F.percentile(value, 0.5).alias("median"), F.greatest(iqr(F.col(value)), F.lit(floor)).alias("scale"), F.count("*").alias("n"))


def robust_scale(rows: DataFrame, train: DataFrame, value: str) -> DataFrame:
    """rows with ``scaled``: median removed, over the IQR of train; an IQR of zero counts as one."""
    fitted = train.agg(F.percentile(value, 0.5).alias("m"), iqr(F.col(value)).alias("s")).first()  # two numbers
    scale = fitted["s"] if fitted["s"] else 1.0
    return rows.withColumn("scaled", (F.col(value) - F.lit(fitted["m"])) / F.lit(scale))


def commission(rows: DataFrame, trial: str, value: str, least: int = 30, share: float = 0.5) -> DataFrame:
    """rows (with idx) with ``normal``: against the trial's first max(least, share of its rows) rows."""
    n = F.count("*").over(Window.partitionBy(trial))
    head = rows.withColumn("n", n).where(F.col("idx") < F.greatest(F.lit(least), F.floor(F.col("n") * share)))
    base = head.groupBy(trial).agg(F.percentile(value, 0.5).alias("m"), F.greatest(iqr(F.col(value)), F.lit(1e-6)).alias("s"))
    return rows.join(base, trial).withColumn("normal", (F.col(value) - F.col("m")) / F.col("s")).drop("m", "s")


def causal_sequence(rows: DataFrame, keys: list[str], order: str, value: str, length: int = 8) -> DataFrame:
    """rows with ``sequence``: the last ``length`` values, the first repeated at the head; never across keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sequence", F.concat(F.array_repeat(first, F.lit(length) - F.size(last)), last))


def inject(wave: Column, kind: str, a: Column) -> Column:
    """A wave with a fault of severity a in [0, 1]: half-cycle suppression, sensor gain, or a step of the mean."""
    if kind == "half_cycle":
        return F.transform(wave, lambda x: F.when(x > 0, x * (1 - a)).otherwise(x))
    if kind == "gain":
        return F.transform(wave, lambda x: x * (1 + 0.2 * a))
    raise ValueError(kind)


def interpolate(healthy: Column, faulty: Column, a: Column) -> Column:
    """The wave a of the way from healthy to faulty."""
    return F.zip_with(healthy, faulty, lambda x, y: (1 - a) * x + a * y)


def record_faults(rows: DataFrame, trial: str, order: str, time: str, value: str, needed: list[str]) -> DataFrame:
    """(trial, n, not_finite, missing, backward): what breaks the contract of a record, counted; a sound one has zeros."""
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    bad = F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    stepped = rows.withColumn("_before", F.lag(time).over(Window.partitionBy(trial).orderBy(order)))
    return stepped.groupBy(trial).agg(F.count("*").alias("n"), F.count_if(bad).alias("not_finite"), F.count_if(missing).alias("missing"), F.count_if(F.col(time) < F.col("_before")).alias("backward"))
