"""Detectability sweep: every trajectory under every injection and severity, scored by every model in one pass.

Injections and scorers are plain functions over arrays, so a model is plugged in as a
function. A batch of trajectories is injected at all severities of the grid at once, each
injected window is made once for all models, and the confirmed crossing is read from the
scores where they are made: the result is one row a trajectory, injection and model, and
neither windows nor scores leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Injection = Callable[[np.ndarray, np.ndarray], np.ndarray]  # waves (n, length), severities (g) -> (n, g, length)
Scorer = Callable[[np.ndarray], np.ndarray]  # windows (m, length) -> scores (m)

GRID = tuple(round(0.02 + i * 0.02, 4) for i in range(50))  # 50 even severities from 0.02 to 1
CONFIRMED = 3
AT_ONCE = 1 << 21  # samples of injected windows that a task holds at a time
RESULT = "id long, injection string, model string, detected boolean, severity double"


def half_cycle(waves: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Positive half cycles suppressed."""
    w = waves[:, None, :]
    return np.where(w > 0, w * (1 - a)[None, :, None], w)


def gain(waves: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A sensor that shows up to a fifth too much."""
    return waves[:, None, :] * (1 + 0.2 * a)[None, :, None]


def step(waves: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The second half lifted by a share of the wave's largest value."""
    late = np.arange(waves.shape[1]) >= waves.shape[1] // 2
    return waves[:, None, :] + (a[None, :, None] * np.abs(waves).max(1)[:, None, None]) * late


INJECTIONS: dict[str, Injection] = {"half_cycle": half_cycle, "gain": gain, "step": step}


def top_k_scorer(k: int) -> Scorer:
    """Mean of the k largest squares of a window."""
    return lambda x: np.sort(x * x, axis=1)[:, ::-1][:, :k].sum(1) / k


def rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).mean(1))


def first_confirmed(above: np.ndarray, confirmed: int) -> np.ndarray:
    """The first place of each row that begins ``confirmed`` crossings in a row; the row's length if there is none."""
    places = above.shape[1] - confirmed + 1
    run = np.ones((len(above), max(places, 0)), bool)
    for j in range(confirmed):
        run &= above[:, j : j + places]
    return np.where(run.any(1), run.argmax(1), above.shape[1]) if places > 0 else np.full(len(above), above.shape[1])


def sweep(waves: DataFrame, injections: dict[str, Injection], models: dict[str, tuple[Scorer, float]], grid: tuple[float, ...] = GRID, confirmed: int = CONFIRMED) -> DataFrame:
    """(id, injection, model, detected, severity) for waves (id, wave); a trajectory that is never detected has no severity.

    models gives each model's scorer and its threshold, which only a larger score crosses. Waves that are null or empty are left out.
    """
    if not grid or not 1 <= confirmed <= len(grid):
        raise ValueError("the grid must hold as many severities as must be confirmed, and at least one")
    a = np.array(grid, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                same = batch.take(pa.array(np.flatnonzero(sizes == size)))
                most = max(1, AT_ONCE // (len(a) * int(size)))
                for at in range(0, same.num_rows, most):
                    part = same.slice(at, most)
                    ids = part.column(0)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, int(size))
                    for name, inject in injections.items():
                        windows = inject(x, a).reshape(-1, int(size))
                        for model, (score, threshold) in models.items():
                            first = first_confirmed(score(windows).reshape(part.num_rows, len(a)) > threshold, confirmed)
                            hit = first < len(a)
                            severity = pa.array(a[np.minimum(first, len(a) - 1)], mask=~hit)
                            yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(ids)), pa.array([model] * len(ids)), pa.array(hit), severity], names=["id", "injection", "model", "detected", "severity"])

    good = waves.select(F.col("id").cast("long").alias("id"), F.col("wave").cast("array<double>").alias("wave")).where(F.size("wave") > 0)
    return good.mapInArrow(run, RESULT)


def scores(waves: DataFrame, models: dict[str, Scorer]) -> DataFrame:
    """waves (id, wave, ...) with a column of scores for each model, of the windows as they are."""
    names = list(models)
    schema = ", ".join(["id long", *(f"{m} double" for m in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                same = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = same.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(same.num_rows, int(size))
                yield pa.RecordBatch.from_arrays([same.column(0), *(pa.array(models[m](x)) for m in names)], names=["id", *names])

    return waves.select(F.col("id").cast("long").alias("id"), F.col("wave").cast("array<double>").alias("wave")).where(F.size("wave") > 0).mapInArrow(run, schema)


def detectability(found: DataFrame) -> DataFrame:
    """(injection, model, n, n_detected, share, censored, median): a whole model under one injection; without detections there is no median."""
    out = found.groupBy("injection", "model").agg(F.count("*").alias("n"), F.count_if("detected").alias("n_detected"), F.percentile("severity", 0.5).alias("median"))
    return out.select("injection", "model", "n", "n_detected", (F.col("n_detected") / F.col("n")).alias("share"), (F.col("n_detected") < F.col("n")).alias("censored"), "median")
