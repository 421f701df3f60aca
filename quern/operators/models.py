"""Reconstruction models: a linear autoencoder by principal components, and a small dense one in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of a vector column, summed over all partitions (size * size numbers reach the driver)."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(size), np.zeros((size, size))
        for part in parts:
            if len(part):
                x = np.stack(part[vector].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"place": np.arange(1 + size + size * size), "value": np.concatenate([[n], s, q.reshape(-1)])})

    out = rows.select(vector).mapInPandas(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    flat = np.array([r["value"] for r in out])
    n, mean = int(flat[0]), flat[1 : 1 + size] / max(flat[0], 1)
    return n, mean, flat[1 + size :].reshape(size, size) / max(flat[0], 1) - np.outer(mean, mean)


def linear_autoencoder(rows: DataFrame, vector: str, size: int, latent: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the leading ``latent`` directions; decoding is their transpose."""
    _, mean, cov = moments(rows, vector, size)
    values, directions = np.linalg.eigh(cov)
    return mean, directions[:, np.argsort(-values)[:latent]]


def reconstruction_errors(rows: DataFrame, keys: list[str], vector: str, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(keys, errors): squared error of every component of a row, once, for any number of scores."""

    def errors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part[vector].to_numpy()).astype(float) - mean if len(part) else np.zeros((0, len(mean)))
            yield part[keys].assign(errors=list((x - x @ basis @ basis.T) ** 2))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", errors array<double>"
    return rows.select(*keys, vector).mapInPandas(errors, schema)


class DenseAutoencoder:
    """size-16-8-16-size with ReLU, trained by Adam with early stopping; the best state is kept."""

    def __init__(self, size: int, seed: int = 42, hidden: int = 16, latent: int = 8):
        rng = np.random.default_rng(seed)
        dims = [size, hidden, latent, hidden, size]
        self.w = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(dims, dims[1:], strict=False)]
        self.b = [np.zeros(b) for b in dims[1:]]
        self.rng = rng

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.w) - 1 else z)
        return out

    def errors(self, x: np.ndarray) -> np.ndarray:
        return (self.layers(x)[-1] - x) ** 2

    def parameters(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.w, *self.b)])

    def set_parameters(self, values: np.ndarray) -> DenseAutoencoder:
        at = 0
        for p in (*self.w, *self.b):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def learn(self, x: np.ndarray, state: list, step: int, batch: int = 32, rate: float = 1e-3) -> int:
        """Adam steps over the rows of x in random order; state holds the moments of each parameter, step the steps taken so far."""
        order = self.rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = x[order[at : at + batch]]
            out = self.layers(rows)
            d = 2 * (out[-1] - rows) / rows.size
            grads_w, grads_b = [], []
            for i in range(len(self.w) - 1, -1, -1):
                grads_w.append(out[i].T @ d)
                grads_b.append(d.sum(0))
                if i:
                    d = (d @ self.w[i].T) * (out[i] > 0)
            step += 1
            for p, g, (m, v) in zip((*self.w, *self.b), (*grads_w[::-1], *grads_b[::-1]), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return step


def whole(vector: str, size: int) -> Column:
    """Whether a vector has this length and finite components only."""
    return (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def fit_dense(rows: DataFrame, vector: str, check: Column, size: int, seeds: list[int], rounds: int = 15, patience: int = 20, make: Callable = DenseAutoencoder, passes: int = 1) -> dict[int, tuple]:
    """A model made by make(size, seed) for each seed and its least loss on the rows held for ``check``.

    Every round each partition takes steps, in ``passes``, over its own rows from the shared parameters, and the
    parameters become the mean of the partitions', weighted by rows; only these means, a few thousand
    numbers a seed, come to the driver. Vectors of another length, or with a null, teach nothing.
    The parameters of the best round are kept, and a seed that has not improved for ``patience`` rounds ends it.
    """
    usable = rows.where(whole(vector, size))
    dealt = usable.select(F.coalesce(check, F.lit(False)).alias("check"), vector)
    models = {s: make(size, s) for s in seeds}
    best = {s: (np.inf, m.parameters(), 0) for s, m in models.items()}
    for turn in range(rounds + 1):
        shared = {s: m.parameters() for s, m in models.items()}

        def local(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            here = {s: make(size, s + 1000 * turn).set_parameters(p) for s, p in shared.items()}
            asked = {s: make(size, s).set_parameters(p) for s, p in shared.items()}
            state = {s: [(np.zeros_like(p), np.zeros_like(p)) for p in (*m.w, *m.b)] for s, m in here.items()}
            steps, loss, learned, checked = dict.fromkeys(here, 0), dict.fromkeys(here, 0.0), 0, 0
            for batch in batches:
                x, held = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, size)), batch.column(0).to_numpy(zero_copy_only=False)
                for s, m in here.items():
                    loss[s] += float(asked[s].errors(x[held]).mean(1).sum())
                    for _ in range(passes if turn < rounds else 0):
                        steps[s] = m.learn(x[~held], state[s], steps[s])
                learned, checked = learned + int((~held).sum()), checked + int(held.sum())
            for s, m in here.items():
                values = np.concatenate([m.parameters() * learned, [learned, loss[s], checked]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), s), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["seed", "place", "value"])

        summed = dealt.mapInArrow(local, "seed int, place int, value double").groupBy("seed", "place").agg(F.sum("value").alias("value")).toArrow().sort_by([("seed", "ascending"), ("place", "ascending")])
        for s, m in models.items():
            found = summed.filter(pc.equal(summed.column("seed"), s)).column("value").to_numpy()
            if not len(found):
                continue
            loss = found[-2] / found[-1] if found[-1] else 0.0
            best[s] = (loss, m.parameters(), turn) if loss < best[s][0] - 1e-8 else best[s]
            if found[-3]:
                m.set_parameters(found[:-3] / found[-3])
        if all(turn - b[2] >= patience for b in best.values()):
            break
    return {s: (m.set_parameters(best[s][1]), float(best[s][0])) for s, m in models.items()}


def mean_scores(rows: DataFrame, vector: str, models: dict[int, DenseAutoencoder], size: int, k: int = 5) -> DataFrame:
    """(seed, score): the mean over all rows of their k largest squared errors' mean."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                sums = [float(np.sort(m.errors(x), 1)[:, -k:].mean(1).sum()) for m in models.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(models), pa.int32()), pa.array(sums), pa.array([len(x)] * len(models), pa.int64())], names=["seed", "total", "n"])

    usable = rows.where(whole(vector, size))
    parts = usable.select(vector).mapInArrow(scored, "seed int, total double, n long")
    return parts.groupBy("seed").agg((F.sum("total") / F.sum("n")).alias("score"))


def sequence_scores(rows: DataFrame, keys: list[str], vector: str, model, size: int, k: int = 5) -> DataFrame:
    """(keys, score): the mean of the k largest squared errors of each usable row under one model."""
    usable = rows.where(whole(vector, size)).select(*keys, vector)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = np.sort(model.errors(matrix(batch.column(len(keys)))), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(e[:, -k:].mean(1))], names=[*keys, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usable.schema.fields[: len(keys)]) + ", score double"
    return usable.mapInArrow(scored, schema)
