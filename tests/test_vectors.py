"""The vector index against all cosines: exact search, probed recall, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, vectors


def table(spark, x, labels=None):
    rows = [(i, None if v is None else [float(c) for c in v], None if labels is None else int(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def brute(x, every, n, labels=None):
    out = {}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, len(x), every):
        s = np.round(u @ u[q], 9)
        s[q] = -np.inf
        if labels is not None:
            s[labels != labels[q]] = -np.inf
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if s[j] > -np.inf][:n]
        out[q] = [int(j) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["vec_id"])
    return out


def data(seed, n=3000, size=16, groups=30, spread=0.25):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, size))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, size))


@pytest.mark.parametrize("spread", [0.05, 0.25, 4.0])
def test_exact_search(spark, spread, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "PART", 90)
    monkeypatch.setattr(vectors, "BLOCK", 70)
    x = data(1, spread=spread)
    x[700:900] = x[5]
    labels = np.arange(len(x)) % 3
    t = table(spark, x, labels)
    q = t.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    index = vectors.build(vectors.sane(t, "vec_id", "embedding", None), 100)
    assert len(index.centroids) == 30
    assert found(index.search(vectors.sane(q, "query", "q", None), 10)) == brute(x, 20, 10)
    assert found(retrieval.nearest(q, t, 5, ("q_label", "label"))) == brute(x, 20, 5, labels)


def test_probed_recall(spark):
    x = data(2, spread=0.3)
    t = table(spark, x)
    q = vectors.sane(t.where("vec_id % 20 = 0"), "vec_id", "embedding", None)
    got = found(vectors.build(vectors.sane(t, "vec_id", "embedding", None), 100).search(q, 10, exact=False))
    want = brute(x, 20, 10)
    assert np.mean([len(set(got[k]) & set(v)) / 10 for k, v in want.items()]) >= 0.9


def test_awkward_vectors(spark):
    x = [[1, 0], [0, 0], None, [float("nan"), 1], [1, 1], [float("inf"), 0], [2, 0]]
    t = table(spark, x)
    q = t.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    assert found(retrieval.nearest(q, t, 5)) == {0: [6, 4], 4: [0, 6], 6: [0, 4]}
    assert retrieval.nearest(q.limit(0), t.limit(0), 5).count() == 0
