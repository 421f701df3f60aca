"""Tree search against all inner products: exact at factor one, by recall at the factor in use."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quern.llm import vptrees

SCHEMA = "vec_id long, embedding array<double>, rank string, score int, v int, id string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 1, 2, "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, every=20, k=20):
    """query -> [(vec_id, score)] by all inner products."""
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            held[i] = min(held.get(i, list(map(float, v))), list(map(float, v)))
    out = {}
    for size in {len(v) for v in held.values()}:
        ids = np.array(sorted(i for i, v in held.items() if len(v) == size))
        x = np.array([held[i] for i in ids])
        for q in ids[ids % every == 0].tolist():
            scores = np.einsum("ij,ij->i", x, np.array(held[q])[None])
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in hits}) / max(len(hits), 1) for q, hits in want.items()])


def clustered(n, size, groups, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, size))
    x = middle[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("norms", [False, True])
def test_factor_one_is_exact(spark, norms):
    rng = np.random.default_rng(1)
    x = clustered(3000, 16, 12, 0.6, 2) * (rng.uniform(0.1, 4, (3000, 1)) if norms else 1)
    x[500:900] = x[500]  # many copies of one vector
    rows = list(enumerate(x.tolist()))
    got, want = found(vptrees.nearest(frame(spark, rows), factor=1.0)), brute(rows)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert all(a[1] == pytest.approx(b[1], rel=1e-12, abs=1e-14) for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("kind", ["even", "loose", "tight", "copies"])
def test_recall_at_the_factor_in_use(spark, kind):
    n, size = 6000, 64
    x = {"even": lambda: clustered(n, size, n, 1.0, 3), "loose": lambda: clustered(n, size, 10, 1.0, 4), "tight": lambda: clustered(n, size, 300, 0.1, 5), "copies": lambda: clustered(n, size, 40, 0.3, 6)}[kind]()
    if kind == "copies":
        x[n // 3 : 2 * n // 3] = x[0]
    rows = list(enumerate(x.tolist()))
    assert recall(found(vptrees.nearest(frame(spark, rows))), brute(rows)) >= 0.95


def test_awkward_rows(spark):
    rows = [(0, [1, 0, 0]), (20, [0, 1, 0]), (40, None), (60, []), (80, [0, 0, 0]), (100, [1, None, 0]), (120, [1, float("nan"), 0]), (140, [float("inf"), 0, 0])]
    rows += [(160, [1, 0]), (1, [2, 0]), (3, [1, 1, 0]), (4, [1, 1, 0]), (2, [1, 1, 0]), (None, [9, 9, 9]), (0, [1, 0, 0]), (180, [-1, 5, 0]), (180, [-2, 0, 0]), (200, [7]), (5, [1e-300, 0, 0])]
    got = found(vptrees.nearest(frame(spark, rows)))
    assert got == {q: hits for q, hits in brute(rows).items() if hits}
    assert [i for i, _ in got[0]][:3] == [2, 3, 4]
    assert vptrees.nearest(frame(spark, [])).count() == 0


def test_stages_are_cleared(spark):
    from quern.llm import common

    staged = common.stage(spark.range(5), "cleared")
    assert staged.count() == 5
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.stage_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(root)
    common.clear_stages(spark)
    assert not files.exists(root)
