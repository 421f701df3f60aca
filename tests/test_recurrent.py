"""The recurrent autoencoder: gradients against differences, learning over partitions, scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import models
from quern.operators.recurrent import RecurrentAutoencoder
from quern.plans.sweeps import window_sequences


def waves(n, seed, features=3, length=8):
    rng = np.random.default_rng(seed)
    t = np.arange(length)[None, :, None]
    phase, level = rng.uniform(0, 6.28, (n, 1, 1)), rng.uniform(0.5, 1.5, (n, 1, features))
    return (level * np.sin(t * 0.7 + phase)).reshape(n, -1)


def test_gradients_match_differences():
    model = RecurrentAutoencoder(12, 1, length=4, hidden=5, latent=2, dropout=0.0)
    x = np.random.default_rng(2).standard_normal((3, 4, 3))
    _, grads = model.gradients(x, drop=False)
    flat, at = np.concatenate([g.ravel() for g in grads]), model.parameters()
    for i in np.random.default_rng(3).choice(len(at), 60, replace=False):
        up, down = at.copy(), at.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (model.set_parameters(up).gradients(x, False)[0] - model.set_parameters(down).gradients(x, False)[0]) / 2e-5
        assert slope == pytest.approx(flat[i], rel=1e-4, abs=1e-8)


def test_partitions_learn_together(spark):
    x = waves(600, 4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "k int, v array<double>").repartition(4, "k")
    held = F.col("k") >= 500
    before = RecurrentAutoencoder(24, 42).errors(x[500:]).mean()
    model, loss = models.fit_dense(rows, "v", held, 24, [42], rounds=12, make=RecurrentAutoencoder, passes=12)[42]
    assert loss < 0.7 * before and abs(model.errors(x[500:]).mean() - loss) < 1e-9
    got = {r["k"]: r["score"] for r in models.sequence_scores(rows, ["k"], "v", model, 24, 2).collect()}
    assert len(got) == 600
    want = np.sort(model.errors(x), 1)[:, -2:].mean(1)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    odd = x[500:].copy()
    odd[:, -3:] += 3
    assert model.errors(odd).mean() > 3 * loss


def test_rounds_do_not_read_the_table_again(spark):
    rows = window_sequences(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lineitem" not in plan
    assert rows.where(F.size("sequence") == 48).count() == rows.count() > 0
