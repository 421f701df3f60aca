"""Variations, pools and author scans by hand; resampling and sweeps against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import notes, questions, scoring, sweep


def test_rules_and_reviews(spark):
    asked = [(1, "A FMECA do Inversor"), (2, "revisão bibliográfica sobre Weibull"), (3, "the pv of it"), (4, "approved"), (5, None), (6, "anomaly detection")]
    out = {r["query"]: r for r in questions.expand(spark.createDataFrame(asked, "query int, text string")).collect()}
    assert out[1]["variations"] == ["A FMECA do Inversor", *questions.RULES[0].variations, *questions.RULES[3].variations] and not out[1]["review"]
    assert out[2]["review"] and set(questions.REVIEW_TOPICS) <= set(out[2]["variations"]) and len(out[2]["terms"]) == 30
    assert out[3]["variations"][1:] == list(questions.RULES[3].variations)  # "pv" as a whole word
    assert out[4]["variations"] == ["approved"] and out[5]["variations"] == [""] and out[5]["terms"] == []
    assert out[6]["variations"] == ["anomaly detection"]  # one group of words of two
    caps = {r["query"]: r["cap"] for r in questions.variation_queries(questions.expand(spark.createDataFrame(asked, "query int, text string"))).collect()}
    assert caps[4] == 50 and caps[1] == 10 and caps[3] == 20


def test_pool_unites_by_reciprocal_ranks(spark):
    hits = spark.createDataFrame([(1, 0, 7, 1), (1, 1, 7, 3), (1, 1, 8, 1), (1, 0, 9, 2)], "query int, variation int, item int, rank int")
    rows = questions.pooled(hits, 2).orderBy("place").collect()
    assert [(r["item"], r["best"], r["variations"]) for r in rows] == [(7, 1, [0, 1]), (8, 1, [1])]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 63)


def test_every_file_of_a_named_author_contributes(spark):
    chunks = [("kim", "big", i) for i in range(500)] + [("kim", "small", 900), ("kim", None, 901), ("lee", "x", 1)]
    named = questions.author_filters(spark.createDataFrame([(1, t) for t in ("kim", "the", "lee", "kim", "a", "b", "c", "d")], "query int, token string"), spark.createDataFrame([(a, a) for a in ("kim", "lee", "a", "b", "c")] + [("kim", "Kim Rio")], "token string, author string"))
    assert [(r["author"], r["place"]) for r in named.orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3), ("Kim Rio", 4)]
    found = questions.author_scan(spark.createDataFrame([(1, "kim")], "query int, author string"), spark.createDataFrame(chunks, "author string, file string, chunk int"), 3)
    rows = questions.spread_by_file(found, 4).orderBy("place").collect()
    assert [(r["file"], r["chunk"]) for r in rows] == [("big", 0), ("small", 900), (None, 901), ("big", 1)]


def test_notes_are_weighed_and_capped(spark):
    signals = spark.createDataFrame([(1, c, s) for c, s in [("a", 0.5), ("a", 0.72), ("b", 0.72), ("c", 0.72), ("d", 0.72), ("e", 0.9)]] + [(2, "d", 0.72)], "query int, chunk string, signal double")
    chunks = spark.createDataFrame([("a", "n", "wind turbine", "curada", "alta", None), ("b", "n", "x", "curada", "alta", "ativo"), ("c", "n", "x", "curada", "alta", "ativo"), ("d", "m", "x", "sessao_atual", "baixa", " Superado "), ("e", "k", None, None, None, None)], "chunk string, note string, text string, kind string, confidence string, status string")
    asked = spark.createDataFrame([(1, "the wind", False), (2, "what was", True)], "query int, text string, historical boolean")
    got = {(r["query"], r["chunk"]): (round(r["score"], 6), r["current"], r["place"]) for r in notes.search_notes(signals, chunks, asked).collect()}
    assert got == {(1, "a"): (1.02, True, 1), (1, "b"): (0.94, True, 2), (1, "e"): (0.9, True, 3), (1, "d"): (0.46, False, 4), (2, "d"): (0.78, False, 1)}


def test_bootstrap_spreads_as_it_should(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(3, 2, 400)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, 5.0) for i in range(9)] + [("c", 1, None), ("a", 999, None)]
    df = spark.createDataFrame(rows, "k string, p int, v double")
    out = {r["k"]: r for r in scoring.bootstrap_means(df, ["k"], "v", "p").collect()}
    half = 1.96 * v.std() / np.sqrt(400)
    assert set(out) == {"a", "b"} and out["a"]["n_valid"] == 400
    assert out["a"]["low"] == pytest.approx(v.mean() - half, abs=0.02) and out["a"]["high"] == pytest.approx(v.mean() + half, abs=0.02)
    assert out["b"]["low"] == pytest.approx(5) and out["b"]["high"] == pytest.approx(5)
    again = {r["k"]: (r["low"], r["high"]) for r in scoring.bootstrap_means(df.repartition(3), ["k"], "v", "p").collect()}
    assert again["a"] == pytest.approx((out["a"]["low"], out["a"]["high"]), rel=1e-12)
    counts = scoring.resample_counts(np.arange(500), 2000, 42)
    assert counts.mean() == pytest.approx(1, abs=0.01) and counts.var() == pytest.approx(1, abs=0.03)
    assert np.abs(np.corrcoef(counts[:40])[np.triu_indices(40, 1)]).max() < 0.15


def test_first_confirmed_crossing():
    rows = np.array([[0, 1, 1, 0, 1, 1, 1], [0, 0, 0, 0, 0, 1, 1], [1, 1, 1, 1, 1, 1, 1]], bool)
    assert sweep.first_confirmed(rows, 3).tolist() == [4, 7, 0]
    assert sweep.first_confirmed(rows, 2).tolist() == [1, 5, 0]


def test_sweep_of_plugged_models(spark):
    waves = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.1, 0.1]), (3, None), (4, []), (5, [1.0, 1.0, 1.0])], "id int, wave array<double>")
    models = {"most": (lambda x: x.max(1), 1.1), "never": (lambda x: x.max(1), 99.0)}
    grid = (0.2, 0.4, 0.6, 0.8, 1.0)
    out = {(r["id"], r["injection"], r["model"]): r["severity"] for r in sweep.sweep(waves, {"gain": sweep.gain}, models, grid, 2).collect()}
    assert out == {(1, "gain", "most"): 0.6, (5, "gain", "most"): 0.6, (2, "gain", "most"): None, **{(i, "gain", "never"): None for i in (1, 2, 5)}}
    whole = {r["model"]: r for r in sweep.detectability(sweep.sweep(waves, {"gain": sweep.gain}, models, grid, 2)).collect()}
    assert (whole["most"]["n"], whole["most"]["n_detected"], whole["most"]["censored"], whole["most"]["median"]) == (3, 2, True, pytest.approx(0.6))
    assert whole["never"]["median"] is None
    with pytest.raises(ValueError):
        sweep.sweep(waves, {"gain": sweep.gain}, models, (0.5,), 2)
