"""Canonical JSON against Python's own, and groups of evidence by hand."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions.canonical import canonical, digest
from quern.operators import evidence, journal


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def made(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice([None, True, 7, -3, "text", 'a "quoted" NaN, [x]', "é漢 \\ \n", "NaN", float("nan"), float("-inf"), 1.5, ""])
    if kind == 4:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["b", "a", "zz", "é", "A", "10", "9", "read_at"]): made(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_canonical_spelling(spark):
    rng = random.Random(4)
    values = [{"k": made(rng, 3), "read_at": i, "a": made(rng, 2)} for i in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(v, indent=rng.choice([None, 2]))) for i, v in enumerate(values)] + [(900, None), (901, "{no json")], "i int, t string")
    got = {r["i"]: (r["c"], r["d"]) for r in rows.select("i", canonical(F.col("t")).alias("c"), digest(F.col("t"), ("read_at",)).alias("d")).collect()}
    assert got[900] == got[901] == (None, None)
    spell = lambda v: json.dumps(plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for i, v in enumerate(values):
        assert json.loads(got[i][0]) == plain(v) and got[i][0] == spell(v)
        assert got[i][1] == hashlib.sha256(spell({k: x for k, x in v.items() if k != "read_at"}).encode()).hexdigest()


def test_groups_score_once(spark):
    hits = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcd")], "query int, item string, rank int")
    groups = spark.createDataFrame([(1, "g", "a", 1), (1, "g", "b", 3), (1, "h", "c", 2), (1, "h", "b", 2), (1, "x", "z", 1), (2, "y", "q", 1)], "query int, grp string, item string, relevance int")
    out = {r["query"]: r for r in evidence.grouped_gains(hits, groups, 3).collect()}
    dcg, ideal = 7 / math.log2(2) + 3 / math.log2(3), 7 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)
    assert out[1]["recall"] == pytest.approx(2 / 3) and out[1]["mrr"] == 1 and out[1]["precision"] == pytest.approx(2 / 3)
    assert out[1]["dcg"] == pytest.approx(dcg) and out[1]["ndcg"] == pytest.approx(dcg / ideal)
    assert (out[2]["recall"], out[2]["ndcg"], out[2]["mrr"]) == (0, 0, 0)


@pytest.mark.parametrize("least", [2, 3])
def test_related_items_match_brute_force(spark, least):
    rng = random.Random(least)
    words = [f"word{i:02d}" for i in range(30)]
    items = {i: set(rng.choices(words, weights=[1 / (k + 1) for k in range(30)], k=rng.randrange(1, 9))) for i in range(60)}
    rows = spark.createDataFrame([(i, " ".join(sorted(t))) for i, t in items.items()] + [(99, None)], "item int, text string")
    got = sorted((r["item"], r["other"], r["shared"], r["rank"]) for r in journal.related(rows, least, 3).collect())
    want = []
    for i, t in items.items():
        near = sorted((-len(t & u), j) for j, u in items.items() if j != i and len(t & u) >= least)[:3]
        want += [(i, j, -s, k) for k, (s, j) in enumerate(near, 1)]
    assert got == sorted(want)
