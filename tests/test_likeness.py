"""Near-equal texts against all pairs; titles against the plain rule."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.operators import likeness


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_pairs_match_brute_force(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choices("aab c", k=rng.randrange(0, 12))) for _ in range(150)]
    texts += ["a long title of many words", "a long titel of many words", "a long title of may words", "é漢字", "é漢", "", None, "aaaaaaaa", "aaaaaaa", "aaaaaaaaaa"]
    texts += texts[:20]
    got = {(r["a"], r["b"]): r["distance"] for r in likeness.like_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), most).collect()}
    want = {}
    for a, b in itertools.combinations(sorted({t for t in texts if t}, key=lambda t: t.encode()), 2):
        if (d := distance(a, b)) <= most:
            want[a, b] = d
    assert got == want


def test_titles(spark):
    pairs = [("Failure modes of inverters", "Failure Modes of Inverters: a survey"), ("Deep learning", "Deep lerning"), ("Cats", "Power systems"), ("", "x"), (None, "x"), ("Été", "ete"), ("abcd efgh", "abcd xxgh")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["r"] for r in df.select("i", likeness.titles_related(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    assert got == [True, True, False, False, False, True, SequenceMatcher(None, "abcd efgh", "abcd xxgh").ratio() >= 0.72]


def test_empty_table(spark):
    assert likeness.like_pairs(spark.createDataFrame([], "text string")).count() == 0
