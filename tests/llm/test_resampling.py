"""Importance resampling against plain counts."""

import collections
import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quern.llm import resampling

DOCS = "doc_id long, text string, weight string, score int, n_words string, rank int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]]


def brute(docs, target):
    raw, want = collections.Counter(), collections.Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        want.update(features(text)[1])
    s, t = raw.total(), want.total()
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000))))
    out = []
    for doc, text in docs:
        words, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in frame.collect()), key=repr)


def frames(spark, docs, target):
    return spark.createDataFrame([(i, t, "clash", 1, "clash", 2) for i, t in docs], DOCS), spark.createDataFrame([(t, 3) for t in target], "text string, doc_id int")


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["The", "cat", "été", "漢字", "x9", "a-b", "don't", "\x85", "Ä", "A\x00B", "\n", "end."]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(300)]
    docs += [(None, "no id " * 20), (5, None), (6, ""), (7, docs[7][1]), (7, docs[7][1]), (8, "of the same id but another text " * 9), (900, "long words and texts " * 30_000)]
    docs += [(1000 + i, docs[10][1]) for i in range(100)]
    target = ["The cat of the été", None, "", "漢字 x9 " * 40]
    assert found(resampling.resample(*frames(spark, docs, target))) == brute(docs, target)


def test_empty_tables(spark):
    docs, target = frames(spark, [], [])
    assert resampling.resample(docs, target).count() == 0
    rows = [(i, f"one of few texts number {i} " * 5) for i in range(9)]
    assert found(resampling.resample(*frames(spark, rows, []))) == brute(rows, [])
    assert found(resampling.resample(*frames(spark, [(1, None), (2, "  ")], ["x"]))) == brute([(1, None), (2, "  ")], ["x"])


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_stretches_change_nothing(stretch, monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    text = "One two  three, FOUR five\n\n été 漢字x y " * 20
    parts = list(resampling.stretches(text.encode()))
    words, want = features(text)
    assert sum(n for n, _ in parts) == len(words)
    assert collections.Counter(int(c) % 10000 for _, found in parts for c in found) == collections.Counter(want)
    assert len(parts) > 1
