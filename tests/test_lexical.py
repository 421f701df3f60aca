"""The kept lexical index against a plain one: updates, dead documents, merging, and pruned search."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import lexical, retrieval
from quern.sources.shared import exists, shared_dir

WORDS = [f"w{i}" for i in range(60)]


def texts(seed, n, low=0, high=60):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(low, high))) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame(list(held.items()), "doc long, text string")


def questions(spark, seed, n=12):
    rng = random.Random(seed)
    return spark.createDataFrame([(q, t) for q in range(n) for t in set(rng.choices([*WORDS, "absent"], k=rng.randrange(1, 9)))], "query long, term string")


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/lexical-test-{uuid.uuid4().hex}"


def same_search(spark, index, held, n=5):
    for seed in (1, 2):
        q = questions(spark, seed)
        want = retrieval.top(retrieval.bm25(frame(spark, held), "doc", "text", q), "query", [F.desc(F.round("score", 9)), F.asc("doc")], n)
        got = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9), r["matched"]) for r in lexical.search(index, q, n).collect()}
        assert got == {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9), r["matched"]) for r in want.collect()}


def test_search_is_exact(spark, root, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", 4)
    held = texts(1, 300)
    held[300] = None
    held[301] = "w0 " * 5000
    index = lexical.update(root, frame(spark, held))
    assert (index.number, index.n_docs, index.dead) == (1, 302, None)
    same_search(spark, index, held)


def test_updates_equal_a_new_index(spark, root, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", 4)
    monkeypatch.setattr(lexical, "SLICE_DOCS", 50)
    held = texts(2, 200)
    index = lexical.update(root, frame(spark, held))
    assert lexical.update(root, frame(spark, held)).number == 1  # nothing changed
    for turn in range(3):
        new = dict(held)
        for k in range(turn, 200, 29):
            new[k] = f"{new.get(k, '')} w{turn} new{turn}"
        new.pop(turn * 3 + 1)
        new[1000 + turn] = "w1 w2 w3"
        told = {r["doc"]: r["action"] for r in lexical.changes(frame(spark, new), index).collect()}
        assert told == {k: "added" if k not in held else "removed" if k not in new else "kept" if held[k] == new[k] else "changed" for k in held | new}
        index, held = lexical.update(root, frame(spark, new)), new
        assert index.number == turn + 2 and len(index.segments) == turn + 2 and index.n_docs == len(held)
    same_search(spark, index, held)
    assert lexical.read_index(spark, root) == index


def test_many_dead_documents_are_merged_away(spark, root):
    held = texts(3, 60, 1)
    lexical.update(root, frame(spark, held))
    new = {k: v + " again" if k % 2 else v for k, v in held.items()}
    index = lexical.update(root, frame(spark, new))
    assert (len(index.segments), index.dead) == (1, None)
    same_search(spark, index, new)
    lexical.forget(index)
    assert not exists(spark, root)


def test_empty_index(spark, root):
    index = lexical.update(root, spark.createDataFrame([], "doc long, text string"))
    assert index.n_docs == 0 and lexical.search(index, questions(spark, 1), 3).count() == 0
    index = lexical.update(root, frame(spark, {1: "w0"}))
    assert index.n_docs == 1 and lexical.search(index, questions(spark, 1), 3).count() > 0


def written(spark):
    """Bytes that all stages so far have exchanged."""
    jvm = spark.sparkContext._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


def test_texts_are_counted_where_they_are_read(spark, root):
    rng = random.Random(4)
    held = {i: " ".join(rng.choices(WORDS, k=3000)) for i in range(200)}
    before = written(spark)
    index = lexical.update(root, frame(spark, held))
    text = sum(map(len, held.values()))
    assert written(spark) - before < text / 100  # 1.4 times the texts when tokens met by document
    assert sum(f.stat().st_size for f in Path(root.removeprefix("file:")).rglob("*.parquet")) < text / 10  # a fifth when all tokens were kept
    assert index.postings().groupBy("doc").agg(F.sum("tf").alias("n")).where("n = 3000").count() == 200
    same_search(spark, index, held)


def test_search_over_slices_and_blocks(spark, root, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_POSTINGS", 100)
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "WAITING", 10)
    monkeypatch.setattr(lexical, "BUCKET", 2)
    held = texts(5, 150) | {1000 + i: "w1 w2 w3" for i in range(40)}  # equal scores go by doc
    same_search(spark, lexical.update(root, frame(spark, held)), held)
