"""Hand-computed cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import catalogue, detect, evidence, library, reliability, retrieval, scoring, signal
from quern.operators.models import DenseAutoencoder, fit_dense
from quern.sources import snapshots, tables


def one(df):
    return df.first()


def test_threshold_uses_ceil_of_order(spark):
    scores = spark.createDataFrame([("m", float(i)) for i in range(210)], "m string, s double")
    r = one(scoring.order_threshold(scores, ["m"], "s", 99.0))
    assert (r["rank"], r["threshold"], r["is_max"]) == (208, 207.0, False)
    assert r["effective"] == pytest.approx(99.0476, abs=1e-4)
    r = one(scoring.order_threshold(scores, ["m"], "s", 99.9))
    assert (r["threshold"], r["is_max"], round(r["resolution"], 5)) == (209.0, True, 0.47619)


def test_least_rows(spark):
    cases = {99.9: 1001, 99.5: 201, 99.0: 101, 95.0: 21, 90.0: 11, 50.0: 3, 100.0: None}
    df = spark.createDataFrame([(p,) for p in cases], "p double").select("p", scoring.least_rows(F.col("p")).alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == cases


def test_two_pr_areas(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.8), ("x", 1, 0.7), ("x", 0, 0.1)], "k string, y int, s double")
    r = one(scoring.pr_areas(df, ["k"], "y", "s"))
    assert r["pr_auc"] == pytest.approx(0.791667, abs=1e-6)
    assert r["average_precision"] == pytest.approx(0.833333, abs=1e-6)
    assert one(scoring.roc_auc(df, ["k"], "y", "s"))["roc_auc"] == 0.75


def test_undefined_metrics(spark):
    c = spark.createDataFrame([(5, 0, 3, 0)], "tn int, fp int, fn int, tp int")
    r = one(scoring.binary_metrics(c))
    assert r["precision"] is None and r["f1"] == 0.0 and r["mcc"] == 0.0


def test_confirmed_crossing(spark):
    series = {1: [0, 1, 1, 0, 1, 1, 1, 1], 2: [1, 0, 1, 1, 0, 1], 3: [1, 1, 1]}
    rows = [(k, i, bool(c)) for k, v in series.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, i int, c boolean")
    out = {r["k"]: r["first"] for r in detect.confirmed_crossing(df, ["k"], ["i"], F.col("c")).collect()}
    assert out == {1: 5, 2: None, 3: 1}


def test_weibull_recovers_shape(spark):
    rng = np.random.default_rng(1)
    t = 0.3 * rng.weibull(2.0, 4000)
    df = spark.createDataFrame([("m", float(x) if x < 1 else None) for x in t], "m string, a double")
    r = one(detect.weibull_fit(df, ["m"], "a"))
    assert r["beta"] == pytest.approx(2.0, abs=0.1) and r["eta"] == pytest.approx(0.3, abs=0.01)
    assert one(detect.weibull_paper_r2(df, ["m"], "a"))["r2"] > 0.95


def test_gate_rejects_few_values(spark):
    df = spark.range(1).select(detect.adoption(F.lit(20), F.lit(2), F.lit(0.99), F.lit(0.5)).alias("r"))
    assert one(df)["r"] == "few distinct values"


def test_split_counts(spark):
    df = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(100)], "t int, i int")
    out = signal.purged_split(df, "t", ["i"]).where("role is not null").groupBy("t", "role").count().collect()
    counts = {r["role"]: r["count"] for r in out if r["t"] == 1}
    assert counts == {"train": 50, "validation": 13, "calibration": 13, "test": 18}


def test_thd_of_fifth_harmonic(spark):
    wave = [math.sin(2 * math.pi * i / 64) + 0.1 * math.sin(2 * math.pi * 5 * i / 64) for i in range(64)]
    r = one(spark.createDataFrame([(wave,)], "w array<double>").select(signal.thd(F.col("w"), 64).alias("t")))
    assert r["t"] == pytest.approx(0.1, abs=1e-9)


def test_injection_identity_and_ends(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0],)], "w array<double>")
    half = lambda a: one(df.select(signal.inject(F.col("w"), "half_cycle", F.lit(a)).alias("w")))["w"]
    assert half(0.0) == [1.0, -2.0, 3.0] and half(1.0) == [0.0, -2.0, 0.0]


def test_sequence_pads_the_head(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "k int, i int, v double")
    out = {r["i"]: r["sequence"] for r in signal.causal_sequence(df, ["k"], "i", "v").collect()}
    assert out[0] == [0.0] * 8 and out[9] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcd")], "query string, item string, rank int")
    wanted = spark.createDataFrame([("q", "c"), ("q", "x")], "query string, item string")
    assert one(evidence.ranking_metrics(hits, wanted, 3))["recall"] == 0.5
    assert one(evidence.ranking_metrics(hits, wanted, 2))["recall"] == 0.0


def test_greedy_assignment_takes_highest_free(spark):
    cells = spark.createDataFrame([("q", 1, [(2, 1), (3, 2)]), ("q", 2, [(3, 2)]), ("q", 3, [(2, 1)])], "query string, rank int, groups array<struct<relevance:int,grp:bigint>>")
    out = {(r["rank"], r["grp"]) for r in evidence.greedy_assignment(cells, "query").collect()}
    assert out == {(1, 2), (3, 1)}


def test_claims(spark):
    ev = spark.createDataFrame([("E1", [12], 2022, "The measured value rose, clearly.")], "evidence string, pages array<int>, year int, raw_text string")
    schema = "claim int, ids array<string>, level string, page int, year int, quote string"
    claims = spark.createDataFrame([(1, ["E1"], "direct", 12, 2022, "value rose"), (2, ["E9"], "direct", None, None, None), (3, ["E1"], "x", 13, 1999, "fell"), (4, [], "direct", None, None, None)], schema)
    out = {r["claim"]: r["errors"] for r in evidence.validate_claims(claims, ev).collect()}
    assert out == {1: [], 2: ["unknown_evidence"], 3: ["bad_level", "page", "quote", "year"], 4: ["no_evidence"]}


def test_fusion_prefers_items_of_both_lists(spark):
    ranked = spark.createDataFrame([("q", "a", "x", 1.0, 1), ("q", "b", "x", 1.0, 2), ("q", "b", "y", 1.0, 2), ("q", "c", "y", 1.0, 1)], "query string, item string, source string, weight double, rank int")
    best = retrieval.fuse(ranked).orderBy(F.desc("score")).first()
    assert best["item"] == "b" and best["sources"] == ["x", "y"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Çé  l'Été\tNaïve!",)], "t string")
    r = one(df.select(T.squeeze(F.col("t")).alias("a"), T.searchable(F.col("t")).alias("b")))
    assert (r["a"], r["b"]) == ("ce l'ete naive!", "ce l ete naive")
    r = one(spark.range(1).select(T.page_ranges(F.array(*[F.lit(i) for i in (3, 4, 5, 8)])).alias("p"), T.mask_secrets(F.lit("password=abcdef123")).alias("m"), T.markers(F.lit("x [E1] [E2] [E1]")).alias("k")))
    assert (r["p"], r["m"], r["k"]) == ("3-5, 8", "password=abcdef***", ["E1", "E2"])
    r = one(spark.range(1).select(T.excerpt(F.lit("One sentence here. And another that runs on and on"), 30).alias("e"), T.wikilinks(F.lit("[[A|b]] [[C#d]] [[A]]")).alias("w"), T.cited_name(F.lit("silva_some_title_2022.pdf")).alias("c")))
    assert r["e"] == "One sentence here." and r["w"] == ["A", "C"] and r["c"]["citation"] == "Silva (2022)"


def test_reliability_ends(spark):
    r = one(spark.range(1).select(reliability.reliability(F.lit(1e-5), F.lit(0.0)).alias("a"), reliability.failure(F.lit(1e-5), F.lit(1e5)).alias("b"), reliability.risk_priority(F.lit(7), F.lit(8), F.lit(5)).alias("n"), reliability.risk_priority(F.lit(11), F.lit(8), F.lit(5)).alias("bad")))
    assert r["a"] == 1.0 and r["b"] == pytest.approx(1 - math.exp(-1)) and r["n"] == 280 and r["bad"] is None


def test_snapshot_round_trip(spark, tmp_path):
    rows = [(f"d__chunk_{i:05d}", "d", i, f"text {i}", f"text {i}", {"file": "a.pdf"}, [0.1, 0.2]) for i in range(5)]
    df = spark.createDataFrame(rows, snapshots.RECORD)
    path = str(tmp_path / "snap")
    snapshots.export_snapshot(df, path)
    assert snapshots.validate_snapshot(spark, path).count() == 0
    merged = snapshots.import_snapshot(df.limit(2), snapshots.read_chunks(spark, path), merge=True)
    assert merged.count() == 5
    with pytest.raises(ValueError):
        snapshots.import_snapshot(df, df, merge=False)
    spark.createDataFrame([("x", "d", 9, "more", "more", {}, [0.0])], snapshots.RECORD).write.mode("append").json(f"{path}/chunks")
    assert {r["rule"] for r in snapshots.validate_snapshot(spark, path).collect()} == {"rows", "digest"}
    patched = snapshots.update_metadata(df, spark.createDataFrame([("a.pdf", {"year": "2020"})], "file string, patch map<string,string>"))
    assert patched.first()["metadata"] == {"file": "a.pdf", "year": "2020"}


def test_front_matter(spark):
    note = "---\ntitle: A note\ntags: x, y\n---\nBody [[Link]]"
    r = one(tables.front_matter(spark.createDataFrame([("p", note), ("q", "plain")], "path string, content string")))
    assert r["meta"] == {"title": "A note", "tags": "x, y"} and r["body"] == "Body [[Link]]"


def test_dense_autoencoder_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 4)) @ rng.standard_normal((4, 24))
    x /= x.std()
    before = DenseAutoencoder(24).errors(x).mean()
    odd = [(-1, None), (-2, [1.0] * 23), (-3, [None] * 24), (-4, [float("nan")] * 24), (-5, [float("inf")] * 24)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "k int, v array<double>").repartition(2, "k")
    (model, loss), same = fit_dense(rows, "v", F.col("k") >= 320, 24, [42], rounds=40)[42], model_of_none(rows)
    assert loss < 0.6 * before and abs(model.errors(x[320:]).mean() - loss) < 1e-9
    assert same == np.inf


def model_of_none(rows):
    return fit_dense(rows.where("k > 1000"), "v", F.col("k") >= 320, 24, [42], rounds=1)[42][1]


def test_online_crossing(spark, tmp_path):
    from quern.streaming import streams

    rows = [(k, i, c) for k, v in {1: [0, 1, 1, 1], 2: [1, 0, 1, 1]}.items() for i, c in enumerate(v)]
    spark.createDataFrame([(k, i, bool(c)) for k, i, c in rows], "k long, place long, c boolean").write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "k long, place long, c boolean", 100)
    out = streams.run_to_memory(streams.online_crossing(stream, "k", "c"), "crossings", "append")
    assert [(r["k"], r["at"]) for r in out.collect()] == [(1, 1)]


def test_sections_keep_the_trail(spark):
    note = "intro\n# A\none\n## B\ntwo\n### C\nthree\n## D\nfour\n# E\n#### F\nfive"
    rows = library.sections(spark.createDataFrame([(1, note), (2, "plain"), (3, None)], "k int, t string"), "k", "t").orderBy("k", "section").collect()
    assert [(r["level"], r["trail"], r["body"]) for r in rows if r["k"] == 1] == [(0, [], "intro"), (1, ["A"], "one"), (2, ["A", "B"], "two"), (3, ["A", "B", "C"], "three"), (2, ["A", "D"], "four"), (1, ["E"], ""), (4, ["E", "F"], "five")]
    assert [(r["trail"], r["body"]) for r in rows if r["k"] != 1] == [([], "plain")]


def test_references_are_cut_at_the_earliest_heading(spark):
    df = spark.createDataFrame([("Text with references inside.\n\n## References\n[1] x\nBibliography\n[2] y",), ("no list",), (None,)], "t string")
    assert [r["c"] for r in df.select(library.without_references(F.col("t")).alias("c")).collect()] == ["Text with references inside.", "no list", None]


def test_memory_states(spark):
    rows = [(1, "t", 1, "Likes tea"), (2, "t", 2, "likes  TEA!"), (3, "t", 3, "Likes coffee"), (4, "u", 1, "Other")]
    out = library.memory_states(spark.createDataFrame(rows, "memory int, topic string, created int, content string"))
    assert {r["memory"]: r["state"] for r in out.collect()} == {1: "superseded", 2: "duplicate", 3: "active", 4: "active"}


def test_levels_of_evidence(spark):
    hits = spark.createDataFrame([("q", 1, "other", 7, "d")], "query string, rank int, chunk string, page int, document string")
    expected = spark.createDataFrame([("q", "own", 7, "d")], "query string, chunk string, page int, document string")
    out = {r["level"]: r["hit"] for r in library.level_hits(hits, expected, ["chunk", "page", "document"], 5).collect()}
    assert out == {"chunk": 0, "page": 1, "document": 1}


def test_gold_errors(spark):
    rows = [("a", "What does the house hold?", 2, ["e"]), ("a", "Another long question", 9, []), ("b", "what does the HOUSE hold", 1, ["e"]), (None, None, None, None)]
    out = library.gold_errors(spark.createDataFrame(rows, "id string, question string, relevance int, evidence array<string>")).collect()
    got = sorted((str(r["id"]), r["errors"]) for r in out)
    assert got == [("None", ["no_evidence", "relevance", "short_question"]), ("a", ["duplicate_id", "duplicate_question"]), ("a", ["duplicate_id", "no_evidence", "relevance"]), ("b", ["duplicate_question"])]


def test_marks_fold_by_decomposition(spark):
    import unicodedata

    whole = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    texts = ["Ångström ＡＢ ① ﬁn Ž ộ e\u0301 ½ Ⅳ ㎏ ﬀ 한국어 각 \U0001d400 \ue000", "plain", "Ünter", "", None]
    every = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts += ["".join(every[i : i + 256]).lower() for i in range(0, len(every), 256)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.fold(F.col("t")).alias("f")).collect()
    different = [(texts[r["i"]], r["f"]) for r in rows if r["f"] != (texts[r["i"]] if texts[r["i"]] is None else whole(texts[r["i"]]))]
    assert not different, different[:2]


def test_cuts_next_to_line_ends(spark):
    text = "aaa bbb ccc\nddd eee"
    cut = spark.createDataFrame([(text,)], "t string").select(T.shorten(F.col("t"), 12, "~").alias("s"), T.shorten(F.col("t"), 10, "~").alias("u"), catalogue.trial_fault(F.concat(F.lit("F1L"), F.lit("\n"))).alias("fault")).first()
    assert (cut["s"], cut["u"], cut["fault"]) == ("aaa bbb ccc~", "aaa bbb~", None)


def test_code_blocks_end_at_their_own_fence(spark):
    text = "a\n```sql\nselect 1\n```\n~~~~\nx\n```\n~~~~\nend"
    out = one(spark.createDataFrame([(text,)], "t string").select(T.code_blocks(F.col("t")).alias("b")))["b"]
    assert [(b["language"], b["code"]) for b in out] == [("sql", "select 1\n"), ("", "x\n```\n")]


def test_long_aliases_match(spark):
    chunks = spark.createDataFrame([(1, 1, "He said: once upon a time, all was well"), (2, 2, "once upon")], "doc_id int, chunk_id int, text string")
    out = evidence.alias_edges(chunks, spark.createDataFrame([("tale", "Once upon a time"), ("well", "well")], "entity string, alias string")).collect()
    assert sorted((r["src"], r["dst"]) for r in out) == [("entity:tale", "document:1"), ("entity:well", "document:1")]
