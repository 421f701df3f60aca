"""The training-data operators against plain Python and SQL, with the awkward rows of their contracts."""

import collections
import hashlib
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import same

from quern.llm import blocks, bpe, chat, components, lm, mixing, neardup, quality, registry, sharding, toxicity, urls, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, kept string, key int, u double"

BASE = "the cat of this house was in and out with a friend that came to see it on the way home again " * 4
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n ", "a"),
    (4, "one", "b"),
    (5, BASE, "a"),
    (6, BASE, "a"),
    (7, BASE.replace("friend", "fiend"), "b"),
    (8, "x y " * 4000, "c"),
    (9, "Ünïcödé 漢字 text with \x85 odd　spaces  \n\n and 'quotes' it's 12345", "c"),
    (9, "Ünïcödé 漢字 text with \x85 odd　spaces  \n\n and 'quotes' it's 12345", "c"),
    (None, "a text without an id", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, "clash", "clash", 1, 0.5) for i, t, s in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def words(text):
    return (text or "").encode().lower().split()


# quality


def test_quality_counts(odd, empty):
    rows = quality.score_quality(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_words"], by[2]["n_words"], by[3]["n_words"]) == (0, 0, 0) and by[1]["base_failed"] and not by[1]["kept"]
    assert by[8]["n_words"] == 8000 and by[8]["n_repeat_words"] == 8000 and not by[8]["kept"]
    assert by[5]["n_repeat_words"] == by[5]["n_words"]
    assert quality.score_quality(empty).count() == 0


def test_repeat_words_brute(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(0, 40))) for _ in range(60)]

    def brute(t):
        w = t.split()
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        return len({j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["m"]["n_repeat_words"] for r in df.select("doc_id", quality.measures(F.col("text")).alias("m")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


# tokens


def test_bpe_round_trip(odd, empty):
    out = bpe.decode(bpe.encode(odd)).collect()
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    want = collections.Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in ODD)
    assert collections.Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == want
    assert bpe.encode(empty).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_bpe_decodes_where_it_reassembles(spark, odd, empty, monkeypatch):
    # a task of two Python stages has two workers, each with the memory of a block
    plan = bpe.op2_bpe(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], bytes(r["ids"]))
    apart = sorted(bpe.decode(bpe.encode(odd)).collect(), key=key)
    assert sorted(bpe.round_trip(odd).collect(), key=key) == apart
    assert bpe.round_trip(empty).count() == 0
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)  # of a batch here; workers keep their own
    ids = bpe._ids_table([1, 2, 3], np.array([20, 0, 40]), np.arange(60))
    path = public_tokenizers.path(bpe.RANKS)
    batches = list(bpe.decoder(path)(ids.to_batches()))
    assert [r for b in batches for r in b.column("decoded").to_pylist()] == [bpe.encoding(path).decode_bytes(x) for x in (range(20), [], range(20, 60))]


def test_units_tokenise_apart():
    rng = np.random.default_rng(4)
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    parts = [" ", "  ", "\n", "\t", " ", "a", "'s", "12", "é", "!?", "word", "\x1c", " "]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        maker = blocks.SpacedUnits()
        codes, units = maker.codes(text.encode()), maker.units()
        assert [i for c in codes for i in enc.encode_ordinary(units[c].decode())] == enc.encode_ordinary(text)


# mixing


def test_mix_awkward_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r["row"]["source"]] += r["taken"]
        target[r["row"]["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.mix(empty).count() == 0
    again = sorted((str(r["row"]), r["taken"]) for r in mixing.mix(odd).collect())
    assert again == sorted((str(r["row"]), r["taken"]) for r in rows)
    assert mixing.apply_mix(odd).columns == odd.columns


def off_target(out):
    """By source: words taken beyond the target."""
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r["row"]["source"]] += r["taken"]
        target[r["row"]["source"]] = r["target"]
    return {s: taken[s] - t for s, t in target.items()}


def test_mix_comes_near(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 5 if i % 3 else 0}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = mixing.mix(df).collect()
    off = off_target(out)
    assert all(abs(v) <= 120 for v in off.values()) and abs(sum(off.values())) <= 60
    # the sample is drawn by unequal odds: a share f of the documents of each source, and f differs by source
    drawn, n, f = collections.Counter(), collections.Counter(), {}
    for r in out:
        s = r["row"]["source"]
        whole = int(r["target"] // r["source_size"])
        f[s] = r["target"] / r["source_size"] - whole
        drawn[s] += r["copies"] - whole
        n[s] += 1
        assert r["copies"] - whole in (0, 1)
    assert len({round(v, 3) for v in f.values()}) > 1
    assert all(abs(drawn[s] / n[s] - f[s]) < 0.1 for s in f)
    # another seed draws others
    assert sorted((str(r["row"]), r["copies"]) for r in mixing.mix(df, seed=8).collect()) != sorted((str(r["row"]), r["copies"]) for r in out)


@pytest.mark.parametrize("kind", ["null ids", "equal rows", "equal sizes", "one long text"])
def test_mix_comes_near_in_awkward_tables(spark, kind):
    rows = []
    for i in range(3000):
        text = {"equal rows": "w " * 50, "equal sizes": f"w{i} " * 50, "one long text": f"w{i} " * (20_000 if i == 0 else 50)}.get(kind, f"w{i} " * 50)
        rows.append((None if i % 2 and kind == "null ids" else 1 if i % 2 and kind == "equal rows" else i, text, f"s{i % 3}"))
    out = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(3)).collect()
    assert len(out) == 3000
    # within two documents in a hundred of the source, or the one long text
    most = 20_000 if kind == "one long text" else 0.02 * 50_000
    assert all(abs(v) <= most for v in off_target(out).values()), off_target(out)


# sharding


def test_shards_number_heavy_hashes_and_ties(spark):
    rows = [(i, "same text") for i in range(600)] + [(None, "same text")] * 50 + [(i, f"text {i}") for i in range(300)] + [(7, "tie"), (7, "tie")]
    keyed = sharding.sort_keys(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("shard", F.pmod(F.col("hi"), F.lit(3)))
    out = sharding.number_rows(keyed, spread=16).collect()
    assert len(out) == len(rows)
    for k in range(3):
        own = sorted((r["slot"], r["hi"], r["lo"]) for r in out if r["shard"] == k)
        assert [r[0] for r in own] == list(range(len(own)))
        assert [r[1:] for r in own] == sorted(r[1:] for r in own)


def test_shards(spark, odd, empty):
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ODD)
    crc = {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert crc == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ODD}
    assert sharding.shard(empty).count() == 0
    hot = spark.createDataFrame([(i, "same text here" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id int, text string")
    out = sharding.shard(hot).toPandas()
    held = out.groupby("shard")["size"].sum()
    assert len(held) == 24 and held.max() - held.min() <= 2 * out["size"].max()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


# near-duplicates


def brute_parts(texts, size, percent):
    sets = {i: set(zip(*(words(t)[k:] for k in range(size)), strict=False)) or ({tuple(words(t))} if words(t) else set()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_brute(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, base = {}, rng.choice(vocabulary, 120)
    for i in range(90):
        t = (base if i < 60 else rng.choice(vocabulary, 80)).copy()
        t[rng.integers(0, len(t), rng.integers(0, 12))] = "edit"
        texts[i] = " ".join(t)
    texts |= {200: "", 201: None, 202: "one", 203: "ONE", 204: texts[3], 205: texts[70].upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    out = {r["doc_id"]: r for r in neardup.near_duplicates(df, size=2).collect()}
    parts, sizes = brute_parts(texts, 2, 80)
    assert {i: r["component_id"] for i, r in out.items()} == parts
    assert {i: r["n_shingles"] for i, r in out.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_near_duplicates_awkward(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["kept"] and by[1]["kept"]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_join_the_sets_of_one_id(spark):
    # 5 has two texts: one is 1's, the other 9's; 2 and 3 are alike, null ids are apart
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (7, b + " end"), (2, c), (3, c + " end"), (None, a), (4, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"] is not None) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (5, 1), (7, 1), (9, 1)]
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]


def test_components_walk_only_what_is_new(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(components, "stage", lambda df, label, to=components.stage: staged.append(label) or to(df, label))
    star = spark.createDataFrame([(9, 1), (8, 1), (7, 1), (4, 3)], "a long, b long")
    parts = {r["id"]: r["component_id"] for r in components.connected(star).collect()}
    assert parts == {1: 1, 7: 1, 8: 1, 9: 1, 3: 3, 4: 3} and staged == ["links"]
    held = spark.createDataFrame([*parts.items(), (20, 20)], "id long, component_id long")
    new = spark.createDataFrame([(4, 9), (8, 7)], "a long, b long")
    assert {r["id"]: r["component_id"] for r in components.merged(held, new).collect()} == {1: 1, 7: 1, 8: 1, 9: 1, 3: 1, 4: 1, 20: 20}
    assert "large-star" not in staged


def test_parity_bits_are_a_bound():
    rng = np.random.default_rng(7)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 400, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        differ = sum(bin(int(a) & (2**64 - 1)).count("1") for a in neardup.parity(x) ^ neardup.parity(y))
        assert differ <= len(np.setxor1d(x, y))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a long, b long")
    out = {r["id"]: r["component_id"] for r in components.connected(df).collect()}
    assert out == {i: 0 for i in range(201)} | {900: 900, 901: 900}


# urls


def judged(df, hosts=None, rules=None):
    spark = df.sparkSession
    return urls.judge(df, urls.rule_table(spark, rules), urls.url_list(urls.spam_urls(spark, hosts)))


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://X.COM/a"), (4, "https://a.example.com/en/x?q#f"), (5, "https://www.example.com/en/"), (6, "http://b.net/es/1"), (7, "http://notexample.com"), (8, "http://spam-farm.example.org/x"), (8, "http://spam-farm.example.org/x"), (9, "http://?q")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id int, url string, host string, key string")
    out = collections.Counter((r["page_id"], r["rule"], r["verdict"]) for r in judged(df).collect())
    assert out == collections.Counter([(1, None, "allow"), (2, None, "allow"), (3, "com/", "allow"), (4, "example.com/en/", "block"), (5, "www.example.com/en/", "allow"), (6, "net/es/", "block"), (7, None, "allow"), (8, None, "block"), (8, None, "block"), (9, None, "allow")])
    assert judged(df.limit(0)).count() == 0
    assert {r["verdict"] for r in judged(df, [], []).collect()} == {"allow"}


def test_listed_urls_are_canonical(spark):
    listed = urls.url_list(spark.createDataFrame([("http://user@Bad.test:80/",), ("https://ok.test/bad/",), (None,), ("no url",)], "url string"))
    assert sorted((r["host"], r["path"]) for r in listed.collect()) == [("bad.test", ""), ("ok.test", "/bad/")]
    rows = [(1, "http://bad.test"), (2, "http://a.BAD.test:8080/x"), (3, "http://me:pw@bad.test./?q"), (4, "http://ok.test/good"), (5, "http://ok.test/bad/1"), (6, "http://notbad.test/"), (7, "http://" + "a." * 3000 + "bad.test/" + "p/" * 30_000)]
    out = urls.judge(spark.createDataFrame(rows, "page_id int, url string"), urls.rule_table(spark, []), listed).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {1, 2, 3, 5, 7} and len(out) == 7


def test_bloom_has_no_misses_and_few_false_hits(spark):
    entries = spark.createDataFrame([(f"h{i}.test/",) for i in range(2000)], "key string")
    assert urls.possible(entries, entries).count() == 2000
    assert urls.possible(spark.range(20000).select(F.concat(F.lit("other"), F.col("id"), F.lit(".test/")).alias("key")), entries).count() < 600


# chat


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "more"), (4, 0, None, "alone"), (None, 0, "user", "lost"),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    out = {r["pair_id"]: r for r in chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    hi = "<|user|>\nhi<|end|>\n"
    assert (out[0]["prompt"], out[0]["prompt_turns"]) == (hi, 1)
    assert out[0]["chosen"] == "<|assistant|>\ngood<|end|>\n" and out[0]["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    spans = out[0]["chosen_learned"]
    assert [out[0]["chosen"][s["start"] : s["end"]] for s in spans] == ["good<|end|>\n"]
    assert out[1]["prompt_turns"] == 1 and out[1]["chosen"] == "" and out[1]["chosen_learned"] == []
    assert out[2]["prompt_turns"] == 0 and out[2]["rejected"] == "" and out[2]["chosen"] == "<|unknown|>\nalone<|end|>\n"
    assert chat.preference_pairs(turns.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


# toxicity


def test_label_model_brute(spark):
    rng = np.random.default_rng(31)
    n, rows = 5, []
    for i in range(400):
        toxic = i % 4 == 0
        fired = [k for k in range(n) if rng.random() < (0.6 if toxic else 0.04)]
        fired += [4] if 3 in fired and 4 not in fired else []  # voter 4 repeats voter 3
        rows.append((i, sorted(fired)))
    votes = spark.createDataFrame(rows, "doc_id long, fired array<int>")
    model = toxicity.fit_label_model(votes, n, rounds=4)
    # the same expectation maximisation, row by row
    odds, fires, tied = -2.2, [5.0] * n, [[0.0] * n for _ in range(n)]
    for _ in range(4):
        yes = no = 0.0
        both, other = np.zeros((n, n)), np.zeros(n)
        for _, fired in rows:
            evidence = sum(fires[j] / (1 + sum(tied[i][j] for i in fired)) for j in fired)
            p = 1 / (1 + np.exp(-(odds + evidence))) if fired else toxicity.UNCOVERED
            yes, no = yes + p, no + 1 - p
            for i in fired:
                other[i] += 1 - p
                for j in fired:
                    both[i, j] += p
        b = (other + 0.05) / (no + 1)
        a = np.maximum((np.diag(both) + 0.5) / (yes + 1), b)
        odds, fires = np.log((yes + 1) / (no + 1)), np.log(a / b)
        tied = [[0.0 if i == j else min(1, max(0, (both[i, j] / (yes + 1) - a[i] * a[j]) / max(np.sqrt(a[i] * (1 - a[i]) * a[j] * (1 - a[j])), 1e-9))) for j in range(n)] for i in range(n)]
    assert model.odds == pytest.approx(odds) and model.fires == pytest.approx(fires)
    assert model.tied == pytest.approx(np.array(tied)) and model.tied[3, 4] > 0.5
    found = model.posterior([f for _, f in rows])[0]
    assert np.mean((found > 0.5) == (np.arange(400) % 4 == 0)) > 0.8  # calling none toxic gives 0.75


def test_toxicity_repeated_ids_and_clashing_columns(spark):
    rows = [(1, f"idiot text {i}", "x", 1, 0.5) for i in range(50)] + [(2, "a plain text", "x", 1, 0.5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string, toxic int, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(docs, labels).count() == 53
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        toxic = i % 10 == 0
        t = list(rng.choice([f"plain{k}" for k in range(400)], 60))
        if toxic:
            t[5] = t[30] = str(rng.choice(["idiot", "zorkule", "zorkmin", "zorkad"]))
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    wrong = [i for i, _, y in rows if out[i]["predicted"] != y and out[i]["held_out"]]
    assert len(wrong) <= 3 and len(out) == 1503
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[5000]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items() if i is not None)
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_counts_uses(spark):
    rng = np.random.default_rng(14)
    rows = []
    for i in range(1200):
        toxic = i % 8 == 0
        t = list(rng.choice([f"plain{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)], 60))
        # one word of the kind stands in every eighth clean text, several stand in each toxic one
        for at in rng.choice(60, 5 if toxic else int(i % 8 == 1), replace=False):
            t[at] = "achl" + "".join(rng.choice(list("abcdefgh"), 5))
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert sum(out[i]["predicted"] != y for i, _, y in rows if out[i]["held_out"]) <= 3
    words_in = toxicity.words_of(b"achlum achlor Plain")
    assert {"achl*", "achl*#2", "achlu*", "plain"} <= toxicity.forms(words_in) and "achlu*#2" not in toxicity.forms(words_in)
    names = sorted(toxicity.forms(words_in)) + ["achl*#4", "other"]
    assert toxicity.found(words_in, {f: f for f in names}) == toxicity.forms(words_in)


# vectors


def brute_links(vectors_in):
    """Links of each row by comparing all pairs of its length in double precision."""
    out = np.zeros(len(vectors_in), int)
    sizes = np.array([len(v) for v in vectors_in])
    for n in set(sizes):
        at = np.flatnonzero(sizes == n)
        x = np.array([vectors_in[i] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        out[at] = near.sum(1)
    return out


def test_vectors_brute(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 16))
    x[100:160] = x[0] + 0.05 * rng.standard_normal((60, 16))  # a tight group
    x[160:190] = x[1] + 0.21 * rng.standard_normal((30, 16))  # a loose one
    x[200:203] = x[2]
    good = [r.tolist() for r in x]
    # other lengths do not disturb: one alone, and a pair of 9 components
    good += [[1.0] * 17, [float(i) for i in range(9)], [float(i) + 0.01 for i in range(9)]]
    odd_rows = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0, None] + [1.0] * 14), (905, []), (906, [float("inf")] * 16), (None, good[0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in [*enumerate(good), *odd_rows]], "vec_id long, embedding array<double>, component_id string")
    out = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert [out[i]["n_links"] for i in range(len(good))] == brute_links(good).tolist()
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i, _ in odd_rows)
    assert [out[i]["component_id"] for i in (301, 302)] == [301, 301] and out[300]["kept"]
    assert vectors.near_vectors(df.limit(0)).count() == 0
    # the order of the lengths does not matter, and neither do more long vectors than short ones
    assert vectors.near_vectors(df.where("size(embedding) = 17")).first()["n_links"] == 0


def test_vectors_repeated_rows_and_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [-1.0, 0.0])]
    out = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 1, False), (3, 3, 1, False), (4, 0, 4, True)]


def test_vectors_double_precision(spark):
    # cosines that differ from 0.95 by less than single precision can tell
    c = 0.95
    above, below = [c + 1e-10, np.sqrt(1 - (c + 1e-10) ** 2)], [c - 1e-10, -np.sqrt(1 - (c - 1e-10) ** 2)]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float(v) for v in above]), (2, [float(v) for v in below])], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in vectors.near_vectors(df).orderBy("vec_id").collect()] == [1, 1, 0]


def test_vector_windows_cross_partitions(spark):
    # one pass over many partitions finds what the same pass finds in one
    rng = np.random.default_rng(21)
    x = rng.standard_normal((400, 8))
    x[200:] = x[:200] + 0.1 * rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, r.tolist(), 1, i) for i, r in enumerate(x)], "id long, v array<double>, n long, k long")
    links = {}
    for parts in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = vectors.half_links(df, 0, 3, np.zeros(8), 16, 0.95)
        links[parts] = {tuple(sorted((r["id"], r["component_id"]))) for r in components.connected(found.where("a <> b")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert links[1] == links[40] and len(links[1]) > 100


def cone_table(n_easy, n_cone, n_hard, size=64, seed=8):
    """Easy pairs at cosine 0.97 among unlike vectors, and pairs at 0.952 in a cone of mutual cosine 0.8: (vectors, first hard row)."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)

    def beside(x, cosine):
        other = rng.standard_normal(x.shape)
        other = unit(other - (other * x).sum(1, keepdims=True) * x)
        return cosine * x + np.sqrt(1 - cosine * cosine) * other

    easy = unit(rng.standard_normal((n_easy, size)))
    axis = unit(rng.standard_normal(size))
    cone = unit(np.sqrt(0.8) * axis + np.sqrt(0.2) * unit(rng.standard_normal((n_cone, size))))
    hard = cone[:n_hard]
    return np.concatenate([easy, beside(easy, 0.97), hard, beside(hard, 0.952), cone[n_hard:]]), 2 * n_easy


def test_vectors_hard_pairs_behind_easy_ones(spark):
    x, at = cone_table(2_000, 4_000, 300)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}).to_pandas())
    part = {r["vec_id"]: r["component_id"] for r in vectors.near_vectors(df).collect()}
    assert sum(part[i] == part[i + 2_000] for i in range(2_000)) >= 0.99 * 2_000
    assert sum(part[at + i] == part[at + 300 + i] for i in range(300)) >= 0.95 * 300


def test_vectors_recall_at_the_threshold(spark):
    # 50,000 vectors, 500 planted pairs of cosine 0.95 to 0.96
    rng = np.random.default_rng(22)
    x = rng.standard_normal((50_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    across = rng.standard_normal((500, 32))
    across -= (across * x[:500]).sum(1, keepdims=True) * x[:500]
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, (500, 1))
    x[500:1000] = c * x[:500] + np.sqrt(1 - c * c) * across
    table = pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 32).cast(pa.list_(pa.float64()))})
    out = vectors.near_vectors(spark.createDataFrame(table.to_pandas())).where("vec_id < 1000 and n_links > 0").count()
    assert out >= 0.98 * 1000
    assert vectors.passes_for(10**9) > vectors.passes_for(10**6) > vectors.passes_for(50_000) > vectors.LEAST_PASSES


# language model


def test_lm_base_and_probabilities(spark, empty):
    rng = np.random.default_rng(10)
    docs = [(i, " ".join(rng.choice(["red", "green", "Blue", "unusualword"], rng.integers(0, 30), p=[0.5, 0.3, 0.15, 0.05]))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm.score_texts(df).collect()}
    counts = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        tokens = [*words(t), None]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert out[i]["base_score"] == pytest.approx(base, abs=1e-6)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert out[i]["score"] <= 0
    assert lm.score_texts(empty).count() == 0


def test_windows_score_every_place_once():
    counts = np.arange(lm.END + 1, 0, -1).astype(float)
    model = lm.Attention.start(counts)
    for n in (1, 15, 16, 17, 28, 29, 100):
        seen = np.zeros(n)
        for number in range(int(lm.window_counts(np.array([n]))[0])):
            _, _, weight, place = lm.window_rows(np.zeros(n, np.int64), np.array([0]), np.array([n]), np.array([number]))
            skip = lm.LENGTH - lm.STEP if number else 0
            np.add.at(seen, place[0, skip:][weight[0, skip:] > 0], 1)
        assert (seen == 1).all(), n
    # probabilities of all subwords after a context sum to one
    x = np.full((1, lm.LENGTH), lm.END)
    p = np.array([np.exp(model.log_p(x, np.full((1, lm.LENGTH), c), 0)[0, 0]) for c in range(lm.CLUSTERS)])
    share = np.bincount(model.cluster, np.exp(model.share), lm.CLUSTERS)
    assert (p * share).sum() == pytest.approx(1, abs=1e-4)


def test_places_do_not_depend_on_other_texts():
    rng = np.random.default_rng(13)
    texts = [np.append(rng.integers(0, 50_000, n), lm.END) for n in (0, 3, 15, 16, 40, 20_000)]
    model = lm.Attention.start(np.ones(lm.END + 1))
    together = model.places(np.concatenate(texts), np.array([len(t) for t in texts]))
    alone = np.concatenate([model.places(t, np.array([len(t)])) for t in texts])
    assert together == pytest.approx(alone, abs=1e-5)


def test_training_reads_whole_texts():
    # what follows subword 16 of a text does not occur before it
    texts = [np.array([1, 2] * 8 + [3, 4] * 40 + [lm.END])] * 20
    counts = np.bincount(np.concatenate(texts), minlength=lm.END + 1).astype(float)
    model = lm.Attention.start(counts)
    for _ in range(4):
        model.learn(np.concatenate(texts), np.array([len(t) for t in texts]), np.random.default_rng(1), 0.02)
    late = np.tile([4, 3], lm.LENGTH // 2)[None]
    assert np.exp(model.log_p(late, model.cluster[np.roll(late, -1, 1)], 4)).mean() > 0.8


def test_training_takes_every_place_of_every_block(monkeypatch):
    # more windows than LOCAL steps a round can take; each subword of a text is its place
    lengths = np.array([1, 16, 17, 25_000, 400_000, 5])
    values = np.tile(np.arange(lm.END), 10)[: lengths.sum()]
    model = lm.Attention.start(np.ones(lm.END + 1))
    model.cluster = np.arange(lm.END + 1)
    starts, at = set(np.cumsum(lengths).tolist()), {}
    for i in range(len(values)):
        at.setdefault((int(values[i - 1]) if i and i not in starts else lm.END, int(values[i])), []).append(i)
    uses = collections.Counter()

    def step(self, x, y, weight, skip=0):
        used = weight[:, skip:] > 0
        uses.update(zip(x[:, skip:][used].tolist(), y[:, skip:][used].tolist(), strict=True))
        return {}

    monkeypatch.setattr(lm.Attention, "step", step)
    code = {"key": 3, "block": 3, "bucket": 0, "a": lm.pack_codes(np.arange(len(lengths))), "b": lm.pack(np.ones(len(lengths), "<i8")), "c": lm.pack(np.zeros(2)), "d": lm.pack(np.concatenate([[len(lengths)], lengths, values]).astype("<u4")), "doc_ids": [None] * len(lengths)}
    for turn in range(lm.ROUNDS):
        list(lm.trainer(model, turn)([lm.table_of([tuple(code.values())], lm.PAIR_SCHEMA).to_batches()[0]]))
    assert all(len(places) <= uses[pair] <= len(places) + 3 * lm.LENGTH for pair, places in at.items())


def test_company_tells_subwords_of_one_band_apart():
    counts = np.ones(lm.END + 1)
    counts[:64] = 1e6
    a, b = np.flatnonzero(lm.Attention.start(counts).cluster == lm.Attention.start(counts).cluster[40_000])[:2]
    # a stands before 5, b before 6; so do their sums over the training texts
    sums = np.zeros((lm.END + 1, len(lm.SUMS)), np.int64)
    for x, y in ((a, 5), (b, 6)):
        sums[x, 1], sums[x, 3 : 3 + lm.WIDTH // 2] = 10_000, 10_000 * lm.signs(lm.END + 1)[y]
    model = lm.Attention.start(counts, lm.company(sums))
    texts = [np.array([a, 5] * 20 + [lm.END]), np.array([b, 6] * 20 + [lm.END])] * 10
    for _ in range(4):
        model.learn(np.concatenate(texts), np.array([len(t) for t in texts]), np.random.default_rng(1), 0.02)
    assert model.log_p(np.array([[lm.END, a]]), model.cluster[np.array([[a, 5]])], 1) > np.log(0.8)
    assert model.log_p(np.array([[lm.END, b]]), model.cluster[np.array([[b, 6]])], 1) > np.log(0.8)


def test_lm_scores_brute(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROUNDS", 1)
    rng = np.random.default_rng(12)
    vocabulary = ["red", "Green", "blue", "internationalisation", "Donaudampfschifffahrt", "x", "漢字", "qwzxkv"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(150)] + [(None, "red blue unseenword"), (7, None), (7, ""), (7, "again red"), (900, "word " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = lm.public_tokenizers.path(lm.RANKS)
    of = lm.learn(df, path)
    encode = lm.encoding(path).encode_ordinary
    spelled = lambda t: [*[encode(" " + w.decode()) for w in words(t)], [lm.END]]

    def contexts(t):
        last = lm.END
        for pieces in spelled(t):
            for j, piece in enumerate(pieces):
                yield (("start", last) if j == 0 else tuple(pieces[max(0, j - 3) : j]) if j >= 3 else ("whole", *pieces[:j])), piece
            last = pieces[-1]

    pairs = collections.Counter()
    for i, t in docs:
        if lm.is_training(i):
            pairs.update(contexts(t))
    total, kinds = collections.Counter(), collections.Counter()
    for (c, _), n in pairs.items():
        total[c] += n
        kinds[c] += 1
    want = []
    for i, t in docs:
        tokens = np.array([p for w in spelled(t) for p in w])
        score = 0.0
        for (c, piece), q in zip(contexts(t), of.model.places(tokens, np.array([len(tokens)])), strict=True):
            free = lm.DISCOUNT * kinds[c] / total[c] if total[c] else 1.0
            score += np.log10(max(pairs[c, piece] - lm.DISCOUNT, 0) / max(total[c], 1) + free * np.exp(q))
        want.append((str(i), len(spelled(t)), score))
    monkeypatch.setattr(lm, "learn", lambda *_: of)
    got = [(str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score_texts(df).collect()]
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert [g[2] for g in sorted(got)] == pytest.approx([w[2] for w in sorted(want)], rel=1e-4)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_lm_beats_its_base_where_all_words_are_known(spark):
    rows = [r for r in lm.op10_lm_scores(spark, SF.replace("0.001", "0.01")).collect() if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert len(rows) > 10
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def test_attention_gradients():
    model = lm.Attention.start(np.ones(lm.END + 1))
    rng = np.random.default_rng(11)
    x, y, w = rng.integers(0, lm.CLUSTERS, (3, lm.LENGTH)), rng.integers(0, lm.CLUSTERS, (3, lm.LENGTH)), np.ones((3, lm.LENGTH), np.float32)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    g = model.step(x, y, w)
    model.company = rng.standard_normal(model.company.shape)
    g = model.step(x, y, w)
    for name in "qkvoufp":
        i = (1, 2)
        loss = lambda: -model.log_p(x, y, 0).mean()  # noqa: B023, E731
        model.parts[name][i] += 1e-4
        up = loss()
        model.parts[name][i] -= 2e-4
        down = loss()
        model.parts[name][i] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[name][i], abs=1e-4), name


def test_a_step_costs_little_beside_its_class_products():
    # the yardstick are the products of 3,072 places with 96 classes there and back, and the powers between
    rng = np.random.default_rng(14)
    model = lm.Attention.start(np.ones(lm.END + 1))
    tokens, lengths = rng.integers(0, 3000, 120_000), np.array([120_000])
    places = rng.standard_normal((16, lm.BATCH * lm.STEP // 16, lm.WIDTH + 1)).astype(np.float32)
    classes = rng.standard_normal((lm.WIDTH + 1, lm.CLUSTERS)).astype(np.float32)

    # small products, which one thread takes everywhere
    def products():
        for _ in range(lm.LOCAL):
            p = np.exp(places @ classes)
            p @ classes.T, places.transpose(0, 2, 1) @ p

    def seconds(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    # in turns, so that other load on the machine meets both
    taken = [(seconds(lambda: model.copy().learn(tokens, lengths, np.random.default_rng(1), 0.02, 0, 2)), seconds(products)) for _ in range(15)]
    assert min(a for a, _ in taken) < 3.5 * min(b for _, b in taken)


def test_exponents_gone_astray_are_bounded():
    rng = np.random.default_rng(15)
    rows, by, y = rng.standard_normal((700, 17)).astype(np.float32), rng.standard_normal((17, lm.CLUSTERS)).astype(np.float32), rng.integers(0, lm.CLUSTERS, 700)
    for times in (1, 100):
        p, total, at, chosen = lm.powers(rows, by * times, y)
        plain = np.minimum(rows.astype(float) @ (by * times), 60)
        assert np.isfinite(p).all() and np.isfinite(total).all()
        assert np.log(total) == pytest.approx(np.log(np.exp(plain).sum(1)), abs=2e-3)
        assert chosen == pytest.approx(plain.reshape(-1)[at], abs=2e-3)
        assert (at % lm.CLUSTERS == y).all()
    assert lm.crossed(rows, rows[:, :5]) == pytest.approx(rows.T @ rows[:, :5], abs=1e-3)
    assert lm.times(rows, by) == pytest.approx(rows @ by, abs=1e-4)


# the pipeline


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_pipeline_stage_by_stage(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        step(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "minhash_neardup":
            parts, _ = brute_parts(before, 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == set(parts.values())
        if name != "bpe":
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    for r in docs.collect():
        want = np.array(enc.encode_ordinary(before[r["doc_id"]]), "<u4").tobytes()
        assert bytes(r["ids"]) == want and r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest()
