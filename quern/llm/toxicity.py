"""Toxicity by weak supervision: many lexicon and pattern voters, a label model, a linear classifier.

Voters fire on a word (lexicon) or on words that begin alike (pattern) and abstain
otherwise: a fixed list, and words and word beginnings mined from labelled training
rows: the MINED most significant of those that tell toxic texts apart LIFT times. A
generative label model estimates, over all documents, how often each voter
fires on toxic and on other texts, and how strongly voters are correlated inside the
toxic class; correlated voters share their weight. A logistic classifier learns the
posterior labels from the words of a bounded sample of training rows and scores all.

Labels, lang, source and doc_id are no inputs of a score; rows with
crc32(doc_id) mod 3 = 1 are held out of all learning from labels.

Defined cases: a null or empty text has no words and gets the classifier's base score;
very long texts are read whole; repeated rows each get their row, and of rows that
share a doc_id the least text teaches; without labels only
the fixed voters teach; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_sample, stage

# Insults that vote on their own.
LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting"]

BEGINNINGS = (4, 5, 6, 7, 8)  # letters of a word beginning
REPEATS = (2, 4, 8)  # uses that make a form of their own
SIGNIFICANT = 30.0  # log-likelihood ratio of a voter; by chance one of 20 million forms has it
LIFT = 15.0  # how many times as often a voter fires on toxic texts as on others
MINED = 48  # voters beside the lexicon: many weak ones count one thing often, and the label model drifts
TOXIC_ROWS = 8_000  # labelled or posterior-labelled rows learned from, at most, of each kind
OTHER_ROWS = 16_000
FEATURES = 1_024  # of the classifier
ROUNDS = 6
UNCOVERED = 0.01
THRESHOLD = 0.7

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> Counter:
    """The words of a text and their uses."""
    return Counter(LETTERS.findall((text or b"").decode("utf-8", "replace").lower()))


def forms(words: Counter) -> set[str]:
    """The words, with a star the beginnings of longer ones, and with #n either that has n uses or more."""
    uses: dict[str, int] = dict(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                start = w[:k] + "*"
                uses[start] = uses.get(start, 0) + n
    return set(uses).union(f"{f}#{k}" for f, n in uses.items() if n > 1 for k in REPEATS if n >= k)


def found(words: Counter, known: dict) -> set:
    """Values of known for the forms that occur, without making all forms of all words."""
    stems = known.get("*stems")
    if stems is None:
        stems = {}
        for form in known:
            stem, _, least = form.partition("#")
            stems.setdefault(stem, []).append((int(least or 1), known[form]))
        known["*stems"] = stems
        known["*starts"] = [(k, {f[:-1] for f in stems if f.endswith("*") and len(f) == k + 1}) for k in BEGINNINGS]
    uses = {w: words[w] for w in words.keys() & stems.keys()}
    for k, starts in known["*starts"]:
        if starts:
            for w, n in words.items():
                if len(w) > k and w[:k] in starts:
                    start = w[:k] + "*"
                    uses[start] = uses.get(start, 0) + n
    return {value for stem, n in uses.items() for least, value in stems[stem] if n >= least}


def counted_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic, other): in how many texts of (text, weight) it occurs; weight is the chance of toxic."""
    toxic, other = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(toxic.keys() | other.keys())
        out = [pa.array(names), pa.array([float(toxic[n]) for n in names]), pa.array([float(other[n]) for n in names])]
        return pa.RecordBatch.from_arrays(out, names=["form", "toxic", "other"])

    for batch in batches:
        for text, p in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            (toxic if p >= 0.5 else other).update(forms(words_of(text.as_py())))
            if len(toxic) + len(other) > 400_000:
                yield flush()
                toxic.clear()
                other.clear()
    yield flush()


def telling_forms(sample: DataFrame, toxic: int, other: int, most: int | None = None, lift: float = 1.0) -> list[str]:
    """The forms of the sample (text, p) that tell toxic texts apart with significance, best first.

    A form that implies a better one, or that a better one implies, is left out.
    """
    counts = sample.select("text", "p").mapInArrow(counted_forms, "form string, toxic double, other double").groupBy("form").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    t, o = F.col("t"), F.col("o")
    share = (t + o) / max(toxic + other, 1)
    term = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    inside = term(t, share * toxic) + term(o, share * other)
    outside = term(toxic - t, (1 - share) * toxic) + term(other - o, (1 - share) * other)
    good = counts.withColumn("g", 2 * (inside + outside)).where((t * max(other, 1) > lift * o * max(toxic, 1)) & (F.col("g") >= SIGNIFICANT))
    kept, below, above = [], set(), set()
    for form in (r["form"] for r in good.orderBy(F.desc("g"), "form").select("form").collect()):  # of a bounded sample
        stem = form.partition("#")[0]
        word = stem.rstrip("*")
        whole = [stem, *(word[:k] + "*" for k in BEGINNINGS if k <= len(word))]
        if stem in above or below.intersection(whole):
            continue
        kept.append(form)
        below.add(stem)
        above.update(whole)
        if most and len(kept) == most:
            break
    return kept


def voting(voters: list[str]):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {v: i for i, v in enumerate(voters)}
        for batch in batches:
            fired = [sorted(found(words_of(t.as_py()), known)) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32()))], names=["doc_id", "fired"])

    return vote


class LabelModel:
    """Firing rates of voters on toxic and other texts, and their correlations on toxic ones.

    A text's evidence is the sum of its firing voters' log likelihood ratios, each divided
    by one plus its correlations with the others that fire there, so voters that say the
    same count once. A text on which all abstain is held for UNCOVERED.
    """

    def __init__(self, n: int):
        self.n, self.odds, self.fires, self.tied = n, -2.2, np.full(n, 5.0), np.zeros((n, n))

    def posterior(self, fired: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        hot = np.zeros((len(fired), self.n))
        for i, f in enumerate(fired):
            hot[i, f] = 1
        evidence = (hot * self.fires / (1 + hot @ self.tied)).sum(1)
        return np.where(hot.any(1), 1 / (1 + np.exp(-(self.odds + evidence))), UNCOVERED), hot

    def sums(self):
        """mapInArrow function from fired to (place, value): expected counts, to be summed by place."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            upper = np.triu_indices(self.n)
            total = np.zeros(len(upper[0]) + self.n + 2)
            for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
                p, hot = self.posterior(batch.column(0).to_pylist())
                total += np.concatenate([((hot * p[:, None]).T @ hot)[upper], (1 - p) @ hot, [p.sum(), (1 - p).sum()]])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["place", "value"])

        return add

    def fit(self, total: np.ndarray) -> None:
        n = self.n
        both, other, (yes, no) = np.zeros((n, n)), total[-n - 2 : -2], total[-2:]
        both[np.triu_indices(n)] = total[: -n - 2]
        on = np.diag(both)
        both = both + both.T - np.diag(on)
        a, b = (on + 0.5) / (yes + 1), (other + 0.05) / (no + 1)
        a = np.maximum(a, b)
        spread = np.sqrt(np.outer(a * (1 - a), a * (1 - a)))
        tied = np.clip((both / (yes + 1) - np.outer(a, a)) / np.maximum(spread, 1e-9), 0, 1)
        np.fill_diagonal(tied, 0)
        self.fires, self.tied = np.log(a / b), tied
        self.odds = float(np.log((yes + 1) / (no + 1)))


def fit_label_model(votes: DataFrame, n: int, rounds: int = ROUNDS) -> LabelModel:
    model = LabelModel(n)
    for _ in range(rounds):
        total = np.zeros(n * (n + 1) // 2 + n + 2)
        # a number for each pair of voters at most, as Arrow: a driver row for each would take twenty times as much
        summed = votes.select("fired").mapInArrow(model.sums(), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        total[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
        model.fit(total)
    return model


def fit_linear(rows: list[tuple[list[int], float]], n: int) -> tuple[np.ndarray, float]:
    """Logistic weights and bias for (features present, chance of toxic), by Adam on mini-batches."""
    rng, weights, bias = np.random.default_rng(3), np.zeros(n), -2.0
    hot = np.zeros((len(rows), n), np.uint8)
    for i, (f, _) in enumerate(rows):
        hot[i, f] = 1
    y = np.array([p for _, p in rows])
    m, v, t = np.zeros(n + 1), np.zeros(n + 1), 0
    for _ in range(max(20, 1500 * 256 // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 256):
            x = hot[order[at : at + 256]].astype(np.float64)
            e = 1 / (1 + np.exp(-(x @ weights + bias))) - y[order[at : at + 256]]
            g = np.append(x.T @ e / len(e) + 1e-4 * weights, e.mean())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            weights, bias = weights - step[:-1], bias - step[-1]
    return weights, bias


def scoring(weights: dict[str, float], bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(weights)
        known, value = {w: i for i, w in enumerate(names)}, np.array([weights[w] for w in names])
        for batch in batches:
            odds = [bias + float(value[sorted(found(words_of(t.as_py()), known))].sum()) for t in batch.column(1).cast(pa.binary())]
            p = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return score


def held_out(doc_id):
    """crc32 of doc_id as text, mod 3, is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text and p of the chosen documents (doc_id, p), which have a stated bound; of rows that share a doc_id the least text."""
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("p").alias("p"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of word forms and a bias, learned from docs (doc_id, text) and labels (doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("p"))
    taught = stage(bounded_sample(known.where("p >= 0.5"), TOXIC_ROWS).union(bounded_sample(known.where("p < 0.5"), OTHER_ROWS)), "taught")
    # at most TOXIC_ROWS + OTHER_ROWS rows of two numbers, so the broadcast is bounded
    sample = stage(one_text_each(docs, taught), "taught-texts")
    n = {r["t"]: r["n"] for r in taught.groupBy((F.col("p") >= 0.5).alias("t")).agg(F.count("*").alias("n")).collect()}
    voters = list(dict.fromkeys([*LEXICON, *telling_forms(sample, n.get(True, 0), n.get(False, 0), MINED, LIFT)]))
    votes = stage(docs.mapInArrow(voting(voters), "doc_id long, fired array<int>"), "votes")
    model = fit_label_model(votes, len(voters))

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.posterior(batch.column(1).to_pylist())[0])], names=["doc_id", "p"])

    judged = votes.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).mapInArrow(posteriors, "doc_id long, p double").dropDuplicates(["doc_id"])
    judged = stage(judged, "posteriors")
    chosen = stage(bounded_sample(judged.where("p >= 0.5"), TOXIC_ROWS).union(bounded_sample(judged.where("p < 0.5"), OTHER_ROWS)), "chosen")
    texts = stage(one_text_each(docs, chosen), "chosen-texts")
    n = {r["t"]: r["n"] for r in chosen.groupBy((F.col("p") >= 0.5).alias("t")).agg(F.count("*").alias("n")).collect()}
    names = telling_forms(texts, n.get(True, 0), n.get(False, 0), FEATURES)
    names = list(dict.fromkeys([*LEXICON, *names]))[:FEATURES]
    present = texts.select("doc_id", "text").mapInArrow(voting(names), "doc_id long, fired array<int>").join(F.broadcast(chosen), "doc_id")
    found = present.select("fired", "p").toArrow()  # bounded as above
    rows = sorted(zip(found.column("fired").to_pylist(), found.column("p").to_pylist(), strict=True))
    if not rows:
        return {w: 6.0 for w in LEXICON}, -3.0
    weights, bias = fit_linear(rows, len(names))
    return dict(zip(names, weights.tolist(), strict=True)), float(bias)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights, bias = fit(docs, labels)
    scored = docs.mapInArrow(scoring(weights, bias), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns; scored where they stand."""
    weights, bias = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    score = scoring(weights, bias)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])
            (scores,) = score(iter([pair]))
            yield batch.filter(pa.array(scores.column("score").to_numpy() < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
