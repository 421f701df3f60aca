"""Quality rules as weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0). Texts fall into at most
3**rules vote patterns; an expectation-maximisation over the pattern counts
estimates how often each rule casts each vote on good and on bad texts, and the
posterior probability of "good" replaces an all-rules-must-pass filter.

Defined cases: a null text counts as empty; an empty text has zero counts and
fails the base rule; very long texts are taken whole; repeated rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bind, stage, words

# Frequent function words of the four languages served.
STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "that", "was", "for", "with",
    "de", "la", "le", "et", "les", "des", "en", "du", "un", "une",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "im", "auf",
    "el", "que", "los", "se", "del", "las", "por", "con", "una", "su",
]

ROUNDS = 25


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash within one text; sorted (hash, place)
    pairs bring equal windows together, so a text of n words takes n log n steps.
    """
    grams = F.slice(F.transform(tokens, lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2))), 1, F.greatest(F.size(tokens) - 2, F.lit(0)))

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | F.coalesce(p["h"] == F.get(pairs, k + 1)["h"], F.lit(False)))
        # get() counts from zero and gives null outside, so the ends compare as "not equal"
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, lambda p: p["i"])), start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]

    def of(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bind(pairs, covered))

    return bind(grams, of)


def measures(text: Column) -> Column:
    """All counts the rules need, as one struct; text must not be null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(tokens: Column) -> Column:
        long = lambda c, name: c.cast("long").alias(name)
        return F.struct(
            long(F.size(tokens), "n_words"),
            long(F.char_length(F.array_join(tokens, "")), "word_chars"),
            long(F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_symbols"),
            long(bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
            long(repeated_words(tokens), "n_repeat_words"),
            long(F.regexp_count(text, F.lit(r"\p{Lu}")), "n_upper"),
            long(F.regexp_count(text, F.lit("!")), "n_exclaim"),
            long(F.size(F.array_intersect(F.array(*[F.lit(w) for w in STOP_WORDS]), tokens)), "n_stop"),
        )

    return bind(words(text), of)


#: name, good if, bad if: over the columns of measures(); anything else abstains.
RULES = [
    ("symbols", "false", "10 * n_symbols > n_words"),
    ("dense_symbols", "false", "25 * n_symbols > word_chars"),
    ("shouting", "false", "10 * n_upper > 3 * word_chars"),
    ("exclaim", "false", "10 * n_exclaim > n_words"),
    ("repeats", "false", "20 * n_repeat_words > 9 * n_words"),
    ("dup_lines", "false", "n_dup_lines >= 3 and 2 * n_repeat_words > n_words"),
    ("function_words", "n_stop >= 3", "n_stop = 0"),
    ("plain", "50 * n_symbols <= n_words and 10 * n_upper <= word_chars and 10 * n_repeat_words <= n_words", "false"),
]


def vote(good: str, bad: str) -> str:
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def label_model(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> DataFrame:
    """One row: ``prior`` log odds and ``weights``, log likelihood ratios by rule and vote (-1, 0, 1).

    ``votes`` is aggregated to its patterns first (at most 3**len(names) rows, 6,561 for
    eight rules), so what meets in one task does not grow with the documents.
    """
    k = 3 * len(names)
    hot = F.array(*[F.when(F.col(n) == v, 1.0).otherwise(0.0) for n in names for v in (-1, 0, 1)])
    score = sum((F.col(n) for n in names), F.lit(0)).cast("double")
    patterns = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    row = F.struct(*names, F.col("n"), hot.alias("o"), (1 / (1 + F.exp(-score))).alias("p"))
    table = patterns.agg(F.sort_array(F.collect_list(row)).alias("pats"))

    def total(weight: str) -> str:
        return (
            f"aggregate(zip_with(pats, post, (r, w) -> transform(r.o, o -> o * r.n * {weight})), array_repeat(0.5D, {k}), "
            "(a, x) -> zip_with(a, x, (u, v) -> u + v))"
        )

    def count(weight: str) -> str:
        return f"aggregate(zip_with(pats, post, (r, w) -> r.n * {weight}), 0D, (a, x) -> a + x)"

    learned = (
        "transform(transform(array(named_struct("
        f"'g', {total('w')}, 'b', {total('(1 - w)')}, 'ng', {count('w')}, 'nb', {count('(1 - w)')})), "
        "m -> named_struct('prior', ln((m.ng + 1) / (m.nb + 1)), 'weights', "
        "zip_with(m.g, m.b, (g, b) -> ln(g / (m.ng + 1.5)) - ln(b / (m.nb + 1.5))))), m -> {body})[0]"
    )
    expect = "transform(pats, r -> 1 / (1 + exp(-aggregate(zip_with(m.weights, r.o, (l, o) -> l * o), m.prior, (a, x) -> a + x))))"
    fitted = table.select("pats", F.expr(f"aggregate(sequence(1, {rounds}), transform(pats, r -> r.p), (post, it) -> {learned.format(body=expect)})").alias("post"))
    return fitted.select(F.expr(learned.format(body="m")).alias("m")).select("m.prior", "m.weights")


NAMES = [f"vote_{name}" for name, _, _ in RULES]


def cast_votes(docs: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns, the counts and the votes of every row of docs."""
    counted = docs.select(*carried, measures(F.coalesce(F.col("text"), F.lit(""))).alias("m")).select("*", "m.*").drop("m")
    return counted.select("*", *[F.expr(vote(good, bad)).alias(f"vote_{name}") for name, good, bad in RULES])


def judged(voted: DataFrame, votes: DataFrame, rounds: int) -> DataFrame:
    """voted with base_failed, posterior and kept, by the label model of votes."""
    model = label_model(votes, NAMES, rounds).first()
    odds = F.lit(model["prior"])
    for j, name in enumerate(NAMES):
        low, none, high = model["weights"][3 * j : 3 * j + 3]
        odds = odds + F.when(F.col(name) == -1, low).when(F.col(name) == 0, none).otherwise(high)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def score_quality(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept for every row of docs."""
    voted = stage(cast_votes(docs, F.col("doc_id")), "quality-votes")
    return judged(voted, voted, rounds)


def keep_good(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs that are kept, all columns: texts are counted twice so that they need not move."""
    voted = cast_votes(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return judged(voted, voted.select(*NAMES), rounds).where("kept").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BREAKS = r"[\x20\x09-\x0D]+"


def quality_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the same result; the recursion runs the same expectation-maximisation."""
    names = [f"vote_{name}" for name, _, _ in RULES]
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    terms = " + ".join(
        f"ln((0.5 + sum(n * p) over (partition by it, {v})) / (1.5 + sum(n * p) over (partition by it))) - ln((0.5 + sum(n * (1 - p)) over (partition by it, {v})) / (1.5 + sum(n * (1 - p)) over (partition by it)))"
        for v in names
    )
    odds = f"ln((1 + sum(n * p) over (partition by it)) / (1 + sum(n * (1 - p)) over (partition by it))) + {terms}"
    return f"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, list_filter(regexp_split_to_array(text, '{_BREAKS}'), lambda x: x <> '') as ws from d),
pos as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from w),
tri as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from pos window o as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as c from tri where g is not null) where c > 1),
rep as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from again) group by r),
ln as (select r, unnest(string_split(text, chr(10))) as l from d),
dup as (select r, count(l) - count(distinct l) as n_dup_lines from ln where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by r),
m as (select d.r, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as n_upper, length(text) - length(replace(text, '!', '')) as n_exclaim, len(list_intersect([{stop}], ws)) as n_stop
  from d join w using (r) left join rep using (r) left join dup using (r)),
v as (select *, {", ".join(f"{vote(g, b)} as vote_{n}" for n, g, b in RULES)} from m),
pat as (select {", ".join(names)}, count(*)::double as n from v group by all),
em as (select 0 as it, {", ".join(names)}, n, 1 / (1 + exp(-({" + ".join(names)})::double)) as p from pat
  union all select it + 1, {", ".join(names)}, n, 1 / (1 + exp(-({odds}))) from em where it < {rounds + 1}),
post as (select {", ".join(names)}, p from em where it = {rounds + 1})
select doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and p >= 0.5 as kept
from v join post using ({", ".join(names)})"""
