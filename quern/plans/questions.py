"""Query variations, pools and author scans over the benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import query_terms, searchable, terms
from quern.operators import lexical as X
from quern.operators import notes as N
from quern.operators import questions as Q
from quern.operators import retrieval as R
from quern.plans.base import Plan
from quern.plans.retrieval import BM25_CTE, RANKED, STOPS, TOKENS, kept_index, ranked
from quern.plans.texts import SEARCH
from quern.sources.shared import staged
from quern.sources.tables import documents, table

plan = Plan()

# Rules over words that the passages use, in the four languages of the tables.
RULES = (
    Q.Rule(((" the ", " of "), (" and ", " that ")), ("the other and that", "ion of the ation"), ("other",)),
    Q.Rule(((" que ",), (" la ", " les ")), ("que la ment", "les tion de"), ("ment", "tion")),
    Q.Rule(((" die ", " der ", " und "),), ("die ung und der", "ver schen keit")),
    Q.Rule((("ing",), ("tion", "ment")), ("the other and that", "ing in the")),
)
MARKS = (" in the ", " de la ", " in der ")
TOPICS = ("the house and the other people", "und die keit der ung", "que les entre ment")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


def _any(words) -> str:
    return "(" + " or ".join(f"contains(n, '{w}')" for w in words) + ")"


def _when(cond: str, values) -> str:
    return f"case when {cond} then {_list(values)} else []::varchar[] end"


FIRED = [(" and ".join(_any(g) for g in r.groups), r) for r in RULES]
BROAD = list(dict.fromkeys(w.lower() for t in TOPICS for w in t.split() if len(w) > 3))
MORE = " || ".join([_when(c, r.variations) for c, r in FIRED] + [_when(_any(MARKS), TOPICS)])
WORDS = " || ".join([_when(c, r.terms) for c, r in FIRED if r.terms] + [_when(_any(MARKS), BROAD)])
TOLD = f"list_filter({TOKENS}, lambda t: length(t) >= 3 and t not in ({STOPS}))"
EXPANDED = f"""b as (select item_id as query, text, ' ' || {SEARCH} || ' ' as n, {TOLD} as t from benchmark),
x as (select query, {_any(MARKS)} as review, [text] || {MORE} as v, t || {WORDS} as w from b),
u as (select query, review, unnest(v) as variation, generate_subscripts(v, 1) as i from x), f as (select query, review, variation, min(i) as i from u group by all),
va as (select query, review, variation, row_number() over (partition by query order by i) - 1 as place, count(*) over (partition by query) as n from f)"""


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return Q.expand(questions, RULES, MARKS, TOPICS)


@plan.query(f"""with {EXPANDED}, wu as (select query, review, unnest(w) as w, generate_subscripts(w, 1) as i from x), wf as (select query, review, w, min(i) as i from wu group by all),
wk as (select *, row_number() over (partition by query order by i) as k from wf), wt as (select query, string_agg(w, ' ' order by k) as terms from wk where k <= case when review then 30 else 12 end group by query)
select query, review, place::int as place, md5(variation) as variation, coalesce(terms, '') as terms from va left join wt using (query)""")
def query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's variations and search terms; what asks for a review gets the topics too."""
    rows = expanded(spark, sf_dir).select("query", "review", F.array_join("terms", " ").alias("terms"), F.posexplode("variations").alias("place", "variation"))
    return rows.select("query", "review", "place", F.md5(F.col("variation").cast("binary")).alias("variation"), "terms")


VARIED = "with " + BM25_CTE.replace("q as (select distinct item_id as query, unnest({0}) as term from benchmark)".format(TOKENS), f"""{EXPANDED},
qv as (select query * 1000 + place as query, query as asked, place, least(greatest(10, 60 // n), 50) as cap, variation as text from va), q as (select distinct query, unnest({TOKENS}) as term from qv)""")


@plan.query(VARIED + """, r as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from s), h as (select asked, doc, rank, place from r join qv using (query) where rank <= cap),
g as (select asked as query, doc as item, sum(1.0 / (60 + rank)) as score, min(rank) as best, list_sort(list(distinct place)) as v from h group by all), o as (select *, row_number() over (partition by query order by round(score, 12) desc, item) as place from g)
select query, item, place::int as place, round(score, 8) as score, best::int as best, array_to_string(v, ',') as variations from o where place <= 20""")
def variation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of lexical hits for each variation under its own cap, united by the sum of reciprocal ranks with the best rank kept."""
    asked = Q.variation_queries(expanded(spark, sf_dir))
    both = (F.col("query") * 1000 + F.col("variation")).alias("query")
    caps = asked.select(both, F.col("query").alias("asked"), "variation", "cap").distinct()
    hits = X.search(kept_index(spark, sf_dir), asked.select(both, "term"), 50).join(caps, "query").where(F.col("rank") <= F.col("cap"))
    out = Q.pooled(hits.select(F.col("asked").alias("query"), "variation", F.col("doc").alias("item"), "rank"), 20)
    return out.select("query", "item", "place", F.round("score", 8).alias("score"), "best", F.array_join("variations", ",").alias("variations"))


AUTHORS = f"""d as (select doc_id as chunk, source as file, list_filter({TOKENS}, lambda t: length(t) >= 4)[1] as author from documents), k as (select distinct author from d where author is not null),
a as (select item_id as query, unnest(list_distinct({TOLD})) as token from benchmark),
fl as (select query, author, row_number() over (partition by query order by author) as place from (select distinct query, author from a join k on token = author))"""


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, file, author): documents as chunks of their source, signed by their first word of four letters."""
    author = F.get(F.filter(terms(F.col("text")), lambda t: F.char_length(t) >= 4), F.lit(0))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk"), F.col("source").alias("file"), author.alias("author"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(query_terms(F.col("text"), 10_000)).alias("token"))
    authors = signed(spark, sf_dir).where("author is not null").select(F.col("author").alias("token"), "author")
    return Q.author_filters(asked, authors)


@plan.query(f"with {AUTHORS} select query, author, place::int as place from fl where place <= 4")
def named_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authors that a passage's words name, at most four."""
    return named(spark, sf_dir).select("query", "author", "place")


@plan.query(f"""with {AUTHORS}, c as (select *, row_number() over (partition by author, file order by chunk) as rank from d where author is not null), s as (select query, fl.author, file, chunk, rank from fl join c on fl.author = c.author where place <= 4 and rank <= 5),
o as (select *, row_number() over (partition by query order by rank, author, file nulls last, chunk) as place from s) select query, author, file, chunk, rank::int as rank, place::int as place from o where place <= 60""")
def author_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each named author the first five chunks of every file, one of each file in turn."""
    found = Q.author_scan(named(spark, sf_dir), signed(spark, sf_dir).where("author is not null"), 5)
    return Q.spread_by_file(found, 60).select("query", "author", "file", "chunk", "rank", "place")


NOTES = RANKED + f""", v as (select q.vec_id as query, v.vec_id as chunk, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as sim, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) desc, v.vec_id) as rank
  from embeddings q join benchmark on q.vec_id = item_id, embeddings v where v.vec_id <> q.vec_id),
sg as (select query, chunk, max(s) as s from (select query, doc as chunk, 0.72::double as s from r where rank <= 20 union all select query, chunk, 1.0 / (1.0 + greatest(1.0 - sim, 0.0)) from v where rank <= 30) group by all),
lb as (select doc_id, min(quality) as quality from labels group by doc_id),
ch as (select d.doc_id as chunk, source as note, text, lang, n_chars, quality from documents d left join lb on d.doc_id = lb.doc_id),
qs as (select item_id as query, list_distinct({TOLD}) as qt, {_any(MARKS)} as historical from (select *, ' ' || {SEARCH} || ' ' as n from benchmark)),
ns as (select query, chunk, note, historical, s + 0.08 * len(list_intersect(qt, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9][a-z0-9_-]{{2,}}'))) + case lang when 'en' then 0.10 when 'de' then -0.04 when 'fr' then case when historical then 0.24 else -0.10 end else 0 end
  + case when n_chars > 2000 then 0.12 when n_chars > 500 then 0.06 else 0 end + case when quality = 0 then -0.18 else 0 end as score, quality is distinct from 0 as current from sg join ch using (chunk) join qs using (query)),
no as (select *, row_number() over (partition by query, note order by round(score, 9) desc, chunk) as own from ns),
np as (select *, row_number() over (partition by query order by round(score, 9) desc, chunk) as place from no where own <= case when historical then 5 else 2 end)
"""


@plan.query(NOTES + "select query, chunk, note, round(score, 6) as score, current, place::int as place from np where place <= 5")
def note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of notes: the better of words and vectors, raised by language as kind and length as confidence, lowered for bad quality as a superseded state."""
    lexical = ranked(spark, sf_dir, 20).select("query", F.col("doc").alias("chunk"), F.lit(N.LEXICAL).alias("signal"))
    v = table(spark, sf_dir, "embeddings")
    benchmark = table(spark, sf_dir, "benchmark")
    asked = v.join(benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    near = R.nearest(asked, v.select("vec_id", "embedding"), 30).select("query", F.col("vec_id").alias("chunk"), N.semantic_signal(1 - F.col("similarity")).alias("signal"))
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kind = F.when(F.col("lang") == "en", "curada").when(F.col("lang") == "de", "literatura_obsidian").when(F.col("lang") == "fr", "sessao_arquivada").otherwise("nota_vault")
    sure = F.when(F.col("n_chars") > 2000, "alta").when(F.col("n_chars") > 500, "media").otherwise("baixa")
    signals = staged(lexical.unionByName(near), "note-signals")
    # only the few documents with a signal go on; their texts and no others meet the other tables
    wanted = signals.select(F.col("chunk").alias("doc_id")).distinct()
    chunks = table(spark, sf_dir, "documents").join(wanted, "doc_id", "left_semi").join(quality, "doc_id", "left")
    chunks = chunks.select(F.col("doc_id").alias("chunk"), F.col("source").alias("note"), "text", kind.alias("kind"), sure.alias("confidence"), F.when(F.col("quality") == 0, "Superado").alias("status"))
    plain = F.concat(F.lit(" "), searchable(F.col("text")), F.lit(" "))
    about_past = Q.any_of([F.contains(plain, F.lit(m)) for m in MARKS])
    questions = benchmark.select(F.col("item_id").alias("query"), "text", about_past.alias("historical"))
    out = N.search_notes(signals, chunks, questions)
    return out.select("query", "chunk", "note", F.round("score", 6).alias("score"), "current", "place")
