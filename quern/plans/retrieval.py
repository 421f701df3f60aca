"""Retrieval queries over documents, benchmark passages, embeddings and conversations."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS, query_terms, terms
from quern.operators import lexical as X
from quern.operators import retrieval as R
from quern.plans.base import Plan
from quern.sources.shared import shared_dir
from quern.sources.tables import documents, table

plan = Plan()

FOLD = "strip_accents(lower(text))"
TOKENS = "list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries (query, term)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


BM25_CTE = f"""
d as (select doc_id, lang, source, {TOKENS} as t from documents),
p as (select doc_id as doc, len(t) as len, unnest(t) as term from d),
tf as (select term, doc, len, count(*) as tf from p group by all),
df as (select term, count(*) as df from tf group by term),
st as (select count(*)::double as n, avg(len(t)) as mean from d),
q as (select distinct item_id as query, unnest({TOKENS}) as term from benchmark),
s as (select query, doc, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score, count(*) as matched
  from q join tf using (term) join df using (term), st group by query, doc)"""

RANKED = f"with {BM25_CTE}, r as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from s)"


def kept_index(spark: SparkSession, sf_dir: str) -> X.Index:
    """The index of the documents table, kept in the shared folder and brought up to date with what the table holds now."""
    root = f"{shared_dir(spark)}/quern/lexical-rows-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return X.update(root, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


def ranked(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return X.search(kept_index(spark, sf_dir), passages(spark, sf_dir), n)


@plan.query(RANKED + " select query, doc, rank, round(score, 6) as score from r where rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, 10).select("query", "doc", "rank", F.round("score", 6).alias("score"))


@plan.query(f"select count(*) as n_docs, round(avg(len({TOKENS})), 6) as mean_len from documents")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(documents(spark, sf_dir), "text").select("n_docs", F.round("mean_len", 6).alias("mean_len"))


@plan.query(f"with p as (select doc_id, unnest({TOKENS}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from p group by term")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def earlier(docs: DataFrame) -> DataFrame:
    """An earlier state of docs (doc, text): some texts longer, some documents not there yet, some that are gone by now."""
    was = F.when(F.col("doc") % 7 == 3, F.concat("text", F.lit(" in an earlier wording"))).otherwise(F.col("text"))
    old = docs.where("doc % 11 <> 5").select("doc", was.alias("text"))
    return old.unionByName(docs.where("doc % 13 = 1").select((-F.col("doc")).alias("doc"), "text"))


def aged_index(spark: SparkSession, sf_dir: str) -> X.Index:
    """A new index of the earlier state of the documents."""
    root = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/lexical-{uuid.uuid4().hex}"
    return X.update(root, earlier(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")))


@plan.query("""select doc_id as doc, case when doc_id % 11 = 5 then 'added' when doc_id % 7 = 3 and text is not null then 'changed' else 'kept' end as action from documents
union all select -doc_id, 'removed' from documents where doc_id % 13 = 1""")
def lexical_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update of an index of the earlier state has to do for each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return X.changes(docs, aged_index(spark, sf_dir)).select("doc", "action")


@plan.query(f"with t as (select doc_id as doc, {TOKENS} as t from documents) select doc, len(t) as len, len(list_distinct(t)) as n_terms, md5(array_to_string(list_sort(t), ' ')) as digest from t where len(t) > 0")
def lexical_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's postings in an index of the earlier state brought up to date: the same as in one built anew."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    index = X.update(aged_index(spark, sf_dir).root, docs)
    held = index.postings().groupBy("doc").agg(F.sum("tf").alias("len"), F.count("*").alias("n_terms"), F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("held"))  # a row holds one document
    again = F.array_join(F.flatten(F.transform("held", lambda h: F.array_repeat(h["term"], h["tf"]))), " ")
    return held.select("doc", "len", "n_terms", F.md5(again.cast("binary")).alias("digest"))


@plan.query(f"""
with t as (select doc_id, unnest({TOKENS}) as w, generate_subscripts({TOKENS}, 1) as i from documents),
f as (select doc_id, w, min(i) as i from t where length(w) >= 3 and w not in ({STOPS}) group by all),
r as (select *, row_number() over (partition by doc_id order by i) as k from f)
select doc_id, count(w) filter (k <= 40) as n_terms, md5(coalesce(string_agg(w, ' ' order by k) filter (k <= 40), '')) as digest from documents left join r using (doc_id) group by doc_id""")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", query_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector, by id."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


KNN = """with p as (select q.vec_id as query, v.vec_id, q.label as q_label, v.label, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as sim
  from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id{extra}),
r as (select *, row_number() over (partition by query order by round(sim, 9) desc, vec_id) as rank from p)
"""


def neighbours_of(spark: SparkSession, sf_dir: str, n: int, same_label: bool = False) -> DataFrame:
    hits = R.nearest(vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), n, ("q_label", "label") if same_label else None)
    return hits.withColumnRenamed("similarity", "sim")


@plan.query(KNN.format(extra="") + "select query, vec_id, rank, round(sim, 6) as similarity from r where rank <= 10")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_of(spark, sf_dir, 10).select("query", "vec_id", "rank", F.round("sim", 6).alias("similarity"))


@plan.query(KNN.format(extra=" and q.label = v.label") + "select query, vec_id, rank, round(sim, 6) as similarity from r where rank <= 5")
def vector_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_of(spark, sf_dir, 5, True).select("query", "vec_id", "rank", F.round("sim", 6).alias("similarity"))


FUSED = RANKED + """, l as (select query, doc as item, 'lexical' as source, 1.0 as weight, rank from r where rank <= 20
  union all select query, doc, 'long', 0.25, row_number() over (partition by query order by len(t) desc, doc) from r join d on doc = doc_id where rank <= 20),
f as (select query, item, sum(weight / (60 + rank)) as score, list_sort(list(distinct source)) as sources from l group by all)
"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical ranks fused, at a quarter of the weight, with the same hits by document length."""
    index = kept_index(spark, sf_dir)
    hits = X.search(index, passages(spark, sf_dir), 20)
    sizes = index.tokens().select("doc", "len")
    by_len = R.top(hits.drop("rank").join(sizes, "doc"), "query", [F.desc("len"), F.asc("doc")], 20)
    part = lambda df, source, weight: df.select("query", F.col("doc").alias("item"), F.lit(source).alias("source"), F.lit(weight).alias("weight"), "rank")
    return R.fuse(part(hits, "lexical", 1.0).unionByName(part(by_len, "long", 0.25)))


@plan.query(FUSED + "select query, item, round(score, 8) as score, array_to_string(sources, '+') as sources from f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query", "item", F.round("score", 8).alias("score"), F.array_join("sources", "+").alias("sources"))


WITH_SOURCE = RANKED + """, h as (select query, doc, rank, matched, lang, source, length(text) as len from r join (select doc_id as doc, lang, source, text from documents) using (doc) where rank <= 20)
"""


def hits_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source", F.char_length("text").alias("len"))
    return ranked(spark, sf_dir, 20).join(docs, "doc").select("query", "doc", "rank", "matched", "lang", "source", "len")


@plan.query(WITH_SOURCE + """, s2 as (select *, row_number() over (partition by query, source order by rank) as sr from h),
o as (select *, row_number() over (partition by query order by greatest(sr, 2), rank) as place from s2) select query, doc, place from o where place <= 8""")
def diversify_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diversify(hits_with_source(spark, sf_dir), "query", "source", [F.col("rank")], 2, 8).select("query", "doc", "place")


ROBIN = WITH_SOURCE + """, s2 as (select *, row_number() over (partition by query, source order by rank) as sr, min(rank) over (partition by query, source) as sf from h),
o as (select *, row_number() over (partition by query order by sr, sf) as place from s2)
"""


@plan.query(ROBIN + "select query, doc, place from o")
def round_robin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_robin(hits_with_source(spark, sf_dir), "query", "source", "rank").select("query", "doc", "place")


@plan.query(ROBIN + """, b as (select *, coalesce(sum(len) over (partition by query order by place rows between unbounded preceding and 1 preceding), 0) as before from o)
select query, doc, place, case when len <= 14000 - before then len when 14000 - before > 300 then 14000 - before else 0 end::bigint as used from b""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = R.round_robin(hits_with_source(spark, sf_dir), "query", "source", "rank")
    return R.pack(placed, "query", "place", "len", 14000).select("query", "doc", "place", "used")


@plan.query("""
with c as (select conv_id, turn, text, length(text) as n from conversations),
s as (select conv_id, turn, n::double as score from (select *, row_number() over (partition by conv_id order by n desc, turn) as k from c) where k = 1),
x as (select conv_id, unnest([turn - 1, turn + 1]) as turn, score from s)
select conv_id, turn, round(max(x.score) * 0.85, 6) as score from c join x using (conv_id, turn) where not exists (select 1 from s where s.conv_id = c.conv_id and s.turn = c.turn) group by all""")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    seeds = R.top(c, "conv_id", [F.desc("n"), F.asc("turn")], 1).select("conv_id", "turn", F.col("n").cast("double").alias("score"))
    return R.neighbours(c, seeds, "conv_id", "turn").select("conv_id", "turn", F.round("score", 6).alias("score"))


@plan.query("select conv_id, turn, lag(turn) over w as prev_turn, lead(turn) over w as next_turn from conversations window w as (partition by conv_id order by turn)")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


@plan.query(WITH_SOURCE + "select query, doc, rank, round(30.0 / (60 + rank) + matched / m.n + case when source = 'src' || (query % 10) then 6.0 else 0 end + case when lang = 'en' then 3.0 else 0 end + case when source in ('src0', 'src1') then 2.0 else 0.5 end + case when len > 8000 then -12.0 else 0.0 end, 6) as score from h join (select query, count(*)::double as n from q group by query) m using (query)")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap is the share of the query's terms that the document has; its source and language stand for author and year."""
    n = passages(spark, sf_dir).groupBy("query").agg(F.count("*").alias("n"))
    same_source = F.col("source") == F.concat(F.lit("src"), (F.col("query") % 10).cast("string"))
    score = R.rerank_score(1.0 / (60 + F.col("rank")), F.col("matched") / F.col("n"), same_source, F.col("lang") == "en", F.when(F.col("source").isin("src0", "src1"), 2.0).otherwise(0.5), F.col("len") > 8000)
    return hits_with_source(spark, sf_dir).join(n, "query").select("query", "doc", "rank", F.round(score, 6).alias("score"))
