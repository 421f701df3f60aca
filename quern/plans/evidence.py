"""Ranking metrics, evidence and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import evidence as E
from quern.operators import retrieval as R
from quern.plans.base import Plan
from quern.plans.retrieval import KNN, RANKED, neighbours_of, ranked
from quern.sources.tables import documents, table

plan = Plan()

WANT = """, w as (select q.vec_id as query, v.vec_id as item from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id and q.label = v.label),
need as (select query, count(*) as need from w group by query),
g as (select r.query, count(*) as got, min(rank) as first, sum(1 / log2(rank + 1.0)) as dcg from r join w on r.query = w.query and r.vec_id = w.item where rank <= {k} group by r.query),
m as (select need.query, coalesce(got / need::double, 0) as recall, coalesce(got / {k}.0, 0) as precision, coalesce((got > 0)::int::double, 0) as hit, coalesce(1.0 / first, 0) as mrr, coalesce(dcg / list_sum(list_transform(range(1, least(need, {k}) + 1), lambda i: 1 / log2(i + 1.0))), 0) as ndcg from need left join g using (query))
"""


def metrics(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Neighbour lists of every 20th vector against the vectors of its label, which are counted and not paired."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("of"))
    hits = neighbours_of(spark, sf_dir, 10).join(v.select("vec_id", "label"), "vec_id").join(q, "query")
    sizes = v.groupBy(F.col("label").alias("of")).agg((F.count("*") - 1).alias("need"))
    return E.counted_metrics(hits.where("label = of").select("query", "rank"), q.join(sizes, "of").select("query", "need"), k)


@plan.query(KNN.format(extra="") + WANT.format(k=5) + "select query, round(recall, 6) as recall, round(precision, 6) as precision, hit, round(ndcg, 6) as ndcg from m")
def ir_recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir, 5)
    return m.select("query", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "hit", F.round("ndcg", 6).alias("ndcg"))


@plan.query(KNN.format(extra="") + WANT.format(k=8) + "select query, round(mrr, 6) as mrr from m")
def ir_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, 8).select("query", F.round("mrr", 6).alias("mrr"))


@plan.query(KNN.format(extra="") + WANT.format(k=8) + ", c as (select m.*, label from m join embeddings on query = vec_id) select label, count(*) as n, round(avg(recall), 4) as recall, round(avg(mrr), 4) as mrr, round(quantile_cont(ndcg, 0.95), 4) as p95 from c group by rollup (label)")
def ir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), "label")
    m = metrics(spark, sf_dir, 8).join(labels, "query")
    return m.rollup("label").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.percentile("ndcg", 0.95), 4).alias("p95"))


@plan.query(RANKED + """, gg as (select r.query, doc as item, rank, source as grp, case when lang = 'en' then 3 else 1 end as relevance from r join documents on doc = doc_id where rank <= 20),
wh as (select query, grp, max(relevance) as relevance from gg group by all), f as (select query, grp, min(rank) as rank from gg where rank <= 10 group by all),
n as (select query, count(*) as need, sum((2.0 ** relevance - 1) / log2(i + 1.0)) filter (i <= 10) as ideal from (select *, row_number() over (partition by query order by relevance desc, grp) as i from wh) group by query),
t as (select query, count(*) as got, min(rank) as first, sum((2.0 ** relevance - 1) / log2(rank + 1.0)) as dcg from f join wh on f.query = wh.query and f.grp is not distinct from wh.grp group by query)
select query, round(coalesce(got / need::double, 0), 6) as recall, round(coalesce(got / 10.0, 0), 6) as precision, round(coalesce(1.0 / first, 0), 6) as mrr, round(coalesce(dcg, 0), 6) as dcg, round(coalesce(dcg / ideal, 0), 6) as ndcg from n left join t using (query)""".replace("select query, count(*) as got", "select f.query, count(*) as got").replace("wh.grp group by query)", "wh.grp group by f.query)"))
def ir_grouped_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("source", F.lit("")).alias("grp"), F.when(F.col("lang") == "en", 3).otherwise(1).alias("relevance"))
    hits = ranked(spark, sf_dir, 20).join(docs, "doc").withColumnRenamed("doc", "item")
    out = E.grouped_gains(hits.select("query", "item", "rank"), hits.select("query", "item", "grp", "relevance"), 10)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "dcg", "ndcg")])


@plan.query(KNN.format(extra="") + WANT.format(k=5) + ", m2 as (select query, recall as a, precision * 5 / 8 as b from m) select count(*) as n, count(*) filter (b < a) as regressions, count(*) filter (b > a) as improvements, avg(b) >= avg(a) as promote from m2")
def benchmark_compare_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir, 5).select(F.col("recall").alias("a"), (F.col("precision") * 5 / 8).alias("b"))
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("regressions"), F.count_if(F.col("b") > F.col("a")).alias("improvements"), (F.avg("b") >= F.avg("a")).alias("promote"))


PACKED = RANKED + """, e as (select query, doc, rank, source, text, 'E' || row_number() over (partition by query order by rank) as evidence from r join (select doc_id as doc, source, text from documents) using (doc) where rank <= 8 and source <> 'src0')
"""


def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("document_id"), F.col("source").alias("source_type"), F.col("text").alias("raw_text"))
    return E.package(ranked(spark, sf_dir, 8).join(docs, "doc"), "query", "rank", ["src0"])


@plan.query(PACKED + "select query, doc, evidence from e")
def evidence_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of(spark, sf_dir).select("query", "doc", "evidence")


@plan.query(PACKED + """, c as (select item_id as query, item_id % 3 as kind from benchmark),
x as (select query, kind, max(text) filter (evidence = 'E1') as t from c left join e using (query) group by all)
select query as claim, array_to_string(list_sort(list_filter([case when t is null then 'unknown_evidence' end, case when kind = 1 then 'page' end, case when kind = 2 and (t is null or not contains(trim(regexp_replace(regexp_replace(strip_accents(lower(t)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 'zz no such quote zz')) then 'quote' end], lambda v: v is not null)), ',') as errors from x""")
def claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence_of(spark, sf_dir).select(F.concat_ws(":", "query", "evidence").alias("evidence"), F.array(F.lit(1)).alias("pages"), F.lit(2024).alias("year"), "raw_text")
    c = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("claim"),
        F.array(F.concat(F.col("item_id").cast("string"), F.lit(":E1"))).alias("ids"),
        F.lit("direct").alias("level"),
        F.when(F.col("item_id") % 3 == 1, 99).alias("page"),
        F.lit(None).cast("int").alias("year"),
        F.when(F.col("item_id") % 3 == 2, "zz no such quote zz").alias("quote"),
    )
    return E.validate_claims(c, e).select("claim", F.array_join("errors", ",").alias("errors"))


@plan.query("""with a as (select conv_id, turn, coalesce(text, '') || case when length(text) % 5 < 4 then ' [E' || (length(text) % 4) || ']' else '' end as answer from conversations), u as (select *, list_sort(list_distinct(regexp_extract_all(answer, '\\[(E\\d+)\\]', 1))) as used from a)
select conv_id, turn, array_to_string(list_filter(used, lambda x: x not in ('E1', 'E2')), ',') as unknown, len(used) = 0 or len(list_filter(used, lambda x: x not in ('E1', 'E2'))) > 0 as withhold from u""")
def answer_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.when(F.char_length("text") % 5 < 4, F.concat(F.lit(" [E"), (F.char_length("text") % 4).cast("string"), F.lit("]"))).otherwise("")).alias("answer"))
    g = a.withColumn("g", E.check_answer(F.col("answer"), F.array(F.lit("E1"), F.lit("E2"))))
    return g.select("conv_id", "turn", F.array_join(F.array_sort("g.unknown"), ",").alias("unknown"), F.col("g.withhold").alias("withhold"))


# Entities of the invented vocabulary and their aliases.
TAXONOMY = [("common", "the"), ("place", "in the"), ("insult", "idiot"), ("insult", "moron"), ("french", "de la"), ("german", "der")]
TAX_SQL = ", ".join(f"('{e}', '{a}')" for e, a in TAXONOMY)


@plan.query(f"""with tx(entity, alias) as (values {TAX_SQL}), d as (select doc_id, ' ' || trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' as t from documents)
select distinct 'entity:' || entity as src, 'document:' || doc_id as dst, 'SUPPORTED_BY' as relation from d join tx on contains(t, ' ' || alias || ' ')""")
def evidence_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("chunk_id"), "text")
    return E.alias_edges(chunks, spark.createDataFrame(TAXONOMY, "entity string, alias string")).select("src", "dst", "relation")


@plan.query("""with recursive e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union select 'n' || s_nationkey, 's' || s_suppkey from supplier),
p as (select 'r' || r_regionkey as start, ['r' || r_regionkey] as path from region union all select start, list_append(path, dst) from p join e on src = path[-1] where len(path) <= 3 and not list_contains(path, dst))
select start, array_to_string(path, '>') as path, len(path) - 1 as n from p where len(path) > 1""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst")).unionByName(table(spark, sf_dir, "supplier").select(tag("n", "s_nationkey").alias("src"), tag("s", "s_suppkey").alias("dst")))
    starts = table(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("node"))
    return E.simple_paths(edges, starts).select("start", F.array_join("path", ">").alias("path"), "n")


@plan.query(RANKED + """, h as (select query, rank, source, row_number() over (partition by query, source order by rank) as k from r join documents on doc = doc_id where rank <= 20) select query, rank::int as rank from h where k = 1""")
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("grp"))
    cells = ranked(spark, sf_dir, 20).join(docs, "doc").select("query", "rank", F.array(F.struct(F.lit(1).alias("relevance"), F.col("grp"))).alias("groups"))
    return E.greedy_assignment(cells, "query").select("query", "rank")
