"""Library queries: search terms, sections, gold sets, memories, inventories, hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import library as L
from quern.operators import retrieval as R
from quern.operators import scoring as S
from quern.plans.base import Plan
from quern.plans.detection import CONF, labelled
from quern.plans.retrieval import KNN, RANKED, TOKENS, neighbours_of, ranked
from quern.plans.texts import SEARCH
from quern.sources.tables import documents, table

plan = Plan()


@plan.query(CONF.rstrip() + " select doc_id, round(score / nullif(thr, 0), 6) as anomaly_index, score > thr as detected from s join t using (lang)")
def anomaly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    t = S.order_threshold(rows.where("y = 0"), ["lang"], "score", 90.0).select("lang", "threshold")
    return rows.join(t, "lang").select("doc_id", F.round(F.try_divide("score", "threshold"), 6).alias("anomaly_index"), (F.col("score") > F.col("threshold")).alias("detected"))


EXPANDED = {w: [x for x in [k, *v] if x != w] for k, v in L.SYNONYMS.items() for w in [k, *v]}
MAP_SQL = "map {" + ", ".join(f"'{w}': [" + ", ".join(f"'{x}'" for x in v) + "]" for w, v in sorted(EXPANDED.items())) + "}"


@plan.query(f"with t as (select item_id, list_distinct({TOKENS}) as t from benchmark) select item_id, array_to_string(list_sort(list_distinct(flatten(list_transform(t, lambda x: list_prepend(x, coalesce({MAP_SQL}[x], []::varchar[])))))), ' ') as terms from t")
def expanded_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(L.query_terms_of(F.col("text"))), " ").alias("terms"))


@plan.query("select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9][a-z0-9_-]{2,}'))), ' ') as terms from conversations")
def note_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(L.note_terms(F.col("text"))), " ").alias("terms"))


@plan.query("""with n as (select r_name || chr(10) || 'about ' || r_name as head, n_name, n_nationkey, r_name, r_regionkey, row_number() over (partition by r_regionkey order by n_nationkey) as k from nation join region on n_regionkey = r_regionkey)
select r_regionkey, 0::int as section, 1 as level, r_name as trail, 'about ' || r_name as body from region
union all select r_regionkey, k::int, 2, r_name || '>' || n_name, 'key ' || n_nationkey from n""")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a Markdown note with a section a nation, cut back into its sections."""
    part = F.concat(F.lit("## "), "n_name", F.lit("\nkey "), F.col("n_nationkey").cast("string"), F.lit("\n"))
    body = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
    notes = table(spark, sf_dir, "region").join(body, "r_regionkey").select("r_regionkey", F.concat(F.lit("# "), "r_name", F.lit("\nabout "), "r_name", F.lit("\n"), "body").alias("note"))
    out = L.sections(notes, "r_regionkey", "note")
    return out.select("r_regionkey", "section", "level", F.array_join("trail", ">").alias("trail"), "body")


@plan.query(f"""with g as (select conv_id * 1000 + turn as id, {SEARCH} as q, length(text) % 5 as relevance, case when role = 'user' then 1 else 0 end as n from conversations),
s as (select *, count(*) over (partition by id) as ids, count(*) over (partition by q) as texts from g)
select id, array_to_string(list_sort(list_filter([case when ids > 1 then 'duplicate_id' end, case when texts > 1 then 'duplicate_question' end, case when length(q) < 12 then 'short_question' end, case when n = 0 then 'no_evidence' end, case when relevance not between 1 and 3 then 'relevance' end], lambda x: x is not null)), ',') as errors from s""")
def gold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), (F.char_length("text") % 5).alias("relevance"), F.when(F.col("role") == "user", F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return L.gold_errors(gold).select("id", F.array_join("errors", ",").alias("errors"))


@plan.query(f"""with m as (select conv_id * 1000 + turn as memory, conv_id // 4 as topic, turn as created, {SEARCH} as q from conversations),
f as (select *, row_number() over (partition by topic, q order by created, memory) > 1 as again from m), n as (select *, row_number() over (partition by topic, again order by created desc, memory desc) as k from f)
select memory, topic, case when again then 'duplicate' when k = 1 then 'active' else 'superseded' end as state from n""")
def memory_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory"), F.floor(F.col("conv_id") / 4).alias("topic"), F.col("turn").alias("created"), F.col("text").alias("content"))
    return L.memory_states(m).select("memory", "topic", "state")


@plan.query(KNN.format(extra="") + """, h as (select query, vec_id as chunk, vec_id // 10 as page, label as document, rank from r where rank <= 10), e as (select vec_id as query, vec_id + 1 as chunk, vec_id // 10 as page, label as document from embeddings where vec_id % 20 = 0),
l as (select e.query, 'chunk' as level, min(rank) as first from e left join h on e.query = h.query and e.chunk = h.chunk group by all union all select e.query, 'page', min(rank) from e left join h on e.query = h.query and e.page = h.page group by all
  union all select e.query, 'document', min(rank) from e left join h on e.query = h.query and e.document = h.document group by all)
select query, level, (first is not null)::int as hit, round(coalesce(1.0 / first, 0), 6) as mrr from l""")
def multi_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists of every 20th vector, judged by chunk (the next vector), page (of ten) and document (label)."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("document"))
    page = F.floor(F.col("vec_id") / 10).alias("page")
    hits = neighbours_of(spark, sf_dir, 10).select("query", "vec_id", "rank").join(labels, "vec_id").select("query", "rank", F.col("vec_id").alias("chunk"), page, "document")
    expected = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("chunk"), page, "document")
    return L.level_hits(hits, expected, ["chunk", "page", "document"], 10).select("query", "level", "hit", F.round("mrr", 6).alias("mrr"))


HYBRID = RANKED + """, v as (select q.vec_id as query, v.vec_id as item, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) desc, v.vec_id) as rank
  from embeddings q join benchmark on q.vec_id = item_id, embeddings v where v.vec_id <> q.vec_id),
l as (select query, doc as item, 'lexical' as source, rank from r where rank <= 20 union all select query, item, 'vector', rank from v where rank <= 20),
f as (select query, item, sum(1.0 / (60 + rank)) as score, list_sort(list(distinct source)) as sources from l group by all), o as (select *, row_number() over (partition by query order by round(score, 12) desc, item) as place from f)
"""


@plan.query(HYBRID + "select query, item, place, round(score, 8) as score, array_to_string(sources, '+') as sources from o where place <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by words and, with the vector of the passage's number, by cosine; both lists fused and ordered."""
    lexical = ranked(spark, sf_dir, 20).select("query", F.col("doc").alias("item"), F.lit("lexical").alias("source"), F.lit(1.0).alias("weight"), "rank")
    v = table(spark, sf_dir, "embeddings")
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    near = R.nearest(asked, v.select("vec_id", "embedding"), 20).select("query", F.col("vec_id").alias("item"), F.lit("vector").alias("source"), F.lit(1.0).alias("weight"), "rank")
    best = R.top(R.fuse(lexical.unionByName(near)), "query", [F.desc(F.round("score", 12)), F.asc("item")], 10, "place")
    return best.select("query", "item", "place", F.round("score", 8).alias("score"), F.array_join("sources", "+").alias("sources"))


@plan.query(RANKED + ", h as (select query, doc, rank, source, length(text) as len from r join (select doc_id as doc, source, text from documents) using (doc) where rank <= 20), k as (select *, row_number() over (partition by query, source order by rank) as k from h) select query, doc, rank from k where k <= case when source in ('src0', 'src1') then 5 else 2 end")
def per_note_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    hits = ranked(spark, sf_dir, 20).join(docs, "doc")
    return L.capped(hits, "query", "source", "rank", F.when(F.col("source").isin("src0", "src1"), 5).otherwise(2)).select("query", "doc", "rank")


@plan.query("with p as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id desc) as place, count(*) over (partition by source) as held from documents) select source, doc_id, place, held from p where place <= 10")
def inventory_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return L.newest(items, "source", [F.desc("n_chars"), F.desc("doc_id")]).select("source", "doc_id", "place", "held")


@plan.query("""with u as (select user_id, max(ts) as updated, last(event_type order by ts, event_id) as status from events group by user_id)
select user_id, strftime(updated, '%d/%m/%Y %H:%M') as shown, dayname(updated) as weekday, case when hour(updated) < 5 then 'good night' when hour(updated) < 12 then 'good morning' when hour(updated) < 18 then 'good afternoon' else 'good evening' end as greeting, row_number() over (order by updated desc, user_id) as place from u where status <> 'error'""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as conversations, newest first, with readable dates; those whose last event is an error are left out."""
    from quern.operators.journal import numbered

    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status")).where("status <> 'error'")
    shown = u.select("user_id", "updated", F.date_format("updated", "dd/MM/yyyy HH:mm").alias("shown"), F.date_format("updated", "EEEE").alias("weekday"), L.greeting(F.hour("updated")).alias("greeting"))
    return numbered(shown, [F.desc("updated"), F.asc("user_id")]).select("user_id", "shown", "weekday", "greeting", "place")


@plan.query("select user_id, count(*) as n, count(*) filter (not isfinite(value)) as not_finite, count(*) filter (event_type is null or ts is null) as missing, count(*) filter (ts < before) as backward from (select *, lag(ts) over (partition by user_id order by event_id) as before from events) group by user_id")
def dataset_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's record as a trial: finite values, no missing fields, time that does not run backward."""
    from quern.operators.signal import record_faults

    return record_faults(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "value", ["event_type", "ts"])


@plan.query("""with e as (select l_orderkey as document, list(distinct l_linenumber) as pages from lineitem group by 1), c as (select o_orderkey as claim, [(o_custkey % 7 + 1)::int, (o_custkey % 5 + 1)::int] as pages from orders)
select claim, list_has_any(c.pages, e.pages) as supported from c join e on claim = document""")
def page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that name pages of a document against the pages its evidence covers."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(F.collect_set("l_linenumber").alias("held"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), F.array((F.col("o_custkey") % 7 + 1).cast("int"), (F.col("o_custkey") % 5 + 1).cast("int")).alias("pages"))
    return c.join(e, "claim").select("claim", F.arrays_overlap("pages", "held").alias("supported"))


@plan.query("select event_type, round(min(value), 6) as low, round(max(value), 6) as high, count(distinct user_id) as sources from events group by event_type")
def range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.countDistinct("user_id").alias("sources"))


@plan.query("select conv_id, turn, sha256(coalesce(text, '')) || '__chunk_' || lpad(turn::varchar, 5, '0') as chunk_id, substr(sha256('turn|' || conv_id || '|' || turn), 1, 16) as node_id from conversations")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.substring(F.sha2(F.concat_ws("|", F.lit("turn"), "conv_id", "turn"), 256), 1, 16)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", L.chunk_id(F.coalesce("text", F.lit("")), F.col("turn")).alias("chunk_id"), node.alias("node_id"))


@plan.query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\\\\\\\]', ''), '[^\\w.\\- ]', '_', 'g'), '^\\.+', '') as name from pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@plan.query("select doc_id, contains(text, 'house') or contains(text, 'House') or contains(text, 'HOUSE') as found from documents")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = T.case_variants(F.lit("house"))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(forms, lambda f: F.contains(F.col("text"), f)).alias("found"))


@plan.query("""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\x00', '', 'g'), '(\\p{L})-\\r?\\n(\\p{L})', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\r?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' +([,.;:!?])', '\\1', 'g'))) as digest from documents""")
def extracted_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.clean_extracted(F.col("text")).cast("binary")).alias("digest"))


@plan.query("select doc_id, md5(case when length(text) <= 120 then text else regexp_replace(substr(text, 1, 120), '\\s\\S*$', '') || ' …' end) as digest from documents")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.shorten(F.col("text"), 120).cast("binary")).alias("digest"))
