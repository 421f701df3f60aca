"""Conversation, inventory, memory, stream and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.canonical import digest
from quern.operators import journal as J
from quern.operators import models as M
from quern.operators.scoring import top_k_mean
from quern.plans.base import Plan
from quern.plans.retrieval import STOPS, TOKENS
from quern.sources.tables import table
from quern.streaming import streams

plan = Plan()


@plan.query("select conv_id, count(*) as turns, count(*) filter (role = 'user') as asked, sum(length(text))::bigint as chars from conversations group by conv_id")
def conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.char_length("text").cast("long")).alias("chars"))


@plan.query("select conv_id, turn, back from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 3")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "back")


@plan.query("select conv_id, string_agg('**' || role || '**: ' || coalesce(text, ''), chr(10) || chr(10) order by turn) as transcript from conversations group by conv_id")
def transcript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@plan.query("select conv_id, turn::int as turn, role from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role from conversations)")
def transcript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = J.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return J.parse_transcript(t, "transcript").select("conv_id", "turn", "role")


@plan.query("select user_id, first(event_id order by ts, event_id) as first, last(event_id order by ts, event_id) as last, count(*) as n from events group by user_id")
def first_last_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")  # of equal times the smaller id comes first
    return e.groupBy("user_id").agg(F.min_by("event_id", at).alias("first"), F.max_by("event_id", at).alias("last"), F.count("*").alias("n"))


@plan.query("select doc_id, d.doc_id is not null as on_disk, l.doc_id is not null as indexed from (select doc_id from documents) d full join (select doc_id from labels) l using (doc_id)".replace("select doc_id, d", "select coalesce(d.doc_id, l.doc_id) as doc_id, d").replace("using (doc_id)", "on d.doc_id = l.doc_id"))
def inventory_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.inventory(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@plan.query("select user_id, max_by(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.state_of(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@plan.query("""with s as (select user_id as session, min(ts)::date as day, count(*) as interactions, sum(length(props))::bigint as n_chars from events group by user_id)
select session, (interactions >= 15 or date_diff('day', day, date '2024-01-10') >= 3) and n_chars > 200 as due from s""")
def consolidation_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").cast("date").alias("day"), F.count("*").alias("interactions"), F.sum(F.char_length("props")).alias("n_chars"))
    return J.to_consolidate(s, F.lit("2024-01-10").cast("date")).select("session", "due")


TERMS = f"list_distinct(list_filter({TOKENS}, lambda t: length(t) >= 3 and t not in ({STOPS})))"


@plan.query(f"""with m as (select conv_id * 1000 + turn as memory, unnest({TERMS}) as term from conversations), q as (select item_id as query, unnest({TERMS}) as term from benchmark), n as (select count(*) as n from conversations),
df as (select term, count(*) as df from m group by term), s as (select query, memory, sum(ln((n + 1.0) / (df + 0.5))) as score from q join m using (term) join df using (term), n group by all),
r as (select *, row_number() over (partition by query order by round(score, 9) desc, memory desc) as rank from s) select query, memory, rank, round(score, 6) as score from r where rank <= 6""")
def memory_recall_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory"), "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return J.recall_memories(q, m, 6).select("query", "memory", "rank", F.round("score", 6).alias("score"))


@plan.query(f"""with t as (select item_id as item, unnest({TERMS}) as term from benchmark), u as (select * from t where length(term) >= 4), k as (select term from u group by term having count(*) >= 2),
p as (select a.item, b.item as other, count(*) as shared from u a join u b using (term) join k using (term) where a.item <> b.item group by all having count(*) >= 2),
r as (select *, row_number() over (partition by item order by shared desc, other) as rank from p) select item, other, shared, rank from r where rank <= 3""")
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.related(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text"), 2, 3).select("item", "other", "shared", "rank")


# Routing rules over the props of an event, tried in order.
ROUTES = [("mobile", "(?i)mobile|ios|android"), ("number", r"\d{3}"), ("short", r"^.{0,24}$")]


@plan.query("select event_id, case when regexp_matches(props, '(?i)mobile|ios|android') then 'mobile' when regexp_matches(props, '\\d{3}') then 'number' when regexp_matches(props, '^.{0,24}$') then 'short' else 'other' end as route from events")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.rule(F.col("props"), ROUTES, "other").alias("route"))


@plan.query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = streams.tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plan.query("""with e as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval '6 hours' then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, min(ts) as start, max(ts) + interval '6 hours' as stop, count(*) as n from s group by user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@plan.query("select event_id, user_id from events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return streams.deduplicated(e.unionByName(e), "ts", "event_id", "1 hour").select("event_id", "user_id")


@plan.query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_live_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same daily counts by a real stream over the events file, in complete mode."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema)
    stream = spark.readStream.schema(fields).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    t = streams.run_to_memory(streams.tumbling(stream, "ts", "event_type", "value", "1 day"), "live_tumbling", "complete")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plan.query()
def pca_autoencoder_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    mean, basis = M.linear_autoencoder(v.where("label < 5"), "embedding", 64, 8)
    errors = M.reconstruction_errors(v, ["vec_id", "label"], "embedding", mean, basis)
    return errors.select("vec_id", "label", top_k_mean(F.col("errors"), 5).alias("score"))


@plan.query()
def dense_autoencoder_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five training runs on all healthy vectors, a fifth of them held for checking: best loss of each and mean score of the other labels."""
    v = table(spark, sf_dir, "embeddings")
    size = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    fitted = M.fit_dense(v.where("label < 5"), "embedding", F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 == 0, size, [13, 29, 42, 71, 101])
    losses = spark.createDataFrame([(s, loss) for s, (_, loss) in fitted.items()], "seed int, loss double")
    return losses.join(M.mean_scores(v.where("label >= 5"), "embedding", {s: m for s, (m, _) in fitted.items()}, size), "seed", "left")


@plan.query("select event_type, count(*) as n, avg(value) is not null as measured, rank() over (order by count(*) desc) as place from events group by event_type")
def tool_usage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").isNotNull().alias("measured"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))


@plan.query("""select event_id, sha256('{"bad":null,"kept":{"a":[1,null,"NaN"],"b":' || event_id || '},"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '"}') as digest from events""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as loose JSON, with keys in any order, spaces, and numbers that are none; the digest is of its canonical spelling without its time of reading."""
    loose = F.concat(F.lit('{ "type": "'), "event_type", F.lit('",\n "read_at": 5, "props": '), "props", F.lit(', "kept": {"b": '), F.col("event_id").cast("string"), F.lit(', "a": [1, -Infinity, "NaN"]}, "bad": NaN }'))
    return table(spark, sf_dir, "events").select("event_id", digest(loose, ("read_at",)).alias("digest"))
