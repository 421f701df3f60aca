"""Scores, metrics, detectability and reliability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import detect as D
from quern.operators import reliability as REL
from quern.operators import scoring as S
from quern.operators.journal import numbered
from quern.plans.base import Plan
from quern.sources.tables import table

plan = Plan()

LABELED = """with s as (select doc_id, lang, toxic as y, (length(text) - length(replace(text, 'e', ''))) * 1.0 / length(text) as score from documents join labels using (doc_id) where length(text) > 0)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label toxic against the share of the letter e, a score with ties."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "lang", (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("k"), F.length("text").alias("n"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("toxic").alias("y"), (F.col("k") * 1.0 / F.col("n")).cast("double").alias("score"))


@plan.query("with s as (select vec_id, list_sort(list_transform(embedding, lambda v: v::double * v::double), 'DESC') as e from embeddings) select vec_id, round(list_sum(e[1:5]) / 5, 8) as score from s")
def topk_error_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.top_k_mean(errors, 5), 8).alias("score"))


THR = LABELED.rstrip() + """, o as (select *, row_number() over (partition by lang order by score) as place, count(*) over (partition by lang) as n, max(score) over (partition by lang) as most from s where y = 0)
"""


@plan.query(THR + "select lang, n, place as rank, round(score, 8) as threshold, round(100.0 * place / n, 6) as effective, round(100.0 / n, 6) as resolution, score = most as is_max from o where place = ceil((n - 1) * 99.0 / 100) + 1")
def order_stat_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.order_threshold(labelled(spark, sf_dir).where("y = 0"), ["lang"], "score", 99.0)
    return out.select("lang", "n", "rank", F.round("threshold", 8).alias("threshold"), F.round("effective", 6).alias("effective"), F.round("resolution", 6).alias("resolution"), "is_max")


@plan.query("""with n as (select lang, count(*) as n from documents group by lang), p as (select unnest([99.9, 99.5, 99.0, 95.0, 90.0, 50.0, 100.0])::double as p)
select lang, p as percent, case when p < 100 then ceil(round((p / 100 - 2) / (p / 100 - 1), 9)) end::bigint as least, n, p < 100 and n >= ceil(round((p / 100 - 2) / nullif(p / 100 - 1, 0), 9)) as enough from n, p""")
def min_n_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language and percentile, how many documents a threshold needs and whether there are enough."""
    percents = F.explode(F.array(*[F.lit(p) for p in (99.9, 99.5, 99.0, 95.0, 90.0, 50.0, 100.0)])).alias("percent")
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", percents).withColumn("least", S.least_rows(F.col("percent")))
    return n.select("lang", "percent", "least", "n", F.coalesce(F.col("n") >= F.col("least"), F.lit(False)).alias("enough"))


CONF = THR + """, t as (select lang, score as thr from o where place = ceil((n - 1) * 90.0 / 100) + 1),
c as (select lang, count(*) filter (y = 0 and score <= thr) as tn, count(*) filter (y = 0 and score > thr) as fp, count(*) filter (y = 1 and score <= thr) as fn, count(*) filter (y = 1 and score > thr) as tp from s join t using (lang) group by lang)
"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    t = S.order_threshold(rows.where("y = 0"), ["lang"], "score", 90.0).select("lang", "threshold")
    return S.confusion(rows.join(t, "lang"), ["lang"], "y", F.col("score") > F.col("threshold"))


@plan.query(CONF + "select * from c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@plan.query(CONF + """select lang, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity, round(tp / nullif(tp + fp, 0), 6) as precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) as balanced_accuracy, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc, round(fp / nullif(fp + tn, 0), 6) as fpr from c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.binary_metrics(counted(spark, sf_dir))
    return m.select("lang", *[F.round(x, 6).alias(x) for x in ("sensitivity", "specificity", "precision", "f1", "balanced_accuracy", "mcc", "fpr")])


@plan.query(CONF + """, w as (select lang, (tp + fn)::double as n, tp / nullif(tp + fn, 0)::double as p, 1.959963984540054 as z from c)
select lang, round(case when n > 0 then greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 0) end, 6) as low, round(case when n > 0 then least((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1) end, 6) as high from w""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = S.wilson(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double"))
    return counted(spark, sf_dir).select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


STEPS = LABELED.rstrip() + """, g as (select lang, score, sum(y) as pos, sum(1 - y) as neg from s group by all),
k as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by lang) as p, sum(neg) over (partition by lang) as q from g window w as (partition by lang order by score desc rows unbounded preceding))
"""


@plan.query(STEPS + "select lang, round(sum(neg * (tp - pos / 2.0)) / nullif(max(p) * max(q), 0), 6) as roc_auc from k group by lang")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.roc_auc(labelled(spark, sf_dir), ["lang"], "y", "score").select("lang", F.round("roc_auc", 6).alias("roc_auc"))


PR = STEPS + """, c as (select lang, score, tp / p::double as r, tp / (tp + fp)::double as c from k),
l as (select lang, r - coalesce(lag(r) over w, 0) as step, c, coalesce(lag(c) over w, 1) as c0 from c window w as (partition by lang order by score desc))
"""


@plan.query(PR + "select lang, round(sum(step * (c + c0) / 2), 6) as pr_auc from l group by lang")
def pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pr_areas(labelled(spark, sf_dir), ["lang"], "y", "score").select("lang", F.round("pr_auc", 6).alias("pr_auc"))


@plan.query(PR + "select lang, round(sum(step * c), 6) as average_precision from l group by lang")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pr_areas(labelled(spark, sf_dir), ["lang"], "y", "score").select("lang", F.round("average_precision", 6).alias("average_precision"))


@plan.query(STEPS + """, e as (select score, tp, fp, lang, row_number() over (partition by lang order by score desc) - 1 as i, count(*) over (partition by lang) as n from k),
w as (select distinct lang, n, unnest(range(101)) as j from (select distinct lang, n from e)), p as (select distinct lang, round_even(j * (n - 1) / 100.0, 0)::int as i from w)
select lang, round(score, 8) as score, tp::bigint as tp, fp::bigint as fp from e where n <= 101 or (lang, i) in (select lang, i from p)""")
def roc_curve_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = S.score_steps(labelled(spark, sf_dir), ["lang"], "y", "score")
    return S.sample_evenly(steps.select("lang", "score", "tp", "fp"), ["lang"], [F.desc("score")], 101).select("lang", F.round("score", 8).alias("score"), "tp", "fp")


BOOT = """x0 as (select o.{k}, v, r, pos % 2147483647 as p, (pos % 2147483647 * 16807 % 2147483647 + r * 48271 + 42) % 2147483647 as a from o, (select unnest(range(20000)) as r) where v is not null),
x1 as (select *, (a * a + r) % 2147483647 as b from x0), x2 as (select *, (b * 69621 + p) % 2147483647 as c from x1),
x3 as (select {k}, r, v, (c * c + b) % 2147483647 as h from x2), w as (select {k}, r, v, """ + " + ".join(f"(h >= {b})::int" for b in S.BOUNDS) + """ as n from x3),
m as (select {k}, r, sum(v * n) / nullif(sum(n), 0) as m from w group by all),
q as (select {k}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by {k}),
a as (select {k}, avg(v) as mean, count(*) as n_valid from o where v is not null group by {k})
"""
USERS = "with u as (select event_type, user_id, avg(value) as v from events group by all), o as (select event_type, v, user_id as pos from u), "


@plan.query(USERS + BOOT.format(k="event_type") + "select event_type, round(mean, 6) as mean, n_valid, round(low, 6) as low, round(high, 6) as high from a join q using (event_type)")
def bootstrap_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    out = S.bootstrap_means(users, ["event_type"], "v", "user_id")
    return out.select("event_type", F.round("mean", 6).alias("mean"), "n_valid", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@plan.query("with u as (select user_id, avg(value) filter (event_type = 'click') - avg(value) filter (event_type = 'purchase') as v from events group by user_id), o as (select 1 as g, v, user_id as pos from u), " + BOOT.format(k="g") + "select n_valid, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, case when low > 0 then 'survives' when high < 0 then 'does_not_survive' else 'inconclusive' end as verdict from a join q using (g)")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.avg("value"))
    out = S.bootstrap_means(wide.withColumn("v", F.col("click") - F.col("purchase")).withColumn("g", F.lit(1)), ["g"], "v", "user_id")
    return out.select("n_valid", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), S.verdict(F.col("low"), F.col("high")).alias("verdict"))


@plan.query("with u as (select event_type, user_id % 5 as seed, avg(value) as v from events group by all) select event_type, count(*) as n, round(avg(v), 6) as mean, round(min(v), 6) as low, round(max(v), 6) as high from u group by event_type")
def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    return runs.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


@plan.query("""with x as (select v.vec_id, v.label, list_sort(list_transform(embedding, lambda x: x::double * x::double), 'DESC') as e from embeddings v),
s as (select k, label, list_sum(e[1:k]) / k as score, label < 5 as healthy from x, (select unnest([1, 3, 5]) as k)),
o as (select k, score, row_number() over (partition by k order by score) as place, count(*) over (partition by k) as n from s where healthy),
t as (select k, p, score as thr from o, (select unnest([95.0, 99.0]) as p) where place = ceil((n - 1) * p / 100) + 1)
select k, p as percent, count(*) filter (healthy and score > thr) as fp, count(*) filter (not healthy and score > thr) as tp, round(count(*) filter (healthy and score > thr) / count(*) filter (healthy), 6) as fpr from s join t using (k) group by all""")
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") < 5).alias("healthy"), errors.alias("e"))
    # sort once, then every k
    s = rows.select("healthy", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), S.top_k_mean(F.col("e"), k).alias("score")) for k in (1, 3, 5)])).alias("x")).select("healthy", "x.*")
    parts = [S.order_threshold(s.where("healthy"), ["k"], "score", p).select("k", F.lit(p).alias("percent"), "threshold") for p in (95.0, 99.0)]
    hit, ok = F.col("score") > F.col("threshold"), F.col("healthy")
    g = s.join(parts[0].unionByName(parts[1]), "k").groupBy("k", "percent").agg(F.count_if(ok & hit).alias("fp"), F.count_if(~ok & hit).alias("tp"), F.count_if(ok).alias("h"))
    return g.select("k", "percent", "fp", "tp", F.round(F.col("fp") / F.col("h"), 6).alias("fpr"))


@plan.query("""with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
c as (select *, unnest(case when i <= 20 then ['healthy', 'current_full', 'post_fault_reset'] when i <= 27 then ['current_full', 'transition', 'post_fault_reset'] else ['current_full', 'sustained', 'post_fault_reset'] end) as cohort,
  avg(value) over (partition by user_id order by i rows between 7 preceding and current row) as running, avg(value) over (partition by user_id, i > 20 order by i rows between 7 preceding and current row) as reset from e)
select cohort, count(*) as n, count(distinct user_id) as users, round(avg(case when cohort = 'post_fault_reset' then reset else running end), 6) as mean from c group by cohort""")
def ablation_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in its cohorts: the first 20 of a user are healthy, the next seven transition, later ones sustained; the score is a mean of eight that runs on, or starts anew after the fault."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    last = lambda *by: F.avg("value").over(Window.partitionBy("user_id", *by).orderBy("i").rowsBetween(-7, 0))
    e = table(spark, sf_dir, "events").select("user_id", "value", i.alias("i")).withColumn("post", F.col("i") > 20)
    own = F.when(~F.col("post"), "healthy").when(F.col("i") <= 27, "transition").otherwise("sustained")
    rows = e.withColumn("running", last()).withColumn("reset", last("post")).select("user_id", "running", "reset", F.explode(F.array(own, F.lit("current_full"), F.lit("post_fault_reset"))).alias("cohort"))
    score = F.when(F.col("cohort") == "post_fault_reset", F.col("reset")).otherwise(F.col("running"))
    return rows.groupBy("cohort").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg(score), 6).alias("mean"))


CROSS = """with m as (select median(value) as thr from events), e as (select user_id, value > thr as c, row_number() over (partition by user_id order by ts, event_id) as i from events, m),
g as (select *, sum(case when c then 0 else 1 end) over (partition by user_id order by i) as g from e), l as (select *, sum(case when c then 1 else 0 end) over (partition by user_id, g order by i) as len from g),
f as (select user_id, min(i) filter (len >= 3) - 2 as first from l group by user_id)
"""


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    middle = events.agg(F.percentile("value", 0.5)).first()[0]  # one number
    return D.confirmed_crossing(events, ["user_id"], ["ts", "event_id"], F.col("value") > F.lit(middle))


@plan.query(CROSS + "select user_id, first::bigint as first from f")
def confirmed_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings(spark, sf_dir).select("user_id", F.col("first").cast("long").alias("first"))


FOUND = CROSS.rstrip() + ", a as (select user_id, user_id % 3 as model, case when first <= 25 then first / 50.0 end as a from f)\n"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection magnitudes: the first crossing over 50, censored past 0.5, by three groups of users."""
    f = crossings(spark, sf_dir)
    return f.select("user_id", (F.col("user_id") % 3).alias("model"), F.when(F.col("first") <= 25, F.col("first") / 50.0).alias("a"))


@plan.query(FOUND + "select g.g as a, count(*) filter (a.a <= g.g) as detected, round(count(*) filter (a.a <= g.g) / count(*), 6) as pod from a, (select unnest(range(1, 26)) / 50.0 as g) g group by g.g")
def pod_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pod_curve(found(spark, sf_dir), "a", [i / 50.0 for i in range(1, 26)]).select("a", "detected", F.round("pod", 6).alias("pod"))


@plan.query(FOUND + """, o as (select model, count(a) / count(*)::double as f, count(a) as m, list_sort(list(a) filter (a is not null)) as v from a group by model),
k as (select model, q, f, v, q / f * (m - 1) as pos from o, (select unnest([0.1, 0.5, 0.9]::double[]) as q))
select model, q, round(case when q <= f then v[1 + floor(pos)::int] + (coalesce(v[2 + floor(pos)::int], v[1 + floor(pos)::int]) - v[1 + floor(pos)::int]) * (pos - floor(pos)) end, 6) as value from k""")
def censored_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.censored_percentiles(found(spark, sf_dir), ["model"], "a", [0.1, 0.5, 0.9]).select("model", "q", F.round("value", 6).alias("value"))


WEIBULL = FOUND.replace("with m as", "with recursive m as", 1) + """, t as (select model, coalesce(a, 1.0)::double as t, (a is not null)::int::double as d from a), u as (select model, sum(d) as e, count(*) as n, sum(d * ln(t)) / sum(d) as h from t group by model),
b as (select model, 0 as it, 0.05::double as lo, 100::double as hi from u union all
  select x.model, it + 1, case when g > 0 then lo else (lo + hi) / 2 end, case when g > 0 then (lo + hi) / 2 else hi end
  from (select b.model, it, lo, hi, sum(pow(t, (lo + hi) / 2) * ln(t)) / sum(pow(t, (lo + hi) / 2)) - 2 / (lo + hi) - max(h) as g from b join t on t.model = b.model join u on u.model = b.model where it < 60 group by b.model, it, lo, hi) x),
w as (select b.model, (lo + hi) / 2 as beta, u.e, u.n from b join u on u.model = b.model where it = 60),
fit as (select w.model, n, e::bigint as n_events, beta, pow(sum(pow(t, beta)) / max(e), 1 / beta) as eta from w join t on t.model = w.model group by w.model, n, e, beta)
"""


@plan.query(WEIBULL + "select model, n, n_events, round(beta, 5) as beta, round(eta, 5) as eta from fit")
def weibull_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.weibull_fit(found(spark, sf_dir), ["model"], "a").select("model", "n", "n_events", F.round("beta", 5).alias("beta"), F.round("eta", 5).alias("eta"))


PAPER = """, z as (select model, coalesce(a, 1.0)::double as t, (a is null)::int as late, row_number() over (partition by model order by coalesce(a, 1.0), (a is null)::int) - 1 as i, count(*) over (partition by model) as n from a),
j as (select *, sum(case when late = 0 then ln((n - i) / (n - i + 1.0)::double) else 0 end) over (partition by model order by i) as s from z),
r2 as (select model, regr_r2(ln(-ln(1 - ((n + 1) * (1 - exp(s)) - 0.3) / (n + 0.4))), ln(t)) as r2 from j where late = 0 and t > 0 group by model)
"""


@plan.query(FOUND + PAPER + "select model, round(r2, 5) as r2 from r2")
def weibull_paper_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.weibull_paper_r2(found(spark, sf_dir), ["model"], "a").select("model", F.round("r2", 5).alias("r2"))


@plan.query(WEIBULL + PAPER + """, k as (select fit.model, n_events, r2, (select count(distinct a) from a where a.model = fit.model) as vals, eta * pow(-ln(0.1), 1 / beta) as q90 from fit join r2 using (model))
select model, round(q90, 5) as q90, concat_ws('; ', case when n_events < 10 then 'few detections' end, case when vals < 4 then 'few distinct values' end, case when r2 is null or r2 < 0.9 then 'poor fit' end, case when q90 is null or q90 not between 0 and 1 then 'outside the domain' end) as reasons from k""")
def adoption_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir)
    fit = D.weibull_fit(rows, ["model"], "a").join(D.weibull_paper_r2(rows, ["model"], "a"), "model").join(rows.groupBy("model").agg(F.countDistinct("a").alias("vals")), "model")
    q = D.weibull_quantile(F.col("beta"), F.col("eta"), 0.9)
    return fit.select("model", F.round(q, 5).alias("q90"), D.adoption(F.col("n_events"), F.col("vals"), F.col("r2"), q).alias("reasons"))


@plan.query("""with x as (select label, label = 0 as anchor, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as f from embeddings),
sc as (select f, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-9) as s from x where anchor group by f), m0 as (select f, median(v) as m from x where anchor group by f),
d as (select label, f, abs(median(v) - max(m)) / max(s) as d from x join m0 using (f) join sc using (f) where not anchor group by all)
select label, round(sqrt(sum(d * d)), 5) as l2, round(median(d), 5) as median, round(max(d), 5) as most, max_by(f, d)::int as feature from d group by label""")
def anchor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).select("label", (F.col("i") + 1).alias("f"), F.col("v").cast("double").alias("v"))
    healthy = x.where("label = 0")
    scale = healthy.groupBy("f").agg(F.greatest(F.percentile("v", 0.75) - F.percentile("v", 0.25), F.lit(1e-9)).alias("scale"))
    d = D.anchor_distance(healthy, x.where("label <> 0").withColumnRenamed("label", "key"), ["key"], "f", "v", scale)
    return d.select(F.col("key").alias("label"), F.round("l2", 5).alias("l2"), F.round("median", 5).alias("median"), F.round("most", 5).alias("most"), "feature")


@plan.query("""with h as (select event_id, row_number() over (order by event_id) - 1 as i from events where event_type = 'click'), f as (select event_id as fault, row_number() over (order by event_id) - 1 as j, count(*) over () as m from events where event_type = 'purchase')
select event_id, fault from h join f on i % m = j""")
def modulo_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    h = numbered(e.where("event_type = 'click'").select("event_id"), [F.asc("event_id")])
    f = numbered(e.where("event_type = 'purchase'").select(F.col("event_id").alias("fault")), [F.asc("fault")])
    m = f.count()
    return h.withColumn("place", (F.col("place") - 1) % F.lit(max(m, 1)) + 1).join(f, "place").select("event_id", "fault")


@plan.query("""with e as (select event_type as model, coalesce(user_id % 2 <> 0, false)::int as half, user_id, value from events),
e2 as (select model, half, avg(value) as e2 from e group by all), e3 as (select model, 1 - half as half, user_id, avg(value) as recall from e group by all)
select e2.model, e2.half, count(recall) as n, round(min(recall), 6) as low, round(max(recall), 6) as high, case when count(recall) = 0 then 'missing' when max(e2) between min(recall) and max(recall) then 'inside' else 'outside' end as status from e2 left join e3 on e2.model is not distinct from e3.model and e2.half = e3.half group by e2.model, e2.half""")
def fidelity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each half of the users against the range of means by user of the other half; a mean always lies in the range of its own users."""
    half = F.coalesce(F.col("user_id") % 2 != 0, F.lit(False)).cast("int")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), half.alias("half"), "user_id", "value")
    e2 = e.groupBy("model", "half").agg(F.avg("value").alias("e2"))
    e3 = e.groupBy("model", "half", "user_id").agg(F.avg("value").alias("recall"))
    g = e3.groupBy(F.col("model").alias("m"), (1 - F.col("half")).alias("h")).agg(F.count("recall").alias("n"), F.min("recall").alias("lo"), F.max("recall").alias("hi"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("e2").between(F.col("lo"), F.col("hi")), "inside").otherwise("outside")
    joined = e2.join(g, F.col("model").eqNullSafe(F.col("m")) & (F.col("half") == F.col("h")), "left")
    return joined.select("model", "half", F.coalesce("n", F.lit(0)).alias("n"), F.round("lo", 6).alias("low"), F.round("hi", 6).alias("high"), status.alias("status"))


RATE_SQL = "rt as (select p_brand as s, avg(p_size) * 1e-7 as r from part group by p_brand)"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failure rate per hour for each brand of parts: larger ones fail more often."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("scenario")).agg(F.avg("p_size").alias("size"))
    return REL.scenarios(sizes.select("scenario", (F.col("size") * 1e-7).alias("rate_per_hour")))


@plan.query(f"with {RATE_SQL} select s as scenario, round(r * 8760.0, 10) as rate_per_year, round(1.0 / r, 4) as mttf_hours from rt")
def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).select("scenario", F.round("rate_per_year", 10).alias("rate_per_year"), F.round("mttf_hours", 4).alias("mttf_hours"))


@plan.query(f"with {RATE_SQL}, x as (select s, r, k, k * 0.05::double as y from rt, (select unnest(range(401)) as k)) select s as scenario, k as step, round(exp(-r * (y * 8760.0)), 8) as reliability, round(1 - exp(-r * (y * 8760.0)), 8) as failure, round(r * exp(-r * (y * 8760.0)), 12) as density from x")
def reliability_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = REL.curves(rates(spark, sf_dir), "rate_per_hour")
    return c.select("scenario", "step", F.round("reliability", 8).alias("reliability"), F.round("failure", 8).alias("failure"), F.round("density", 12).alias("density"))


@plan.query("with s as (select p_brand, avg(p_size)::int % 10 + 1 as sev, count(*) % 10 + 1 as occ, count(distinct p_type) % 10 + 1 as det from part group by p_brand) select p_brand, (sev * occ * det)::bigint as npr, rank() over (order by sev * occ * det desc) as priority from s")
def fmeca_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.bround(F.avg("p_size"), 0).cast("int") % 10 + 1).alias("sev"), (F.count("*") % 10 + 1).alias("occ"), (F.countDistinct("p_type") % 10 + 1).alias("det"))
    npr = REL.risk_priority(F.col("sev"), F.col("occ"), F.col("det"))
    return s.select("p_brand", npr.cast("long").alias("npr")).withColumn("priority", F.rank().over(Window.orderBy(F.desc("npr"))))
