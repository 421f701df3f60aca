"""Signal queries: cycle windows over lineitem by supplier, event series by user, embeddings as waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import signal as S
from quern.plans.base import Plan
from quern.sources.tables import table

plan = Plan()
SIZE = 50

WINDOWS = """with l as (select l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) - 1 as idx, count(*) over (partition by l_suppkey) as n from lineitem),
w as (select *, idx // 50 as win from l where (idx // 50 + 1) * 50 <= n)
"""


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return S.windows(rows, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], SIZE)


@plan.query(WINDOWS + """select l_suppkey, win as window, round(median(l_extendedprice), 6) as dc_median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) as dc_iqr,
  round(sqrt(avg(l_quantity * l_quantity)), 6) as rms, min(idx) as first_idx, max(idx) as last_idx from w group by all""")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    out = cycles(spark, sf_dir).groupBy("l_suppkey", "window").agg(F.percentile(price, 0.5).alias("m"), S.iqr(price).alias("i"), S.rms(F.col("l_quantity")).alias("r"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return out.select("l_suppkey", "window", F.round("m", 6).alias("dc_median"), F.round("i", 6).alias("dc_iqr"), F.round("r", 6).alias("rms"), "first_idx", "last_idx")


@plan.query(WINDOWS + """, f as (select l_suppkey, win, sqrt(avg(l_quantity * l_quantity)) as a, sqrt(avg(l_discount * l_discount)) * 400 as b, sqrt(avg(l_tax * l_tax)) * 600 as c from w group by all)
select l_suppkey, win as window, round(sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 3) / greatest((a + b + c) / 3, 2.220446049250313e-16), 6) as unbalance from f""")
def rms_unbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cycles(spark, sf_dir).groupBy("l_suppkey", "window").agg(S.rms(F.col("l_quantity")).alias("a"), (S.rms(F.col("l_discount")) * 400).alias("b"), (S.rms(F.col("l_tax")) * 600).alias("c"))
    return rows.select("l_suppkey", "window", F.round(S.unbalance(F.col("a"), F.col("b"), F.col("c")), 6).alias("unbalance"))


@plan.query(WINDOWS + """select l_suppkey, win as window, round(avg(l_quantity * l_extendedprice), 2) as power_mean, round(stddev_pop(l_quantity * l_extendedprice), 2) as power_std,
  round(median(l_quantity * l_discount), 6) as dc_power_median, round(quantile_cont(l_quantity * l_discount, 0.75) - quantile_cont(l_quantity * l_discount, 0.25), 6) as dc_power_iqr from w group by all""")
def power_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dc = F.col("l_quantity") * F.col("l_extendedprice"), F.col("l_quantity") * F.col("l_discount")
    out = cycles(spark, sf_dir).groupBy("l_suppkey", "window").agg(F.avg(p).alias("a"), F.stddev_pop(p).alias("b"), F.percentile(dc, 0.5).alias("c"), S.iqr(dc).alias("d"))
    return out.select("l_suppkey", "window", F.round("a", 2).alias("power_mean"), F.round("b", 2).alias("power_std"), F.round("c", 6).alias("dc_power_median"), F.round("d", 6).alias("dc_power_iqr"))


@plan.query("""
with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
h as (select vec_id, k, sqrt(sum(v * cos(2 * pi() * k / 64 * i)) ** 2 + sum(v * sin(2 * pi() * k / 64 * i)) ** 2) as m from x, (select unnest(range(1, 33)) as k) group by all)
select vec_id, round(sqrt(sum(m * m) filter (k >= 2)) / greatest(max(m) filter (k = 1), 2.220446049250313e-16), 5) as thd from h group by vec_id""")
def thd_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.thd(F.col("embedding"), 64), 5).alias("thd"))


EVENTS = "e as (select user_id, event_id, ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, count(*) over (partition by user_id) as n from events)"
SPLIT = f"""with {EVENTS}, s as (select *, floor(n * 0.5::double)::bigint as a, floor(n * 0.65::double)::bigint as b, floor(n * 0.8::double)::bigint as c from e),
r as (select *, case when n < 60 or b - a - 2 < 5 or c - b - 2 < 5 then null when idx < a then 'train' when idx >= a + 2 and idx < b then 'validation' when idx >= b + 2 and idx < c then 'calibration' when idx >= c + 2 then 'test' end as role from s)
"""


def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return S.purged_split(rows, "user_id", ["ts", "event_id"], least_role=5)


@plan.query(SPLIT + "select user_id, event_id, idx, role from r")
def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_events(spark, sf_dir).select("user_id", "event_id", "idx", "role")


@plan.query(SPLIT + "select role, count(*) as n_rows, count(distinct user_id) as n_trials, count(distinct event_id) as n_distinct from r group by role")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_events(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_trials"), F.countDistinct("event_id").alias("n_distinct"))


BASE = """, t as (select * from r where role = 'train'), o as (select greatest(0.1 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 1e-6) as floor from t),
b as (select user_id, median(value) as m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), max(floor)) as s, count(*) as n from t, o group by user_id)
"""


@plan.query(SPLIT + BASE + "select user_id, round(m, 6) as median, round(s, 6) as scale, n from b")
def robust_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = S.robust_baseline(split_events(spark, sf_dir).where("role = 'train'"), "user_id", "value")
    return base.select("user_id", F.round("median", 6).alias("median"), F.round("scale", 6).alias("scale"), "n")


@plan.query(SPLIT + BASE + "select event_id, role, round((value - m) / s, 6) as normal from r join b using (user_id) where role is not null")
def baseline_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_events(spark, sf_dir).where("role is not null")
    base = S.robust_baseline(rows.where("role = 'train'"), "user_id", "value")
    return rows.join(base, "user_id").select("event_id", "role", F.round((F.col("value") - F.col("median")) / F.col("scale"), 6).alias("normal"))


@plan.query(SPLIT + ", t as (select median(value) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as s from r where role = 'train') select event_id, round((value - m) / case when s = 0 then 1 else s end, 6) as scaled from r, t where role is not null")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_events(spark, sf_dir).where("role is not null")
    return S.robust_scale(rows, rows.where("role = 'train'"), "value").select("event_id", F.round("scaled", 6).alias("scaled"))


@plan.query(f"""with {EVENTS}, b as (select user_id, median(value) as m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) as s from e where idx < greatest(30, floor(n * 0.5)) group by user_id)
select event_id, round((value - m) / s, 6) as normal from e join b using (user_id)""")
def commissioning_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_events(spark, sf_dir)
    return S.commission(rows, "user_id", "value").select("event_id", F.round("normal", 6).alias("normal"))


@plan.query(SPLIT + """, q as (select event_id, user_id, role, idx, list(value) over (partition by user_id, role order by idx rows between 7 preceding and current row) as l, first_value(value) over (partition by user_id, role order by idx) as f from r where role is not null)
select event_id, round(list_sum(l) + f * (8 - len(l)), 6) as total, len(l) as filled, round(l[-1], 6) as last from q""")
def causal_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.causal_sequence(split_events(spark, sf_dir).where("role is not null"), ["user_id", "role"], "idx", "value")
    seq = F.col("sequence")
    first = F.count("*").over(S.Window.partitionBy("user_id", "role").orderBy("idx"))
    total = F.aggregate(seq, F.lit(0.0), lambda s, v: s + v)
    return rows.select("event_id", F.round(total, 6).alias("total"), F.least(first, F.lit(8)).alias("filled"), F.round(F.element_at(seq, -1), 6).alias("last"))


@plan.query("""with g as (select unnest(range(0, 5)) / 4.0 as a), x as (select vec_id, a, list_transform(embedding, lambda v: case when v > 0 then v::double * (1 - a) else v::double end) as h, list_transform(embedding, lambda v: v::double * (1 + 0.2 * a)) as s from embeddings, g)
select vec_id, a, round(sqrt(list_sum(list_transform(h, lambda v: v * v)) / 64), 6) as half_rms, round(sqrt(list_sum(list_transform(s, lambda v: v * v)) / 64), 6) as gain_rms from x""")
def severity_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = F.transform("embedding", lambda v: v.cast("double"))
    grid = table(spark, sf_dir, "embeddings").select("vec_id", wave.alias("wave"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).withColumn("a", F.col("k") / 4.0)
    rms = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v) / 64)
    return grid.select("vec_id", "a", F.round(rms(S.inject(F.col("wave"), "half_cycle", F.col("a"))), 6).alias("half_rms"), F.round(rms(S.inject(F.col("wave"), "gain", F.col("a"))), 6).alias("gain_rms"))
