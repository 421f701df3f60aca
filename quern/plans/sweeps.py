"""Severity sweeps over the embeddings as waves, and the recurrent model over cycle windows, under thresholds set on healthy ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import models as M
from quern.operators import scoring as S
from quern.operators import signal as G
from quern.operators import sweep as W
from quern.operators.recurrent import LENGTH, RecurrentAutoencoder
from quern.plans.base import Plan
from quern.plans.signals import cycles
from quern.sources.shared import staged
from quern.sources.tables import spread, table

plan = Plan()
SCORERS = {"top5": W.top_k_scorer(5), "rms": W.rms}
PERCENT = 90.0


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("wave"), "label")


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wave swept, each model against the order statistic of its scores of label 0."""
    healthy = W.scores(waves(spark, sf_dir).where("label = 0"), SCORERS)
    thresholds = {m: S.order_threshold(healthy.withColumn("g", F.lit(1)), ["g"], m, PERCENT).first() for m in SCORERS}  # one number a model
    models = {m: (SCORERS[m], t["threshold"]) for m, t in thresholds.items() if t is not None}
    return W.sweep(waves(spark, sf_dir), W.INJECTIONS, models)


SWEEP = f"""with e as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as w from embeddings where len(embedding) > 0),
sc as (select id, label, list_sum(list_sort(list_transform(w, lambda x: x * x), 'DESC')[1:5]) / 5 as top5, sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)) as rms from e),
o as (select top5, rms, row_number() over (order by top5) as a, row_number() over (order by rms) as b, ceil((count(*) over () - 1) * {PERCENT} / 100) + 1 as pl from sc where label = 0),
th as (select max(top5) filter (a = pl) as top5, max(rms) filter (b = pl) as rms from o),
g as (select k, round(0.02 + k * 0.02, 4) as a from (select unnest(range(50)) as k)),
x as (select id, k, a, 'half_cycle' as injection, list_transform(w, lambda x: case when x > 0 then x * (1 - a) else x end) as w from e, g
  union all select id, k, a, 'gain', list_transform(w, lambda x: x * (1 + 0.2 * a)) from e, g
  union all select id, k, a, 'step', list_transform(w, lambda x, i: case when i - 1 >= len(w) // 2 then x + a * list_max(list_transform(w, lambda y: abs(y))) else x end) from e, g),
sq as (select id, k, a, injection, list_transform(w, lambda x: x * x) as s from x),
v as (select id, k, a, injection, 'top5' as model, list_sum(list_sort(s, 'DESC')[1:5]) / 5 > th.top5 as up from sq, th union all select id, k, a, injection, 'rms', sqrt(list_sum(s) / len(s)) > th.rms from sq, th),
n as (select *, up and lead(up, 1, false) over w and lead(up, 2, false) over w as run from v window w as (partition by id, injection, model order by k)),
f as (select id, injection, model, min(a) filter (run) as severity from n group by all)
"""


@plan.query(SWEEP + "select id, injection, model, severity is not null as detected, severity from f")
def detectability_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).select("id", "injection", "model", "detected", "severity")


@plan.query(SWEEP + "select injection, model, count(*) as n, count(severity) as n_detected, round(count(severity) / count(*), 6) as share, count(severity) < count(*) as censored, round(median(severity), 6) as median from f group by all")
def model_detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.detectability(swept(spark, sf_dir))
    return out.select("injection", "model", "n", "n_detected", F.round("share", 6).alias("share"), "censored", F.round("median", 6).alias("median"))


def window_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, window, sequence): the standardised features of a supplier's last eight windows, the first one repeated at the head, flat."""
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    f = cycles(spark, sf_dir).groupBy("l_suppkey", "window").agg(F.percentile(price, 0.5).alias("f0"), G.iqr(price).alias("f1"), G.rms(qty).alias("f2"), F.stddev_pop(qty).alias("f3"), F.avg("l_discount").alias("f4"), F.avg("l_tax").alias("f5"))
    names = [f"f{i}" for i in range(6)]
    f = staged(f, "window-features")  # one row for fifty of the table; every round reads what follows, and none the table again
    fitted = f.agg(*[x for n in names for x in (F.avg(n).alias(f"m{n}"), F.stddev_pop(n).alias(f"s{n}"))]).first()  # two numbers a feature
    scaled = F.array(*[(F.col(n) - F.lit(fitted[f"m{n}"])) / F.lit(fitted[f"s{n}"] or 1.0) for n in names])
    rows = G.causal_sequence(f.select("l_suppkey", "window", scaled.alias("row")), ["l_suppkey"], "window", "row", LENGTH)
    return staged(rows.select("l_suppkey", "window", F.flatten("sequence").alias("sequence")), "window-sequences")


@plan.query()
def recurrent_autoencoder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrent model learned from four in five suppliers; every window's score, its threshold from the fifth's, and whether it is crossed."""
    rows = spread(window_sequences(spark, sf_dir), "l_suppkey")
    size, held = 6 * LENGTH, F.col("l_suppkey") % 5 == 0
    model, _ = M.fit_dense(rows, "sequence", held, size, [42], rounds=8, make=RecurrentAutoencoder, passes=4)[42]
    scores = M.sequence_scores(rows, ["l_suppkey", "window"], "sequence", model, size)
    limit = S.order_threshold(scores.where(held).withColumn("g", F.lit(1)), ["g"], "score", 99.0).first()
    threshold = F.lit(limit["threshold"] if limit else None).cast("double")
    return scores.select("l_suppkey", "window", "score", threshold.alias("threshold"), (F.col("score") > threshold).alias("detected"))
