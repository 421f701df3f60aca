"""Detection magnitudes: confirmed crossings, censored percentiles, POD, Weibull fits, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confirmed_crossing(points: DataFrame, keys: list[str], order: list[str], crossed: Column, run: int = 3) -> DataFrame:
    """(keys, first): place (from 1) of the first point of the first run of ``run`` crossings; null without one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c = points.select(*keys, *order, F.coalesce(crossed, F.lit(False)).cast("int").alias("c"))
    c = c.withColumn("i", F.row_number().over(w)).withColumn("g", F.sum(1 - F.col("c")).over(w))
    runs = c.withColumn("len", F.sum("c").over(Window.partitionBy(*keys, "g").orderBy("i")))
    return runs.groupBy(*keys).agg((F.min(F.when(F.col("len") >= run, F.col("i"))) - (run - 1)).alias("first"))


def pod_curve(found: DataFrame, a: str, grid: list[float]) -> DataFrame:
    """(a, detected, pod): the share of trajectories detected at or below each severity; censored ones never."""
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    hits = found.select(F.col(a).alias("at")).select("at", points.alias("a"))
    return hits.groupBy("a").agg(F.count_if(F.col("at") <= F.col("a")).alias("detected"), F.count("*").alias("n")).select("a", "detected", (F.col("detected") / F.col("n")).alias("pod"))


def censored_percentiles(found: DataFrame, keys: list[str], a: str, quantiles: list[float]) -> DataFrame:
    """(keys, q, value): quantile q of all rests on the detected share f as their quantile q / f; null beyond f."""
    good = found.where(F.col(a).isNotNull())
    share = found.groupBy(*keys).agg((F.count(a) / F.count("*")).alias("f"), F.count(a).alias("m"))
    asked = share.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).withColumn("at", F.when(F.col("q") <= F.col("f"), F.col("q") / F.col("f") * (F.col("m") - 1)))
    placed = good.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(a)) - 1).select(*keys, "i", a)
    low = asked.join(placed.select(*keys, F.col("i").alias("lo"), F.col(a).alias("x")), keys, "left").where((F.col("lo") == F.floor("at")) | F.col("at").isNull())
    low = low.dropDuplicates([*keys, "q"])
    high = placed.select(*keys, F.col("i").alias("hi"), F.col(a).alias("y"))
    both = low.join(high.withColumn("lo", F.col("hi") - 1).drop("hi"), [*keys, "lo"], "left")
    value = F.when(F.col("at").isNotNull(), F.col("x") + (F.coalesce("y", "x") - F.col("x")) * (F.col("at") - F.floor("at")))
    return both.select(*keys, "q", value.alias("value"))


def weibull_fit(found: DataFrame, keys: list[str], a: str, censor_at: float = 1.0, rounds: int = 60) -> DataFrame:
    """(keys, n, n_events, beta, eta): maximum likelihood with right censoring, by bisection on the shape in [0.05, 100].

    Values are first counted, so a key holds one entry a distinct value (the severity grid bounds them).
    """
    t = F.when(F.col(a).isNull(), F.lit(censor_at)).otherwise(F.col(a))
    counted = found.select(*keys, t.alias("t"), F.col(a).isNotNull().cast("double").alias("d")).groupBy(*keys, "t").agg(F.count("*").cast("double").alias("n"), F.sum("d").alias("d"))
    packed = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "n", "d"))).alias("v"), F.sum("n").cast("long").alias("n"), F.sum("d").cast("long").alias("n_events"))
    fit = packed.withColumn(
        "b",
        F.expr(
            "aggregate(sequence(1, " + str(rounds) + "), named_struct('lo', 0.05D, 'hi', 100D), (s, i) -> "
            "transform(array((s.lo + s.hi) / 2), m -> if("
            "aggregate(v, 0D, (x, r) -> x + r.n * pow(r.t, m) * ln(r.t)) / aggregate(v, 0D, (x, r) -> x + r.n * pow(r.t, m)) - 1 / m"
            " - aggregate(v, 0D, (x, r) -> x + r.d * ln(r.t)) / nullif(aggregate(v, 0D, (x, r) -> x + r.d), 0) > 0, "
            "named_struct('lo', s.lo, 'hi', m), named_struct('lo', m, 'hi', s.hi)))[0])"
        ),
    )
    beta = F.when(F.col("n_events") > 0, (F.col("b.lo") + F.col("b.hi")) / 2)
    eta = F.expr("pow(aggregate(v, 0D, (x, r) -> x + r.n * pow(r.t, beta)) / nullif(n_events, 0), 1 / beta)")
    return fit.withColumn("beta", beta).withColumn("eta", eta).select(*keys, "n", "n_events", "beta", "eta")


def weibull_paper_r2(found: DataFrame, keys: list[str], a: str, censor_at: float = 1.0) -> DataFrame:
    """(keys, r2): fit on Weibull paper, adjusted ranks under censoring and median ranks (order - 0.3) / (n + 0.4)."""
    t = found.select(*keys, F.coalesce(F.col(a), F.lit(censor_at)).alias("t"), F.col(a).isNull().cast("int").alias("late"))
    w = Window.partitionBy(*keys)
    order = w.orderBy("t", "late")
    ranked = t.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(w))
    step = F.when(F.col("late") == 0, F.log((F.col("n") - F.col("i")) / (F.col("n") - F.col("i") + 1.0))).otherwise(0.0)
    ranked = ranked.withColumn("s", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("late = 0 and t > 0")
    median = ((F.col("n") + 1) * (1 - F.exp("s")) - 0.3) / (F.col("n") + 0.4)
    return ranked.select(*keys, F.log("t").alias("x"), F.log(-F.log(1 - median)).alias("y")).groupBy(*keys).agg(F.regr_r2("y", "x").alias("r2"))


def weibull_quantile(beta: Column, eta: Column, q: float) -> Column:
    return eta * F.pow(-F.log(F.lit(1 - q)), 1 / beta)


def adoption(events: Column, distinct: Column, r2: Column, quantile: Column) -> Column:
    """Reasons against a parametric fit, joined; empty if it may be used."""
    return F.concat_ws("; ", F.when(events < 10, "few detections"), F.when(distinct < 4, "few distinct values"), F.when(r2.isNull() | (r2 < 0.90), "poor fit"), F.when(quantile.isNull() | ~quantile.between(0, 1), "outside the domain"))


def anchor_distance(anchor: DataFrame, rows: DataFrame, keys: list[str], feature: str, value: str, scale: DataFrame) -> DataFrame:
    """(keys, l2, median, most, feature): distance of the medians of each key's rows from the anchor's, feature by feature over scale (feature, scale)."""
    at = anchor.groupBy(feature).agg(F.percentile(value, 0.5).alias("x")).join(scale, feature)
    m = rows.groupBy(*keys, feature).agg(F.percentile(value, 0.5).alias("y"))
    d = m.join(at, feature).withColumn("d", F.abs(F.col("x") - F.col("y")) / F.col("scale"))
    return d.groupBy(*keys).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"), F.percentile("d", 0.5).alias("median"), F.max("d").alias("most"), F.max_by(feature, "d").alias("feature"))
