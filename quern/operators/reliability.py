"""Exponential reliability curves and risk priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS = 8760.0
YEARS, POINTS = 20, 401


def reliability(rate: Column, hours: Column) -> Column:
    return F.exp(-rate * hours)


def failure(rate: Column, hours: Column) -> Column:
    return -F.expm1(-rate * hours)


def density(rate: Column, hours: Column) -> Column:
    return rate * reliability(rate, hours)


def valid_rate(rate: Column) -> Column:
    return F.when((rate > 0) & (rate < float("inf")), rate)


def scenarios(rates: DataFrame) -> DataFrame:
    """rates (scenario, rate_per_hour) with the yearly rate and the mean time to failure; a rate that is not positive and finite has none."""
    rate = valid_rate(F.col("rate_per_hour"))
    return rates.withColumn("rate_per_year", rate * HOURS).withColumn("mttf_hours", F.try_divide(F.lit(1.0), rate))


def curves(table: DataFrame, rate: str, years: int = YEARS, points: int = POINTS) -> DataFrame:
    """table with ``years``, reliability, failure, density and hazard at even times."""
    at = table.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("years", F.col("step") * (years / (points - 1)))
    r, h = F.col(rate), F.col("years") * HOURS
    return at.withColumn("reliability", reliability(r, h)).withColumn("failure", failure(r, h)).withColumn("density", density(r, h)).withColumn("hazard", r)


def risk_priority(severity: Column, occurrence: Column, detection: Column) -> Column:
    """Product of the three scores (1 to 10 each); null if one is missing or outside."""
    ok = severity.between(1, 10) & occurrence.between(1, 10) & detection.between(1, 10)
    return F.when(ok, severity * occurrence * detection)
