"""Operational metrics: reports, histories, averages, alerts, rate adaption, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def report(events: DataFrame) -> DataFrame:
    """One row: operations, success rate, mean latency and operations a second. events(ts, ok, latency)."""
    out = events.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.avg("latency").alias("avg_latency"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.unix_micros("b") / 1e6 - F.unix_micros("a") / 1e6
    return out.select("n", F.round(100 * F.col("n_ok") / F.nullif(F.col("n"), F.lit(0)), 4).alias("success_rate"), F.round("avg_latency", 6).alias("avg_latency"), F.round(F.col("n") / F.nullif(seconds, F.lit(0.0)), 8).alias("per_second"))


def history(points: DataFrame, name: str, ts: str, key: str, keep: int = 100) -> DataFrame:
    """The last points of each metric; each part of a metric finds its own last ones first, so none is sorted as a whole."""
    at = [F.desc(ts), F.desc(key)]
    parts = points.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)))
    some = parts.withColumn("__r", F.row_number().over(Window.partitionBy(name, "__salt").orderBy(*at))).where(F.col("__r") <= keep)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(name).orderBy(*at))).where(F.col("__r") <= keep).drop("__r", "__salt")


def counters(points: DataFrame, name: str, ts: str, value: str, key: str) -> DataFrame:
    """Running sum (counter) and last value (gauge) of each metric."""
    return points.groupBy(name).agg(F.round(F.sum(value), 4).alias("counter"), F.max_by(value, F.struct(ts, key)).alias("gauge"))


#: Points from the end of a metric that its average is made of: older ones weigh less than 2^-60 together, beyond the precision of a double.
MEMORY = 64


def moving_average(points: DataFrame, name: str, ts: str, value: str, key: str) -> DataFrame:
    """avg = (avg + x) / 2 in the order of time, the first value seeding.

    The last point weighs 1/2, the one before 1/4 and so on, the first as much as the second. So the
    last MEMORY points decide; each part of a metric keeps its own last ones, and no metric is collected or sorted as a whole.
    """
    at = [F.col(ts).desc(), F.col(key).desc()]
    salted = points.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)))
    last = salted.withColumn("__r", F.row_number().over(Window.partitionBy(name, "__salt").orderBy(*at))).where(F.col("__r") <= MEMORY)
    ranked = last.withColumn("__r", F.row_number().over(Window.partitionBy(name).orderBy(*at))).where(F.col("__r") <= MEMORY)
    n = points.groupBy(name).agg(F.count("*").alias("__n"))
    weight = F.when(F.col("__r") == F.col("__n"), F.pow(F.lit(2.0), 1 - F.col("__r"))).otherwise(F.pow(F.lit(2.0), -F.col("__r")))
    return ranked.join(n, name).groupBy(name).agg(F.round(F.sum(F.col(value) * weight), 6).alias("ema"))


def alert(metric: Column, value: Column) -> Column:
    """critical, warning or ok by the thresholds of cpu, memory, latency and queue."""
    return (
        F.when((metric == "cpu") & (value > 90), "critical").when((metric == "cpu") & (value > 80), "warning").when((metric == "memory") & (value > 95), "critical")
        .when((metric == "memory") & (value > 85), "warning").when((metric == "latency") & (value > 1000), "warning").when((metric == "queue") & (value > 1000), "warning").otherwise("ok")
    )


def adapted_rate(windows: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    """The rate after each window(errors_share, latency_s): slower on errors or latency, faster when both are low; only changes over a tenth count."""
    e, lat = F.col("errors_share"), F.col("latency_s")
    factor = F.when(e > 0.1, 0.8).when(lat > 5, 0.9).when((e < 0.05) & (lat < 2.5), 1.1).otherwise(1.0)
    new = F.greatest(F.least(F.lit(rate) * factor, F.lit(high)), F.lit(low))
    return windows.withColumn("new_rate", F.when(F.abs(new - rate) / rate > 0.1, new).otherwise(F.lit(rate)))


def breaker(events: DataFrame, part: str, ts: str, key: str, most: int) -> DataFrame:
    """events(ok) with the number of failures in a row and whether the breaker is open after each."""
    order = Window.partitionBy(part).orderBy(ts, key)
    runs = events.withColumn("__run", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(part, "__run").orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((~F.col("ok")).cast("int")).over(in_run)
    return runs.withColumn("failures", n).withColumn("open", F.col("failures") >= most).drop("__run")
