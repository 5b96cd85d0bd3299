"""Batch jobs and queues: progress, order, retries, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queues by type of work: capacity and workers.
QUEUES = {"download": (1000, 10), "extraction": (500, 8), "classification": (200, 4), "indexing": (300, 6)}
RETRY_CAP_S = 300


def progress(items: DataFrame, job: str) -> DataFrame:
    """Counts by outcome and the final status of each job. items(job, outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = items.groupBy(job).agg(F.count("*").alias("total"), n("ok").alias("success"), n("error").alias("errors"), n("skipped").alias("skipped"))
    done = F.col("success") + F.col("errors") + F.col("skipped")
    status = F.when((F.col("errors") > 0) & (F.col("success") == 0), "failed").otherwise("completed")
    return out.withColumn("percent", F.round(100 * done / F.col("total"), 2)).withColumn("status", status)


def multi_status(success: Column, errors: Column) -> Column:
    return F.when(success == 0, "failed").when(errors > 0, "partial_success").otherwise("completed")


def queue_order(items: DataFrame, queue: str, priority: str, created: str, key: str) -> DataFrame:
    """The place of each item: high priority first, then first come first served; items without a time come first.

    Items that came in one hour with one priority are ranked together; how many items stand before
    them comes from counts by hour, so no queue is sorted by one task.
    """
    kind = items.schema[created].dataType.typeName()
    hour = F.date_trunc("hour", F.col(created)) if kind.startswith("timestamp") else F.lit(0)
    parts = items.withColumn("__hour", hour)
    same = [queue, priority, "__hour"]
    counts = parts.groupBy(*same).agg(F.count("*").alias("__n"))
    first = Window.partitionBy(queue).orderBy(F.desc(priority), F.asc("__hour")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*same, F.coalesce(F.sum("__n").over(first), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(F.asc(created), F.asc(key)))
    met = parts.withColumn("__rank", rank).alias("i").join(before.alias("b"), [F.col(f"i.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same])
    return met.select(*[F.col(f"i.{c}") for c in items.columns], (F.col("__rank") + F.col("__before")).cast("int").alias("place"))


def backoff(attempt: Column, delay_s: int = 5) -> Column:
    """Seconds before the next try: doubling, at most five minutes."""
    return F.least(F.lit(delay_s) * F.pow(F.lit(2), attempt - 1), F.lit(RETRY_CAP_S)).cast("bigint")


def ready(items: DataFrame, now: Column) -> DataFrame:
    return items.where(F.col("next_retry").isNull() | (F.col("next_retry") <= now))


def queue_stats(items: DataFrame, queue: str) -> DataFrame:
    """By queue and (queue null) over all: items, completed, failed and the mean wait."""
    return items.rollup(queue).agg(
        F.count("*").alias("n_items"), F.count_if(F.col("outcome") == "ok").alias("completed"), F.count_if(F.col("outcome") == "error").alias("failed"), F.round(F.avg("wait"), 6).alias("avg_wait")
    )
