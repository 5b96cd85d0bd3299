"""Queries of jobs, queues, metrics and streams over the event and result tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, metrics
from ..session import table, work_dir
from ..streaming import streams


def _items(s, d):
    """Processing runs as queue items."""
    r = table(s, d, "classification_results")
    outcome = F.when(F.col("success"), "ok").when(F.col("error").isNotNull(), "error").otherwise("skipped")
    return r.select(F.col("provider").alias("queue"), "result_id", outcome.alias("outcome"), (F.col("processing_time_ms") / 1000).alias("wait"), (F.col("result_id") % 4).alias("priority"), F.col("processed_at").alias("created"))


_ITEMS = "(SELECT provider AS queue, result_id, CASE WHEN success THEN 'ok' WHEN error IS NOT NULL THEN 'error' ELSE 'skipped' END AS outcome, processing_time_ms / 1000 AS wait, result_id % 4 AS priority, processed_at AS created FROM classification_results)"


def _points(s, d):
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("event_type").alias("name"), "value", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), "user_id")


def progress(s, d):
    return jobs.progress(_items(s, d), "queue")


def retry(s, d):
    e = table(s, d, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 8 + 1).alias("attempt"))
    return e.select("event_id", "attempt", jobs.backoff(F.col("attempt")).alias("delay_s"), (F.col("attempt") > 5).alias("given_up"))


def adaptive(s, d):
    w = _points(s, d).groupBy(F.window("ts", "30 minutes").alias("w")).agg(F.avg((~F.col("ok")).cast("double")).alias("errors_share"), (F.avg("latency") / 20).alias("latency_s"))
    return metrics.adapted_rate(w, 50.0, 1.0, 100.0).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.round("new_rate", 6).alias("new_rate"))


def breaker(s, d):
    return metrics.breaker(_points(s, d), "user_id", "ts", "event_id", 2).select("event_id", F.col("failures").cast("bigint").alias("failures"), "open")


def alerts(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["cpu", "memory", "latency", "queue"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(s, d, "events").select("event_id", metrics.alert(kind, F.col("value")).alias("alert"))


def migration(s, d):
    r = table(s, d, "classification_results")
    return r.groupBy(F.coalesce("document_type", F.lit("")).alias("document_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 6).alias("avg_confidence"), F.count_if(F.col("confidence") < 0.7).alias("n_low"))


def tumbling(s, d):
    return streams.run_to_table(streams.windowed(streams.read_events(s, d)), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(s, d):
    return streams.run_to_table(streams.sessions(streams.read_events(s, d)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def bucket(s, d):
    return streams.run_to_table(streams.token_bucket(streams.read_events(s, d).select("user_id", "ts"), "user_id", 1, 2), "append")


def queue_drain(s, d):
    """Items fed through a stream batch by batch, then counted by type."""
    base = work_dir(s)
    streams.drain(streams.read_events(s, d), lambda batch, n: batch.select("event_id", "event_type").write.mode("overwrite").parquet(f"{base}/batch-{n}"))
    return s.read.parquet(f"{base}/batch-*").groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))


def case_sizes(s, d):
    """Documents and parties by case: the largest cases first."""
    docs = table(s, d, "documents").where("case_number is not null").groupBy("case_number").agg(F.count("*").alias("n_docs"), F.sum("size").alias("n_bytes"))
    parties = table(s, d, "parties").where("case_number is not null").groupBy("case_number").agg(F.count_distinct("name").alias("n_names"))
    return docs.join(parties, "case_number", "left")


QUERIES = {
    "batch_progress": (
        progress,
        f"SELECT queue, count(*) AS total, count(*) FILTER (outcome = 'ok') AS success, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'skipped') AS skipped, 100.0::DOUBLE AS percent, CASE WHEN count(*) FILTER (outcome = 'error') > 0 AND count(*) FILTER (outcome = 'ok') = 0 THEN 'failed' ELSE 'completed' END AS status FROM {_ITEMS} GROUP BY queue",
    ),
    "queue_order": (
        lambda s, d: jobs.queue_order(_items(s, d), "queue", "priority", "created", "result_id").select("queue", "result_id", "place"),
        f"SELECT queue, result_id, CAST(row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created ASC NULLS FIRST, result_id) AS INT) AS place FROM {_ITEMS}",
    ),
    "queue_stats": (
        lambda s, d: jobs.queue_stats(_items(s, d), "queue"),
        f"SELECT queue, count(*) AS n_items, count(*) FILTER (outcome = 'ok') AS completed, count(*) FILTER (outcome = 'error') AS failed, round(avg(wait), 6) AS avg_wait FROM {_ITEMS} GROUP BY ROLLUP (queue)",
    ),
    "retry_backoff": (retry, "SELECT event_id, attempt, CAST(least(5 * pow(2, attempt - 1), 300) AS BIGINT) AS delay_s, attempt > 5 AS given_up FROM (SELECT event_id, event_id % 8 + 1 AS attempt FROM events WHERE event_type = 'error')"),
    "metrics_report": (
        lambda s, d: metrics.report(_points(s, d)),
        "SELECT count(*) AS n, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate, round(avg(value), 6) AS avg_latency, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 8) AS per_second FROM events",
    ),
    "metric_history": (
        lambda s, d: metrics.history(_points(s, d), "name", "ts", "event_id").select("name", "event_id", "value"),
        "SELECT event_type AS name, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100",
    ),
    "metric_counters": (
        lambda s, d: metrics.counters(_points(s, d), "name", "ts", "value", "event_id"),
        "SELECT event_type AS name, round(sum(value), 4) AS counter, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY 1",
    ),
    "moving_average": (
        lambda s, d: metrics.moving_average(_points(s, d), "name", "ts", "value", "event_id"),
        "SELECT event_type AS name, round(sum(value * CASE WHEN r = n THEN pow(2.0, 1 - r) ELSE pow(2.0, -r) END), 6) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r < 900 GROUP BY 1",
    ),
    "alerts": (
        alerts,
        "SELECT event_id, CASE WHEN k = 0 AND value > 90 THEN 'critical' WHEN k = 0 AND value > 80 THEN 'warning' WHEN k = 1 AND value > 95 THEN 'critical' WHEN k = 1 AND value > 85 THEN 'warning' WHEN k = 2 AND value > 1000 THEN 'warning' WHEN k = 3 AND value > 1000 THEN 'warning' ELSE 'ok' END AS alert FROM (SELECT *, event_id % 4 AS k FROM events)",
    ),
    "adaptive_rate": (
        adaptive,
        "SELECT start, round(CASE WHEN abs(n - 50) / 50 > 0.1 THEN n ELSE 50 END, 6) AS new_rate FROM (SELECT start, greatest(least(50.0::DOUBLE * CASE WHEN e > 0.1 THEN 0.8::DOUBLE WHEN l > 5 THEN 0.9::DOUBLE WHEN e < 0.05 AND l < 2.5 THEN 1.1::DOUBLE ELSE 1.0 END, 100), 1) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS start, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS e, avg(value) / 20 AS l FROM events GROUP BY 1))",
    ),
    "circuit_breaker": (
        breaker,
        "SELECT event_id, CAST(f AS BIGINT) AS failures, f >= 2 AS open FROM (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events))",
    ),
    "migration_stats": (migration, "SELECT coalesce(document_type, '') AS document_type, count(*) AS n, round(avg(confidence) FILTER (confidence > 0), 6) AS avg_confidence, count(*) FILTER (confidence < 0.7) AS n_low FROM classification_results GROUP BY 1"),
    "case_sizes": (case_sizes, "SELECT case_number, n_docs, CAST(n_bytes AS BIGINT) AS n_bytes, n_names FROM (SELECT case_number, count(*) AS n_docs, sum(size) AS n_bytes FROM documents WHERE case_number IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT case_number, count(DISTINCT name) AS n_names FROM parties WHERE case_number IS NOT NULL GROUP BY 1) USING (case_number)"),
    "stream_tumbling": (tumbling, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_sessions": (
        session_counts,
        "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts > before + INTERVAL 30 MINUTES OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, no",
    ),
    "stream_token_bucket": (bucket, None),
    "stream_queue_drain": (queue_drain, "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1"),
}
