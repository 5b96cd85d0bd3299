"""Streaming forms: event-time windows, sessions, a token bucket with state, and queue sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import work_dir


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than late are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by user and session. In append mode a session comes out when the watermark has passed it, so at the
    end of a stream the last ones are still held; complete mode gives them too."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is now and give what it wrote as a batch table."""
    spark = df.sparkSession
    base = work_dir(spark)
    schema = df.schema
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/ck").option("path", f"{base}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/out")
    last: dict[str, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        last["path"] = f"{base}/out-{number}"
        batch.write.mode("overwrite").parquet(last["path"])

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(last["path"]) if last else spark.createDataFrame([], schema)


def token_bucket(events: DataFrame, key: str, per_minute: int, burst: int) -> DataFrame:
    """(key, ts, allowed): a bucket for each key refills with time and lets an event pass while it has a token."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        ok = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            if at is not None:
                tokens = min(float(burst), tokens + max(0.0, now - at) * per_minute / 60)
            at = now
            ok.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        state.update((tokens, at))
        yield pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy(), "allowed": ok})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def drain(events: DataFrame, process: Callable[[DataFrame, int], None]) -> None:
    """Feed a queue's items batch by batch to a processor until there are none."""
    q = events.writeStream.foreachBatch(process).option("checkpointLocation", f"{work_dir(events.sparkSession)}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
