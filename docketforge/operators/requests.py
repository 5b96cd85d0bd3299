"""Requests beside searches: guards, clamps, messages, queues with a capacity, and results joined with what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents of a batch request, bounds and defaults of options, types that the pipeline takes, messages of failed checks.
BATCH = (1, 1000)
TIMEOUT, RETRIES = (1, 300, 120), (0, 3, 1)
PIPELINE_TYPES = ["application/pdf", "application/docx", "text/plain"]
MAX_SIZE = 100 * 1024 * 1024
MESSAGES = {
    "required": "{field} is required", "min": "{field} must be at least {param} characters", "max": "{field} must be at most {param} characters", "email": "{field} must be a valid email address", "oneof": "{field} must be one of: {param}",
    "file_extension": "{field} must have a valid file extension: {param}", "file_size": "{field} file size exceeds maximum allowed size", "legal_category": "{field} must be a valid legal document category",
    "gtfield": "{field} must be greater than {param}", "ltfield": "{field} must be less than {param}",
}
DANGEROUS_ENDS = [".exe", ".scr", ".bat", ".cmd", ".com", ".pif", ".vbs", ".js", ".jar", ".php", ".asp", ".aspx", ".jsp", ".sh", ".py", ".rb", ".pl"]
SUSPICIOUS = ["<", ">", ":", '"', "|", "?", "*", "\r", "\n", "\t"]


def batch_error(n: Column) -> Column:
    """What is wrong with the number of documents of a batch request, or null."""
    return F.when(F.coalesce(n, F.lit(0)) < BATCH[0], "empty").when(n > BATCH[1], "too_many")


def clamped(value: Column, bounds: tuple[int, int, int]) -> Column:
    """A value within its bounds, else the default; null stays null."""
    low, high, default = bounds
    return F.when(value.isNull(), F.lit(None)).when(value.between(low, high), value).otherwise(default).cast("int")


def message(field: Column, tag: Column, param: Column) -> Column:
    """The text of a failed check."""
    out = F.concat(field, F.lit(" is invalid"))
    for name, template in reversed(MESSAGES.items()):
        parts = [F.lit(p) if i % 2 == 0 else (field if p == "field" else F.coalesce(param, F.lit(""))) for i, p in enumerate(template.replace("}", "{").split("{"))]
        out = F.when(tag == name, F.concat(*parts)).otherwise(out)
    return out


def pipeline_error(size: Column, content_type: Column, name: Column) -> Column:
    """The first check of the pipeline that a request fails, or null."""
    return F.when(size > MAX_SIZE, "too_large").when(~F.coalesce(content_type.isin(*PIPELINE_TYPES), F.lit(False)), "unsupported_type").when(F.coalesce(name, F.lit("")) == "", "no_name")


def unsafe_name(name: Column) -> Column:
    """What makes a file name dangerous, or null."""
    out = F.lit(None).cast("string")
    for end in reversed(DANGEROUS_ENDS):
        out = F.when(F.lower(name).endswith(end), f"extension {end}").otherwise(out)
    for c in reversed(SUSPICIOUS):
        out = F.when(name.contains(c), "character").otherwise(out)
    return F.when(name.contains(".."), "traversal").when(name.contains("\x00"), "null_byte").otherwise(out)


def document_error(doc: dict[str, Column]) -> Column:
    """The first thing that an index document lacks: id, text, file name, type, hash, metadata, times."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    out = F.lit(None).cast("string")
    for name in ("updated_at", "created_at", "metadata"):
        out = F.when(doc[name].isNull(), name).otherwise(out)
    for name in ("hash", "doc_type", "file_name", "text", "id"):
        out = F.when(blank(doc[name]), name).otherwise(out)
    return out


def with_index_status(results: DataFrame, pending: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Results with what a bulk write made of them: only pending documents are indexed, those that failed have their error.

    pending(key), failed(key, error); of repeated failures the greatest error counts.
    """
    p = pending.select(key).distinct().withColumn("__pending", F.lit(True))
    f = failed.groupBy(key).agg(F.max("error").alias("index_error"))
    out = results.join(p, key, "left").join(f, key, "left")
    waits = F.coalesce("__pending", F.lit(False))
    indexed = waits & F.col("index_error").isNull()
    return out.select(*results.columns, indexed.alias("indexed"), F.when(indexed, F.col(key)).alias("index_id"), F.when(waits, F.col("index_error")).alias("index_error"))


def admitted(items: DataFrame, queue: str, created: str, key: str, capacities: dict[str, int], default: int = 1000) -> DataFrame:
    """items with accepted: in the order of arrival a queue takes so many items as it has room for; later ones are rejected.

    Only the last item that still fits is looked for in each queue (one aggregation of bounded size), no queue is sorted by one task.
    """
    room = F.create_map(*[F.lit(x) for kv in (capacities or {"": default}).items() for x in kv])
    items = items.withColumn("__room", F.coalesce(room[F.col(queue)], F.lit(default)))
    at = F.struct(F.col(created).alias("created"), F.col(key).alias("key"))
    # each salt keeps its first items, and the queue the first of these
    salted = items.select(queue, "__room", at.alias("at"), F.pmod(F.xxhash64(key), F.lit(64)).alias("salt"))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy(queue, "salt").orderBy("at"))).where("r <= __room")
    last = first.withColumn("r", F.row_number().over(Window.partitionBy(queue).orderBy("at"))).where("r <= __room").groupBy(queue).agg(F.max("at").alias("last"))
    return items.join(last, queue, "left").withColumn("accepted", at <= F.col("last")).drop("__room", "last")


def changed(items: DataFrame, key: str, removed: DataFrame, priorities: DataFrame) -> DataFrame:
    """items without the removed keys, and with the new priority of those that priorities(key, priority) names."""
    new = priorities.groupBy(key).agg(F.max("priority").alias("__new"))
    out = items.join(removed.select(key).distinct(), key, "left_anti").join(new, key, "left")
    return out.withColumn("priority", F.coalesce("__new", "priority")).drop("__new")


def workers(items: DataFrame, worker: str, ms: str, ok: str) -> DataFrame:
    """By worker: items, share that succeeded, time busy, and its share of all time."""
    per = items.groupBy(worker).agg(F.count("*").alias("n_items"), F.round(F.avg(F.col(ok).cast("double")), 6).alias("success_share"), F.sum(ms).alias("busy_ms"))
    return per.withColumn("busy_share", F.round(F.col("busy_ms") / F.nullif(per.agg(F.sum("busy_ms")).scalar(), F.lit(0)), 6))


def merged_ranges(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, ranges): the date ranges of one source followed by those of another; a missing source adds none."""
    a, b = first.select(key, F.col("ranges").alias("__a")), second.select(key, F.col("ranges").alias("__b"))
    kind = first.schema["ranges"].dataType.simpleString()
    none = F.array().cast(kind)
    return a.join(b, key, "full_outer").select(key, F.concat(F.coalesce("__a", none), F.coalesce("__b", none)).alias("ranges"))
