"""Facets: counts by value, distinct values, date buckets, and several of them in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MULTI_VALUED, column_of

#: Facet sizes of the bundle.
BUNDLE = {"court": 100, "judge": 100, "doc_type": 50, "legal_tags": 200, "status": 20, "author": 100}
#: Aggregations that a combined request may name: field and size, or None for date ranges.
AGGREGATIONS = {"document_types": ("document_type", 20), "categories": ("category", 15), "courts": ("court", 25), "judges": ("judge", 30), "date_ranges": None}


def values_of(df: DataFrame, name: str) -> DataFrame:
    """One column key: each document's value, or each of its distinct values."""
    col = column_of(name)
    if col in MULTI_VALUED:
        return df.select(F.explode(F.array_distinct(col)).alias("key")).where("key is not null")
    return df.select(F.col(col).cast("string").alias("key")).where("key is not null")


def terms(df: DataFrame, name: str, size: int = 50, prefix: str = "", exclude: list[str] | None = None) -> DataFrame:
    """(key, doc_count) of the most frequent values, ties by key; at most 1000."""
    vals = values_of(df, name)
    if prefix:
        plain = re.fullmatch(r"[\w \-]+", prefix)
        vals = vals.where(F.col("key").startswith(prefix) if plain else F.col("key").rlike(f"^(?:{prefix}.*)$"))
    if exclude:
        vals = vals.where(~F.col("key").isin(*exclude))
    return vals.groupBy("key").agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), F.asc("key")).limit(min(max(size, 1), 1000))


def _labelled(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("key"))


def bundle(df: DataFrame, sizes: dict[str, int] = BUNDLE) -> DataFrame:
    """(facet, key, doc_count): several facets from one scan and one shuffle."""
    parts = []
    for name in sizes:
        col = column_of(name)
        vals = F.array_distinct(col) if col in MULTI_VALUED else F.array(F.col(col).cast("string"))
        parts.append(F.transform(F.coalesce(vals, F.array().cast("array<string>")), _labelled(name)))
    flat = df.select(F.explode(F.concat(*parts)).alias("f")).select("f.facet", "f.key").where("key is not null")
    counts = flat.groupBy("facet", "key").agg(F.count("*").alias("doc_count"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("doc_count"), F.asc("key")))
    limit = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("facet")]
    return counts.withColumn("r", rank).where(F.col("r") <= limit).select("facet", "key", "doc_count")


def stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Documents, and distinct courts, judges, categories and types (approximate unless exact)."""
    names = {"n_courts": "court", "n_judges": "judge", "n_categories": "category", "n_doc_types": "doc_type"}
    if not exact:
        return df.agg(F.count("*").alias("total_documents"), *[F.approx_count_distinct(c).alias(a) for a, c in names.items()])
    # distinct values of all fields by one grouping instead of a plan that copies each row once a field
    one = df.select(F.explode(F.array(F.struct(F.lit("").alias("f"), F.lit("").alias("v")), *[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in names.values()])).alias("x"))
    values = one.select("x.*").where("v is not null").groupBy("f", "v").agg(F.count("*").alias("n"))
    return values.agg(F.coalesce(F.sum(F.when(F.col("f") == "", F.col("n"))), F.lit(0)).alias("total_documents"), *[F.count_if(F.col("f") == c).alias(a) for a, c in names.items()])


def document_report(df: DataFrame) -> DataFrame:
    """(facet, key, doc_count) of the statistics of an index: total, types (50), tags (100), and distinct courts and judges."""
    counts = bundle(df, {"doc_type": 50, "legal_tags": 100})
    one = stats(df).select(F.explode(F.create_map(F.lit("total"), F.col("total_documents"), F.lit("court"), F.col("n_courts"), F.lit("judge"), F.col("n_judges"))).alias("key", "doc_count"))
    return counts.unionByName(one.select(F.when(F.col("key") == "total", "total").otherwise("distinct").alias("facet"), F.when(F.col("key") != "total", F.col("key")).alias("key"), "doc_count"))


def combined(df: DataFrame, names: list[str] | None, as_of: str) -> DataFrame:
    """(facet, key, doc_count) of several named aggregations; unknown names are left out, no known name gives no row."""
    known = [n for n in dict.fromkeys(names or []) if n in AGGREGATIONS]
    fields = {AGGREGATIONS[n][0]: (n, AGGREGATIONS[n][1]) for n in known if AGGREGATIONS[n]}
    out = df.sparkSession.createDataFrame([], "facet string, key string, doc_count bigint")
    if fields:
        rows = bundle(df, {f: size for f, (_, size) in fields.items()})
        label = F.create_map(*[F.lit(x) for f, (n, _) in fields.items() for x in (f, n)])
        out = out.unionByName(rows.select(label[F.col("facet")].alias("facet"), "key", "doc_count"))
    if "date_ranges" in known:
        out = out.unionByName(date_buckets(df, as_of).select(F.lit("date_ranges").alias("facet"), "key", "doc_count"))
    return out


def parsed_buckets(reply: Column) -> Column:
    """array<struct<key, doc_count>> of the JSON of a facet; buckets without a key or count are left out."""
    rows = F.from_json(reply, "struct<buckets: array<struct<key: string, doc_count: bigint>>>")["buckets"]
    return F.coalesce(F.filter(rows, lambda b: b["key"].isNotNull() & b["doc_count"].isNotNull()), F.array().cast("array<struct<key: string, doc_count: bigint>>"))


def date_buckets(df: DataFrame, as_of: str, name: str = "created_at") -> DataFrame:
    """Documents of the last 7, 30 and 90 days and of the last year: from is inclusive, the day of as_of exclusive."""
    end = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    starts = {"last_7_days": end - F.expr("INTERVAL 7 DAYS"), "last_30_days": end - F.expr("INTERVAL 30 DAYS"), "last_90_days": end - F.expr("INTERVAL 90 DAYS"), "last_year": end - F.expr("INTERVAL 1 YEAR")}
    col = F.col(column_of(name))
    within: list[Column] = [F.count_if((col >= s) & (col < end)).alias(k) for k, s in starts.items()]
    one = df.agg(*within)
    return one.select(F.explode(F.create_map(*[x for k in starts for x in (F.lit(k), F.col(k))])).alias("key", "doc_count"))


def by_periods(df: DataFrame, groups: list[str], grains: list[str], name: str = "created_at") -> DataFrame:
    """(dimension, key, grain, period, doc_count) for several groupings and grains in one pass."""
    for grain in grains:
        if grain not in ("day", "week", "month", "year"):
            raise ValueError(grain)
    keys = F.array(*[F.struct(F.lit(g).alias("dimension"), F.col(column_of(g)).cast("string").alias("key")) for g in groups])
    periods = F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, column_of(name)).alias("period")) for g in grains]).cast("array<struct<grain: string, period: timestamp>>")
    flat = df.select(F.explode(keys).alias("k"), periods.alias("p")).select("k.*", F.explode("p").alias("p")).select("dimension", "key", "p.*")
    return flat.groupBy("dimension", "key", "grain", "period").agg(F.count("*").alias("doc_count"))


def by_period(df: DataFrame, group: str, grain: str, name: str = "created_at") -> DataFrame:
    """Documents by value and day, week, month or year."""
    if grain not in ("day", "week", "month", "year"):
        raise ValueError(grain)
    return df.groupBy(F.col(column_of(group)).alias("key"), F.date_trunc(grain, column_of(name)).alias("period")).agg(F.count("*").alias("doc_count"))
