"""Reading and changing the index: upsert, bulk write, merge, delete, lookup, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def safe_id(col: Column) -> Column:
    return F.translate(col, "/\\", "__")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in order; an index that is built from writes that repeat keys."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order))).alias("__r")).select("__r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: new rows replace old ones of their key, of several new ones the last in order. old is an index: it has each key once."""
    # of the old rows only keys are compared; where the new ones are few Spark broadcasts them and the old ones stay where they are
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(latest(new, key, order))


def delete(index: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def merge(index: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial update: given values replace, missing ones leave what is there."""
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = index.join(u, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in index.columns])


def bulk(rows: DataFrame, key: str, problem: Column) -> DataFrame:
    """indexed and failed rows of a bulk write; rows without a key are skipped."""
    ok = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return rows.agg(F.count_if(ok & problem.isNull()).alias("indexed"), F.count_if(ok & problem.isNotNull()).alias("failed"), F.count_if(~ok).alias("skipped"))


def bulk_failures(rows: DataFrame, key: str, problem: Column) -> DataFrame:
    """(key, error) of the rows that a bulk write does not take; rows without a key are skipped, not failed."""
    return rows.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & problem.isNotNull()).select(key, problem.alias("error"))


def get(index: DataFrame, key: str, value) -> DataFrame:
    return index.where(F.col(key) == F.lit(value)).limit(1)


def health(index: DataFrame) -> dict:
    return {"exists": True, "columns": len(index.columns), "rows": index.count()}


def with_author(docs: DataFrame, attorneys: DataFrame) -> DataFrame:
    """Documents with the name of their first attorney as author."""
    first = attorneys.where("trim(name) <> ''").groupBy("doc_id").agg(F.min_by("name", F.struct("attorney_no", "attorney_row_id")).alias("author"))
    return docs.join(first, "doc_id", "left")


def nested_parties(parties: DataFrame) -> DataFrame:
    """Each document's parties as an array of structs, the last of repeated ones."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "party_no").orderBy(F.desc("ingested_at"), F.desc("party_row_id")))
    last = parties.withColumn("r", rank).where("r = 1")
    return last.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("party_no", "name", "role", "party_type"))).alias("parties"))
