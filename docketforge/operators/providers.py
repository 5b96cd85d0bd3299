"""Extension points: classifiers by name, the cascade over them, and stages of the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text

RESULT = "document_type string, legal_category string, confidence double, summary string"
Provider = Callable[[Column], Column]


def rules(body: Column) -> Column:
    """The deterministic provider."""
    words = text.word_count(body)
    kind = classify.document_type(body, words, F.lit(1))
    return F.struct(kind.alias("document_type"), classify.legal_category(body).alias("legal_category"), classify.confidence(body, words, F.lit(1)).alias("confidence"), F.lit(None).cast("string").alias("summary"))


PROVIDERS: dict[str, Provider] = {"rules": rules}


def register(name: str, provider: Provider) -> None:
    """provider(text column) -> struct column of RESULT, null where it fails."""
    PROVIDERS[name] = provider


def cascade(body: Column, names: list[str]) -> Column:
    """The first provider that answers; the last one's answers are marked and trusted less. Empty texts have a fixed answer."""
    empty = F.struct(F.lit("other").alias("document_type"), F.lit("Civil Law").alias("legal_category"), F.lit(0.1).alias("confidence"), F.lit(None).cast("string").alias("summary"))
    tries = [PROVIDERS[n](body) for n in names]
    if len(tries) > 1:
        last = tries[-1]
        tries[-1] = F.when(last.isNotNull(), F.struct(last["document_type"].alias("document_type"), last["legal_category"].alias("legal_category"), (last["confidence"] * 0.9).alias("confidence"), F.concat(F.lit("[EXPENSIVE FALLBACK] "), F.coalesce(last["summary"], F.lit(""))).alias("summary")))
    return F.when(F.coalesce(F.trim(body), F.lit("")) == "", empty).otherwise(F.coalesce(*tries))


def pipeline(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Run stages in order; a column steps keeps the names of those that ran."""
    start = df.withColumn("steps", F.array().cast("array<string>"))
    return reduce(lambda d, s: s[1](d).withColumn("steps", F.array_append("steps", F.lit(s[0]))), stages, start)


def merge_attempts(results: DataFrame) -> DataFrame:
    """One answer a document: the first success, and how many tries there were."""
    return results.groupBy("doc_id").agg(
        F.min_by("provider", F.when(F.col("success"), F.struct("processed_at", "result_id"))).alias("provider"), F.count("*").alias("tries"), F.count_if("success").alias("successes"),
    )
