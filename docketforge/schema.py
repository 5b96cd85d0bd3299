"""The document index: its columns, the names requests use for them, and its view over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

#: Names of both generations of requests -> column of the index.
ALIASES = {
    "metadata.court": "court", "metadata.court.court_name": "court", "court.keyword": "court", "metadata.judge": "judge", "metadata.judge.name": "judge", "judge.keyword": "judge",
    "metadata.status": "status", "metadata.author": "author", "metadata.case_number": "case_number", "metadata.case_name": "case_name", "metadata.case_name.keyword": "case_name",
    "metadata.legal_tags": "legal_tags", "metadata.document_type": "document_type", "document_type.keyword": "document_type", "category.keyword": "category", "doc_type.keyword": "doc_type",
    "metadata.subject": "subject", "metadata.summary": "summary", "content": "text", "extracted_text": "text", "title": "subject", "file_name.keyword": "file_name", "id": "doc_id",
}
#: Stored but not searchable.
NOT_INDEXED = frozenset({"file_url", "s3_uri", "attorneys.contact_info"})
MULTI_VALUED = frozenset({"legal_tags", "keywords"})


def column_of(field: str) -> str:
    """The index column that a request's field name means."""
    if field in NOT_INDEXED:
        raise ValueError(f"{field} is stored but not indexed")
    name = ALIASES.get(field, field)
    return name[: -len(".keyword")] if name.endswith(".keyword") else name


#: Columns of the index that come from the latest successful classification of a document.
META = (
    "document_type", "legal_category", "subject", "summary", "confidence", "legal_tags", "keywords", "status", "processed_at", "case_name", "court",
)
#: The judge that a text names: a title and a family name.
JUDGE = r"(?:Judge|JUDGE|Justice|JUSTICE|Hon\.|HON\.) ([A-Z][A-Za-z]+)"


def document_index(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a document with the metadata of its latest successful classification, its first attorney as author and the judge its text names.

    With columns only these (and doc_id): what none of them needs is neither read nor joined.
    """
    wanted = list(dict.fromkeys(["doc_id", *columns])) if columns else None
    out = table(spark, sf_dir, "documents")
    if wanted is None or "judge" in wanted:
        out = out.withColumn("judge", F.nullif(F.regexp_extract("text", JUDGE, 1), F.lit("")))
    meta = [c for c in META if wanted is None or c in wanted]
    if meta:
        results = table(spark, sf_dir, "classification_results").where("success")
        results = results.withColumn("case_name", F.col("case_info.case_name")).withColumn("court", F.col("court_info.court_name"))
        # nulls are less than any time, so the latest has one if any does
        last = results.groupBy("doc_id").agg(F.max_by(F.struct(*meta), F.struct(F.col("processed_at").alias("at"), "result_id")).alias("m"))
        out = out.join(last.select("doc_id", "m.*"), "doc_id", "left")
    if wanted is None or "author" in wanted:
        named = table(spark, sf_dir, "attorneys").where("trim(name) <> ''")
        out = out.join(named.groupBy("doc_id").agg(F.min_by("name", F.struct("attorney_no", "attorney_row_id")).alias("author")), "doc_id", "left")
    return out.select(*wanted) if wanted else out


#: The same view as SQL, for checking.
INDEX_SQL = f"""
document_index AS (
  SELECT d.*, nullif(regexp_extract(d.text, '{JUDGE}', 1), '') AS judge, m.document_type, m.legal_category, m.subject, m.summary, m.confidence, m.legal_tags, m.keywords, m.status, m.processed_at,
         m.case_info.case_name AS case_name, m.court_info.court_name AS court, a.author
  FROM documents d LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC NULLS LAST, result_id DESC) AS rk
                   FROM classification_results WHERE success) WHERE rk = 1) m USING (doc_id)
  LEFT JOIN (SELECT doc_id, arg_min(name, (attorney_no, attorney_row_id)) AS author FROM attorneys WHERE trim(name, ' ') <> '' GROUP BY doc_id) a USING (doc_id))
"""
