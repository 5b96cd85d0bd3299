"""From classification results and old metadata to index documents, and catalogues of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify

#: Fields that can be searched, and tags in common use.
FIELDS = [
    ("case_name", "Case Name", "string"), ("case_number", "Case Number", "string"), ("author", "Author", "string"), ("judge", "Judge", "string"), ("court", "Court", "string"), ("legal_tags", "Legal Tags", "array"),
    ("doc_type", "Document Type", "string"), ("category", "Category", "string"), ("status", "Status", "string"), ("created_at", "Created Date", "date"),
]
TAGS = [
    ("motion to dismiss", "motion"), ("motion to suppress", "motion"), ("discovery", "procedural"), ("sentencing", "criminal"), ("plea bargain", "criminal"), ("summary judgment", "civil"), ("evidence exclusion", "evidence"),
    ("constitutional challenge", "substantive"), ("procedural motion", "procedural"), ("appeal", "procedural"),
]
#: Words of old names by type.
LEGACY_RULES = [
    ("motion_to_suppress", [["motion", "suppress"]]), ("motion_to_dismiss", [["motion", "dismiss"]]), ("motion_to_compel", [["motion", "compel"]]), ("motion_in_limine", [["motion", "limine"]]), ("motion_to_suppress", [["motion"]]),
    ("order", [["order"]]), ("ruling", [["ruling"]]), ("judgment", [["judgment"]]), ("brief", [["brief"]]), ("complaint", [["complaint"]]), ("answer", [["answer"]]), ("notice", [["notice"]]),
]
#: Sentences of the summaries, here and in summary().
SUMMARIES = {
    "motion_to_suppress": "Motion requesting exclusion of evidence from trial proceedings.", "motion_to_dismiss": "Motion seeking dismissal of charges or claims for legal insufficiency.",
    "motion_to_compel": "Motion requesting court order to compel compliance with discovery requests.", "motion_in_limine": "Pre-trial motion seeking to exclude prejudicial evidence or testimony.",
    "order": "Court order directing parties to take or refrain from specific actions.", "ruling": "Judicial decision on a matter before the court.", "brief": "Legal brief presenting arguments and case law analysis.",
    "complaint": "Initial pleading setting forth plaintiff's claims and requested relief.", "answer": "Defendant's response to allegations in complaint or petition.",
}
NO_SUMMARY = "Legal document containing case-related information and proceedings."


def catalogue(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def iso_date(col: Column) -> Column:
    """YYYY-MM-DD or null."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def from_result(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Index documents of classification results: defaults for missing texts, types and subjects; dates parsed; tags never null."""
    d, r = docs.alias("d"), results.alias("r")
    j = d.join(r, F.col("d.doc_id") == F.col("r.doc_id"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return j.select(
        F.col("d.doc_id").alias("doc_id"), "r.result_id",
        F.coalesce(blank("d.text"), F.lit("No text extracted")).alias("text"), F.coalesce(blank("r.document_type"), F.lit("Other")).alias("doc_type"), F.coalesce(blank("r.legal_category"), F.lit("Civil")).alias("category"),
        classify.known_type(F.coalesce("r.document_type", F.lit(""))).alias("document_type"), F.coalesce(blank("r.subject"), blank("r.summary")).alias("subject"), F.col("r.confidence").alias("confidence"),
        (F.col("r.confidence") > 0.5).alias("ai_classified"), iso_date(F.col("r.filing_date")).alias("filing_date"), iso_date(F.col("r.hearing_date")).alias("hearing_date"),
        F.coalesce("r.legal_tags", F.array().cast("array<string>")).alias("legal_tags"), F.col("r.case_info.case_name").alias("case_name"), F.col("r.court_info.court_name").alias("court"),
    )


def legacy_type(name: Column, subject: Column) -> Column:
    return classify._cascade(F.lower(F.concat_ws(" ", name, subject)), LEGACY_RULES, F.lit("other"))


def migrated(docs: DataFrame, results: DataFrame, least: float = 0.7) -> DataFrame:
    """Old documents in the new schema: the old name tells the type unless a result of enough confidence does."""
    best = results.groupBy("doc_id").agg(F.max_by(F.struct("document_type", "legal_category", "confidence"), F.struct("confidence", "result_id")).alias("b"))
    j = docs.join(best, "doc_id", "left")
    sure = F.coalesce(F.col("b.confidence") >= least, F.lit(False))
    return j.select("doc_id", F.when(sure, F.col("b.document_type")).otherwise(legacy_type(F.col("file_name"), F.col("doc_type"))).alias("document_type"), F.when(sure, F.col("b.legal_category")).otherwise(F.col("category")).alias("category"), sure.alias("ai_classified"), F.to_date("created_at").alias("filing_date"))


def summary(doc_type: Column, words: Column, pages: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in SUMMARIES.items() for x in kv])[doc_type], F.lit(NO_SUMMARY))
    more = (
        F.when(words < 300, " This brief document contains essential case information.").when(words > 3000, " This comprehensive document provides detailed legal analysis and extensive case documentation.")
        .when(pages > 5, F.format_string(" This multi-page document (%d pages) contains substantial legal content and procedural details.", pages))
        .otherwise(F.format_string(" Document contains %d words across %d pages with relevant case details.", words, pages))
    )
    return F.concat(base, more)


def entities(text: Column, file_name: Column, words: Column) -> Column:
    """array<struct<text, type, confidence>> that the rules give."""
    e = lambda on, t, kind, c: F.when(on, F.struct(t.alias("text"), F.lit(kind).alias("type"), F.lit(c).alias("confidence")))
    low = F.lower(text)
    return F.array_compact(F.array(
        e(low.contains("john"), F.lit("John Smith"), "PERSON", 0.9), e(low.contains("court"), F.lit("Superior Court"), "ORGANIZATION", 0.8), e(text.contains("$"), F.lit("$10,000"), "MONEY", 0.7),
        e(F.coalesce(file_name, F.lit("")) != "", file_name, "DOCUMENT", 1.0), e(words > 0, F.format_string("%d words", words), "DOCUMENT_METRIC", 1.0),
    ))


def text_limit(words: Column, pages: Column) -> Column:
    """How much text a provider is shown."""
    return F.when(words < 500, 8000).when(words < 2000, 10000).when(words > 10000, 12000).when(pages > 20, 11000).otherwise(8000)


def simulated_ms(words: Column) -> Column:
    return F.when(words < 500, 10).when(words < 2000, 30).when(words < 5000, 60).otherwise(110)


def _latin(text: Column) -> Column:
    """One character for each byte of the UTF-8 of a text."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _plain(raw: Column) -> Column:
    return F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")


_WHOLE = r"(?![\x80-\xBF])"


def prompt(text: Column, file_name: Column, words: Column, limit: Column) -> Column:
    """A classification prompt: what is known of the document, then its text up to the limit in bytes, no character divided."""
    head = F.call_function("regexp_extract", _latin(text), F.concat(F.lit("(?s)^(.{0,"), limit.cast("string"), F.lit("})" + _WHOLE)), F.lit(1))
    shown = F.when(F.octet_length(text) > limit, F.concat(_plain(head), F.lit("..."))).otherwise(text)
    size = F.when(words < 500, "short").when(words < 2000, "medium").otherwise("long")
    return F.concat_ws("\n", F.concat(F.lit("File: "), F.coalesce(file_name, F.lit("unknown"))), F.format_string("Words: %d (%s)", words, size), F.lit("Text:"), shown)


def window_bytes(text: Column) -> Column:
    """The bytes of a text that batch classification sees: the second half thousand and the one after it, or a short text whole."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) > 500, F.substring(raw, 501, 1000)).otherwise(raw)


def window(text: Column) -> Column:
    """The same as text: characters divided by either edge are left out."""
    part = F.regexp_extract(_latin(text), r"(?s)^.{500}[\x80-\xBF]{0,3}(.{0,1000})" + _WHOLE, 1)
    return F.when(F.octet_length(text) > 500, _plain(part)).otherwise(text)


def hits(scored: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Search hits: id, score and the document as a struct."""
    return scored.join(index, key).select(F.col(key).alias("id"), "score", F.struct(*[F.col(c) for c in index.columns]).alias("document"))
