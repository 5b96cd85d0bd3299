"""Queries of PDF lines, checks, projections, providers and run statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, classify, pdf_lines, text
from ..operators import jobs, projection, providers
from ..session import table
from .text_plans import CATEGORY_SQL, TEXTS_SQL, TYPE_SQL, WORDS_SQL, _cascade_sql, _quoted, literal, texts

LINES = [
    "endobj", "stream of consciousness", "12, 34.5 - 6", "..", "..........", "-.-.-.-.-.-.-.-", "Name: ..............", "Total: ............... 5", "Page 3 of 9", "3 of 9", "- 4 -", "Filed 1/2/2024", "AB-1234567", "short draft",
    "Chapter One ........ 42", "An ordinary sentence that is long enough to stay where it is and be read.", "", "x", "é", "Introduction.......", "Court",
]
NAMES = ["a.pdf", "a..b.pdf", "x/y.txt", "q?.doc", "", "n" * 300 + ".pdf", "ok.docx", "bad.exe"]


def _lines(s, d):
    doc = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("text")).select(text.trimmed(F.col("text")).alias("text")).distinct()
    return doc.unionByName(literal(s, LINES).select("text")).distinct()


_LINES = f"(SELECT DISTINCT text FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), {_quoted(text.ENDS)}, '', 'g') AS text FROM documents UNION ALL SELECT text FROM (VALUES {', '.join(f'({_quoted(v)})' for v in LINES)}) v(text)))"
_has = lambda words: "(" + " OR ".join(f"contains(lower(text), {_quoted(w)})" for w in words) + ")"
_FORMAT = "(" + " OR ".join(f"lower(text) = {_quoted(w)} OR starts_with(lower(text), {_quoted(w + ' ')})" for w in pdf_lines.FORMAT_WORDS) + ")"
_NUM = "regexp_matches(text, '^[\\p{Nd}., -]+$')"
_DENSE = "regexp_replace(text, '[ \\t]', '', 'g')"
_REPEAT = f"(strlen(text) >= 5 AND (coalesce(length(regexp_replace({_DENSE}, '[^.\\-_=*+~]', '', 'g')) / nullif(length({_DENSE}), 0) > 0.7, false) OR " + " OR ".join(f"(length(text) - length(replace(text, {_quoted(c)}, '')) >= 5 AND strlen(text) > 10 AND (length(text) - length(replace(text, {_quoted(c)}, ''))) / strlen({_DENSE}) > 0.5)" for c in ".-_=*+~") + "))"
_DOTS, _LET = "length(regexp_replace(text, '[^.]', '', 'g'))", "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
_FORM = f"(strlen(text) >= 10 AND {_DOTS} >= 5 AND {_LET} > 0 AND {_LET} < 20 AND (({_has(pdf_lines.FORM_WORDS)} AND {_DOTS} > {_LET}) OR (contains(text, ':') AND {_DOTS} > 10)))"
_EDGE = "(length(text) > 0 AND (" + " OR ".join(f"regexp_matches(text, {_quoted(p)})" for p in pdf_lines.EDGE_PATTERNS) + f" OR (regexp_matches(text, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}') AND strlen(text) < 30) OR regexp_matches(replace(text, ' ', ''), '^[A-Z0-9-]{{8,}}$') OR (strlen(text) < 50 AND {_has(pdf_lines.EDGE_WORDS)})))"


def pdf_line_kinds(s, d):
    t = F.col("text")
    return _lines(s, d).select("text", pdf_lines.is_format(t).alias("is_format"), pdf_lines.is_numeric(t).alias("is_numeric"), pdf_lines.is_repeated(t).alias("is_repeated"), pdf_lines.is_form_field(t).alias("is_form"), pdf_lines.is_edge(t).alias("is_edge"))


def pdf_clean(s, d):
    return texts(s, d).select("id", pdf_lines.normalised(pdf_lines.without_artifacts(F.col("text"))).alias("out"))


def index_errors(s, d):
    j = projection.from_result(table(s, d, "documents"), table(s, d, "classification_results")).select("result_id", "doc_id", "document_type")
    docs = table(s, d, "documents").select("doc_id", "text", "file_name", "hash", "created_at", "updated_at")
    r = table(s, d, "classification_results").select("result_id", F.col("document_type").alias("dt"), "legal_category")
    x = j.join(docs, "doc_id").join(r, "result_id")
    c = F.col
    return x.select("result_id", checks.index_error(c("doc_id"), c("text"), c("dt"), c("legal_category"), c("file_name"), c("hash"), c("created_at"), c("updated_at")).alias("error"))


def upload_errors(s, d):
    o = table(s, d, "storage_objects").select("path", "size").distinct()
    name = F.substring_index("path", "/", -1)
    return o.select("path", "size", checks.upload_error(name, F.col("size")).alias("error"), checks.name_error(name).alias("name_error"), checks.size_error(F.col("size"), 20000).alias("size_error"))


def name_errors(s, d):
    return literal(s, NAMES).select("text", checks.name_error(F.col("text")).alias("error"))


def result_errors(s, d):
    r = table(s, d, "classification_results")
    return r.select("result_id", checks.result_error(F.col("confidence"), F.col("document_type"), F.col("legal_category")).alias("error"), F.coalesce(checks.known_category(F.col("legal_category")), F.lit(False)).alias("known_category"))


def projected(s, d):
    p = projection.from_result(table(s, d, "documents"), table(s, d, "classification_results"))
    return p.select("doc_id", "result_id", F.octet_length("text").alias("n_bytes"), "doc_type", "category", "document_type", "subject", "ai_classified", "filing_date", "hearing_date", F.size("legal_tags").alias("n_tags"), "case_name", "court")


def migrated(s, d):
    r = table(s, d, "classification_results").where("success and confidence is not null")
    return projection.migrated(table(s, d, "documents"), r)


def summaries(s, d):
    w = text.word_count(F.col("text"))
    kind = classify.document_type(F.col("text"), w, F.lit(2))
    two = texts(s, d).select("id", w.alias("w"), kind.alias("k"))
    return two.select("id", projection.summary(F.col("k"), F.col("w"), F.lit(2)).alias("summary"), projection.text_limit(F.col("w"), F.lit(2)).alias("text_limit"), projection.simulated_ms(F.col("w")).alias("ms"))


def rule_entities(s, d):
    docs = table(s, d, "documents").where("text is not null")
    e = projection.entities(F.col("text"), F.col("file_name"), text.word_count(F.col("text")))
    return docs.select("doc_id", F.array_join(F.transform(e, lambda x: F.concat_ws("|", x["type"], x["text"], x["confidence"].cast("string"))), ";").alias("entities"))


def cascaded(s, d):
    """Two providers: the first answers long texts only, the rules answer the rest."""
    providers.register("long_only", lambda b: F.when(F.octet_length(b) > 2000, providers.rules(b)))
    t = texts(s, d).select("id", providers.cascade(F.col("text"), ["long_only", "rules"]).alias("r"))
    return t.select("id", "r.document_type", "r.legal_category", (F.coalesce("r.summary", F.lit("")) != "").alias("fell_back"))


def attempts(s, d):
    return providers.merge_attempts(table(s, d, "classification_results"))


def windows_and_prompts(s, d):
    t = table(s, d, "documents").where("text is not null")
    w = text.word_count(F.col("text"))
    head = projection.prompt(F.col("text"), F.col("file_name"), w, projection.text_limit(w, F.lit(2)))
    return t.select("doc_id", F.md5(projection.window_bytes(F.col("text"))).alias("window"), F.octet_length(projection.window_bytes(F.col("text"))).alias("window_bytes"), F.substring_index(head, "\n", 2).alias("head"))


def run_stats(s, d):
    r = table(s, d, "classification_results")
    return r.groupBy("provider").agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.round(100 * F.count_if("success") / F.count("*"), 4).alias("success_rate"), F.sum("processing_time_ms").alias("total_ms"), F.round(F.sum("processing_time_ms") / F.nullif(F.count_if("success"), F.lit(0)), 4).alias("ms_per_success"))


def upload_stats(s, d):
    o = table(s, d, "storage_objects")
    return o.groupBy(F.coalesce("content_type", F.lit("")).alias("content_type")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.count_if(F.col("size") > 0).alias("n_ok"))


def multi_file(s, d):
    e = table(s, d, "extraction_results").groupBy("doc_id").agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("bad"))
    return e.select("doc_id", jobs.multi_status(F.col("ok"), F.col("bad")).alias("status"))


def best_extraction(s, d):
    """For each document its best extraction: a successful one with text first, then the longest, then the latest."""
    e = table(s, d, "extraction_results")
    ok = F.col("success") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return e.groupBy("doc_id").agg(F.max_by("extraction_id", F.struct(ok.alias("a"), F.coalesce("char_count", F.lit(0)).alias("b"), F.col("extraction_id").alias("c"))).alias("extraction_id"))


def fields(s, d):
    return projection.catalogue(s, projection.FIELDS, "id string, name string, type string")


def tag_catalogue(s, d):
    """Tags in common use and how many documents bear them."""
    tags = projection.catalogue(s, projection.TAGS, "name string, tag_group string")
    used = table(s, d, "classification_results").select("doc_id", F.explode(F.array_distinct("legal_tags")).alias("t")).groupBy(F.lower("t").alias("name")).agg(F.count_distinct("doc_id").alias("n"))
    return tags.join(used, "name", "left").select("name", "tag_group", F.coalesce("n", F.lit(0)).alias("n"))


def by_priority(s, d):
    r = table(s, d, "classification_results")
    return r.groupBy((F.col("result_id") % 4).alias("priority")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("provider")), 1, 10), ",").alias("providers"))


def prometheus(s, d):
    e = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


_SUM = f"CASE k {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in projection.SUMMARIES.items())} ELSE {_quoted(projection.NO_SUMMARY)} END"
_N = "string_split(path, '/')[-1]"
_NAME_ERR = f"CASE WHEN coalesce({{n}}, '') = '' THEN 'empty' {' '.join('WHEN contains({n}, ' + _quoted(p) + ') THEN ' + _quoted('has ' + p) for p in checks.NAME_PIECES)} WHEN strlen({{n}}) > 255 THEN 'too_long' END"
_ISO = "CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} AS DATE) END"

QUERIES = {
    "pdf_line_kinds": (pdf_line_kinds, f"SELECT text, {_FORMAT} AS is_format, {_NUM} AS is_numeric, {_REPEAT} AS is_repeated, {_FORM} AS is_form, {_EDGE} AS is_edge FROM {_LINES}"),
    "pdf_clean": (pdf_clean, None),
    "index_request_errors": (
        index_errors,
        "SELECT r.result_id, CASE WHEN coalesce(d.text, '') = '' THEN 'text' WHEN coalesce(r.document_type, '') = '' THEN 'document_type' WHEN coalesce(r.legal_category, '') = '' THEN 'legal_category' WHEN coalesce(d.file_name, '') = '' THEN 'file_name' WHEN coalesce(d.hash, '') = '' THEN 'hash' WHEN d.created_at IS NULL THEN 'created_at' WHEN d.updated_at IS NULL THEN 'updated_at' END AS error FROM classification_results r JOIN documents d USING (doc_id)",
    ),
    "upload_errors": (
        upload_errors,
        f"SELECT DISTINCT path, size, CASE WHEN size < 1 THEN 'too_small' WHEN size > {checks.MAX_UPLOAD} THEN 'too_large' WHEN lower(regexp_extract({_N}, '\\.([^.]*)$', 1)) NOT IN ({', '.join(map(_quoted, checks.UPLOADS))}) THEN 'extension' WHEN contains({_N}, '..') THEN 'name' END AS error, {_NAME_ERR.format(n=_N)} AS name_error, CASE WHEN size <= 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' END AS size_error FROM storage_objects",
    ),
    "file_name_errors": (name_errors, f"SELECT text, {_NAME_ERR.format(n='text')} AS error FROM (VALUES {', '.join(f'({_quoted(v)})' for v in NAMES)}) v(text)"),
    "result_errors": (result_errors, f"SELECT result_id, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence' WHEN coalesce(document_type, '') = '' THEN 'document_type' WHEN coalesce(legal_category, '') = '' THEN 'legal_category' END AS error, coalesce(lower(legal_category) IN ({', '.join(map(_quoted, checks.CATEGORIES))}), false) AS known_category FROM classification_results"),
    "result_projection": (
        projected,
        f"SELECT d.doc_id, r.result_id, CAST(strlen(coalesce(nullif(d.text, ''), 'No text extracted')) AS INT) AS n_bytes, coalesce(nullif(r.document_type, ''), 'Other') AS doc_type, coalesce(nullif(r.legal_category, ''), 'Civil') AS category, CASE WHEN r.document_type IN ({', '.join(map(_quoted, classify.MOTIONS + classify.ORDERS + classify.PLEADINGS + classify.OTHERS))}) THEN r.document_type ELSE 'unknown' END AS document_type, coalesce(nullif(r.subject, ''), nullif(r.summary, '')) AS subject, r.confidence > 0.5 AS ai_classified, {_ISO.format(c='r.filing_date')} AS filing_date, {_ISO.format(c='r.hearing_date')} AS hearing_date, CAST(coalesce(len(r.legal_tags), 0) AS INT) AS n_tags, r.case_info.case_name AS case_name, r.court_info.court_name AS court FROM documents d JOIN classification_results r USING (doc_id)",
    ),
    "migrated_documents": (
        migrated,
        f"SELECT d.doc_id, CASE WHEN s THEN b.document_type ELSE {_cascade_sql(projection.LEGACY_RULES, chr(39) + 'other' + chr(39), low='lower(concat_ws(' + chr(39) + ' ' + chr(39) + ', d.file_name, d.doc_type))')} END AS document_type, CASE WHEN s THEN b.legal_category ELSE d.category END AS category, s AS ai_classified, CAST(d.created_at AS DATE) AS filing_date FROM (SELECT d.*, b, coalesce(b.confidence >= 0.7, false) AS s FROM documents d LEFT JOIN (SELECT doc_id, arg_max({{'document_type': document_type, 'legal_category': legal_category, 'confidence': confidence}}, (confidence, result_id)) AS b FROM classification_results WHERE success AND confidence IS NOT NULL GROUP BY doc_id) USING (doc_id)) d",
    ),
    "summary_templates": (
        summaries,
        f"SELECT id, {_SUM} || CASE WHEN w < 300 THEN ' This brief document contains essential case information.' WHEN w > 3000 THEN ' This comprehensive document provides detailed legal analysis and extensive case documentation.' ELSE ' Document contains ' || w || ' words across 2 pages with relevant case details.' END AS summary, CASE WHEN w < 500 THEN 8000 WHEN w < 2000 THEN 10000 WHEN w > 10000 THEN 12000 ELSE 8000 END AS text_limit, CASE WHEN w < 500 THEN 10 WHEN w < 2000 THEN 30 WHEN w < 5000 THEN 60 ELSE 110 END AS ms FROM (SELECT id, {WORDS_SQL} AS w, {TYPE_SQL} AS k FROM {TEXTS_SQL})",
    ),
    "rule_entities": (
        rule_entities,
        f"SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'john') THEN 'PERSON|John Smith|0.9' END, CASE WHEN contains(lower(text), 'court') THEN 'ORGANIZATION|Superior Court|0.8' END, CASE WHEN contains(text, '$') THEN 'MONEY|$10,000|0.7' END, CASE WHEN coalesce(file_name, '') <> '' THEN 'DOCUMENT|' || file_name || '|1.0' END, CASE WHEN {WORDS_SQL} > 0 THEN 'DOCUMENT_METRIC|' || {WORDS_SQL} || ' words|1.0' END], lambda x: x IS NOT NULL), ';') AS entities FROM documents WHERE text IS NOT NULL",
    ),
    "provider_cascade": (
        cascaded,
        f"SELECT id, CASE WHEN trim(text, ' ') = '' THEN 'other' ELSE {TYPE_SQL.replace(chr(39) + 'brief' + chr(39) + ' ELSE', chr(39) + 'brief' + chr(39) + ' WHEN ' + WORDS_SQL + ' < 1000 THEN ' + chr(39) + 'order' + chr(39) + ' ELSE')} END AS document_type, CASE WHEN trim(text, ' ') = '' THEN 'Civil Law' ELSE {CATEGORY_SQL} END AS legal_category, trim(text, ' ') <> '' AND strlen(text) <= 2000 AS fell_back FROM {TEXTS_SQL}",
    ),
    "provider_attempts": (attempts, "SELECT doc_id, arg_min(provider, CASE WHEN success THEN (processed_at, result_id) END) AS provider, count(*) AS tries, count(*) FILTER (success) AS successes FROM classification_results GROUP BY doc_id"),
    "prompt_windows": (
        windows_and_prompts,
        f"SELECT doc_id, md5(unhex(h)) AS window, CAST(length(h) / 2 AS INT) AS window_bytes, 'File: ' || coalesce(file_name, 'unknown') || chr(10) || 'Words: ' || w || ' (' || CASE WHEN w < 500 THEN 'short' WHEN w < 2000 THEN 'medium' ELSE 'long' END || ')' AS head FROM (SELECT doc_id, file_name, {WORDS_SQL} AS w, CASE WHEN strlen(text) > 500 THEN substr(hex(encode(text)), 1001, 2000) ELSE hex(encode(text)) END AS h FROM documents WHERE text IS NOT NULL)",
    ),
    "run_stats": (run_stats, "SELECT provider, count(*) AS n, count(*) FILTER (success) AS n_ok, round(100.0 * count(*) FILTER (success) / count(*), 4) AS success_rate, CAST(sum(processing_time_ms) AS BIGINT) AS total_ms, round(sum(processing_time_ms) / nullif(count(*) FILTER (success), 0), 4) AS ms_per_success FROM classification_results GROUP BY provider"),
    "upload_stats": (upload_stats, "SELECT coalesce(content_type, '') AS content_type, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) FILTER (size > 0) AS n_ok FROM storage_objects GROUP BY 1"),
    "multi_file_status": (multi_file, "SELECT doc_id, CASE WHEN count(*) FILTER (success) = 0 THEN 'failed' WHEN count(*) FILTER (NOT success) > 0 THEN 'partial_success' ELSE 'completed' END AS status FROM extraction_results GROUP BY doc_id"),
    "best_extraction": (best_extraction, "SELECT doc_id, arg_max(extraction_id, (success AND trim(coalesce(text, ''), ' ') <> '', coalesce(char_count, 0), extraction_id)) AS extraction_id FROM extraction_results GROUP BY doc_id"),
    "metadata_fields": (fields, f"SELECT * FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)}, {_quoted(c)})' for a, b, c in projection.FIELDS)}) v(id, name, type)"),
    "tag_catalogue": (tag_catalogue, f"SELECT name, tag_group, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in projection.TAGS)}) v(name, tag_group) LEFT JOIN (SELECT lower(t) AS name, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(list_distinct(legal_tags)) AS t FROM classification_results) GROUP BY 1) USING (name)"),
    "queue_by_priority": (by_priority, "SELECT result_id % 4 AS priority, count(*) AS n, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM classification_results GROUP BY 1"),
    "metrics_export": (prometheus, "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type"),
}
