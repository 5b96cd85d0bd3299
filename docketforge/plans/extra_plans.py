"""Queries of the smaller functions, array predicates, legacy fields and the index as a table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import more
from ..session import table
from ..sources import storage
from .more_plans import _N
from .text_plans import TEXTS_SQL, _quoted, literal, texts

AS_OF = "2024-07-03"
DAYS = ["next monday", "last friday", "this wed", "Sunday", "common", "saturday next", "nothing", "tue", None]
STATUS = [200, 400, 404, 429, 500, 504, 418]


def weekdays(s, d):
    return literal(s, DAYS).select("id", more.weekday(F.col("text"), F.lit(AS_OF).cast("date")).alias("day"))


def error_families(s, d):
    r = table(s, d, "classification_results").select(F.col("result_id").alias("id"), F.col("error").alias("text")).where("text is not null")
    e = table(s, d, "extraction_results").select((-F.col("extraction_id")).alias("id"), F.col("error").alias("text")).where("text is not null")
    return r.unionByName(e).select("id", more.error_family(F.col("text")).alias("family"))


def statuses(s, d):
    return s.createDataFrame([(x,) for x in STATUS], "status int").select("status", more.status_code(F.col("status")).alias("code"))


def object_links(s, d):
    """Path, type, delivery parameters, public address and id of every stored object."""
    o = table(s, d, "storage_objects").select("path").distinct()
    ext = storage.extension(F.col("path"))
    mime = F.coalesce(F.create_map(*[F.lit(x) for kv in storage.MIME_TYPES.items() for x in kv])[ext], F.lit("application/octet-stream"))
    return o.select("path", mime.alias("mime"), more.delivery_parameters(ext).alias("parameters"), more.public_url("https://files.example", more.storage_path(F.col("path"))).alias("url"), more.document_id(F.col("path")).alias("doc_id"))


def storage_keys(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", storage.storage_key(F.col("file_name"), F.col("category"), F.col("created_at")).alias("key"))


def basic_clean(s, d):
    return texts(s, d).select("id", more.basic_clean(F.col("text")).alias("out"))


def unescaped(s, d):
    return texts(s, d).select("id", more.unescaped(F.col("text")).alias("out"))


def attorneys_by_role(s, d):
    """Each document's attorneys as an array, filtered by role inside the row."""
    a = table(s, d, "attorneys")
    last = a.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "attorney_no").orderBy(F.desc("ingested_at"), F.desc("attorney_row_id")))).where("r = 1")
    arr = last.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("attorney_no", "name", "role"))).alias("a"))
    n = lambda role: F.size(F.filter("a", lambda x: x["role"] == role))
    return arr.select("doc_id", F.size("a").alias("n"), n("defense").alias("n_defense"), n("prosecution").alias("n_prosecution"), F.coalesce(F.exists("a", lambda x: x["role"] == "defense"), F.lit(False)).alias("has_defense"))


def legacy_fields(s, d):
    """Old field names filled from the new structs: case name and number, the first attorney as author."""
    r = table(s, d, "classification_results")
    first = table(s, d, "attorneys").where("trim(name) <> ''").groupBy("doc_id").agg(F.min_by("name", F.struct("attorney_no", "attorney_row_id")).alias("author"))
    docs = table(s, d, "documents").select("doc_id", F.col("case_number").alias("old_number"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    j = r.join(docs, "doc_id", "left").join(first, "doc_id", "left")
    return j.select("result_id", blank("case_info.case_name").alias("case_name"), F.coalesce(blank("case_info.case_number"), blank("old_number")).alias("case_number"), "author")


def extraction_strategy(s, d):
    e = table(s, d, "extraction_results")
    has = F.octet_length(F.trim(F.coalesce("text", F.lit("")))) > 50
    return e.select("extraction_id", more.strategy(has, F.coalesce(F.col("page_count") > 2, F.lit(False))).alias("s")).select("extraction_id", "s.kind", "s.method", "s.confidence")


def delays(s, d):
    return s.range(1, 31).select(F.col("id").alias("attempt"), more.provider_delay(F.col("id")).alias("delay_s"))


def reply_rounds(s, d):
    """JSON made of each result and read again."""
    r = table(s, d, "classification_results").select("result_id", "document_type", "confidence", "keywords")
    j = r.select("result_id", F.to_json(F.struct("document_type", "confidence", "keywords")).alias("j"))
    back = j.select("result_id", F.from_json("j", "document_type string, confidence double, keywords array<string>").alias("b"))
    return back.select("result_id", "b.document_type", "b.confidence", F.size("b.keywords").alias("n_keywords"))


def index_table(s, d):
    """The index registered under a name and looked up by it."""
    name = "docketforge_index"
    view = table(s, d, "documents").select("doc_id", "doc_type", "size")
    view.createOrReplaceTempView(name)
    exists = s.catalog.tableExists(name)
    return s.table(name).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("n", "bytes", F.lit(exists).alias("known"))


def day_histogram(s, d):
    """Documents created a day, with the running total."""
    t = table(s, d, "documents").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    # days are few: the running sum is over them, not over documents
    return t.select("day", "n", F.sum("n").over(Window.orderBy("day")).alias("running"))


_FAMILY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {_quoted(w)})" for w in ws) + f" THEN {_quoted(n)}" for n, ws in more.ERROR_FAMILIES.items()) + " ELSE 'other' END"
_EXT = f"lower(regexp_extract({_N}, '\\.([^.]*)$', 1))"
_ENDS = r"^[\t\n\x0B\f\r\p{Zs}]+|[\t\n\x0B\f\r\p{Zs}]+$"
_PATH = "replace(regexp_replace(path, '^/+|/+$', '', 'g'), '//', '/')"
_UNESC = "text"
for _a, _b in (("\\n", " "), ("\\r", " "), ("\\t", " "), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
    _UNESC = f"replace({_UNESC}, {_quoted(_a)}, {_quoted(_b)})"

QUERIES = {
    # as_of is a Wednesday
    "relative_weekdays": (weekdays, "SELECT id, CAST(d AS DATE) AS day FROM (VALUES (0, '2024-07-08'), (1, '2024-06-28'), (2, '2024-07-03'), (3, '2024-07-07'), (4, NULL), (5, '2024-07-06'), (6, NULL), (7, '2024-07-09'), (8, NULL)) v(id, d)"),
    "error_families": (error_families, f"SELECT id, {_FAMILY} AS family FROM (SELECT result_id AS id, error AS text FROM classification_results UNION ALL SELECT -extraction_id, error FROM extraction_results) WHERE text IS NOT NULL"),
    "status_codes": (statuses, f"SELECT CAST(status AS INT) AS status, coalesce(CASE status {' '.join(f'WHEN {k} THEN {_quoted(v)}' for k, v in more.STATUS_CODES.items())} END, 'unknown_error') AS code FROM (VALUES {', '.join(f'({x})' for x in STATUS)}) v(status)"),
    "object_links": (
        object_links,
        f"SELECT path, coalesce(CASE {_EXT} {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in storage.MIME_TYPES.items())} END, 'application/octet-stream') AS mime, CASE {' '.join('WHEN ' + _EXT + ' IN (' + ', '.join(map(_quoted, e)) + ') THEN ' + _quoted(p) for e, p in more.DELIVERY)} ELSE 'gzip=true' END || '&cache=max' AS parameters, 'https://files.example/' || CASE WHEN starts_with({_PATH}, 'documents/') OR starts_with({_PATH}, 'temp/') OR starts_with({_PATH}, 'uploads/') THEN {_PATH} ELSE 'documents/' || {_PATH} END AS url, 'doc_' || sha256(path)[:16] AS doc_id FROM (SELECT DISTINCT path FROM storage_objects)",
    ),
    "storage_keys": (storage_keys, "SELECT doc_id, 'documents/' || coalesce(nullif(category, ''), 'uncategorized') || '/' || strftime(created_at, '%Y/%m/%d') || '/' || replace(string_split(file_name, '/')[-1], ' ', '_') AS key FROM documents"),
    "basic_clean": (
        basic_clean,
        f"SELECT id, regexp_replace(replace(replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, {_quoted(_ENDS)}, '', 'g')), chr(10)), repeat(chr(10), 4), repeat(chr(10), 2)), repeat(chr(10), 3), repeat(chr(10), 2)), {_quoted(_ENDS)}, '', 'g') AS out FROM {TEXTS_SQL}",
    ),
    "unescape_pdf": (unescaped, f"SELECT id, regexp_replace(regexp_replace({_UNESC}, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]', '', 'g'), {_quoted(_ENDS)}, '', 'g') AS out FROM {TEXTS_SQL}"),
    "attorneys_by_role": (
        attorneys_by_role,
        "SELECT doc_id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (role = 'defense') AS INT) AS n_defense, CAST(count(*) FILTER (role = 'prosecution') AS INT) AS n_prosecution, count(*) FILTER (role = 'defense') > 0 AS has_defense FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, attorney_no ORDER BY ingested_at DESC, attorney_row_id DESC) AS r FROM attorneys) WHERE r = 1 GROUP BY doc_id",
    ),
    "legacy_fields": (
        legacy_fields,
        "SELECT r.result_id, nullif(r.case_info.case_name, '') AS case_name, coalesce(nullif(r.case_info.case_number, ''), nullif(d.case_number, '')) AS case_number, a.author FROM classification_results r LEFT JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, arg_min(name, (attorney_no, attorney_row_id)) AS author FROM attorneys WHERE trim(name) <> '' GROUP BY doc_id) a USING (doc_id)",
    ),
    "extraction_strategy": (
        extraction_strategy,
        "SELECT extraction_id, CASE WHEN t AND NOT i THEN 'text' WHEN NOT t AND i THEN 'scanned' WHEN t AND i THEN 'hybrid' ELSE 'unknown' END AS kind, CASE WHEN NOT t AND i THEN 'ocr' ELSE 'text' END AS method, CASE WHEN t AND NOT i THEN 0.9 WHEN NOT t AND i THEN 0.8 WHEN t AND i THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT extraction_id, strlen(trim(coalesce(text, ''), ' ')) > 50 AS t, coalesce(page_count > 2, false) AS i FROM extraction_results)",
    ),
    "provider_delays": (delays, "SELECT attempt, least(3.0::DOUBLE * attempt, 60) AS delay_s FROM range(1, 31) t(attempt)"),
    "json_round_trip": (reply_rounds, "SELECT result_id, document_type, confidence, CAST(len(keywords) AS INT) AS n_keywords FROM classification_results"),
    "index_table": (index_table, "SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, true AS known FROM documents"),
    "day_histogram": (day_histogram, "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS running FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM documents GROUP BY 1)"),
}
