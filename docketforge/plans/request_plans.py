"""Queries of requests, queues with a capacity, files and readers, each with its SQL."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import jobs, metrics, requests
from ..session import table, work_dir
from ..sources import readers
from .job_plans import _ITEMS, _items, _points
from .text_plans import _quoted, literal

AS_OF = "2024-07-01"


def batch_guard(s, d):
    n = table(s, d, "documents").groupBy("case_number").agg(F.count_if(F.col("text") != "").alias("n"))
    return n.select("case_number", "n", requests.batch_error(F.col("n")).alias("error"))


def clamps(s, d):
    r = s.range(-3, 330).select(F.col("id").cast("int").alias("v"))
    return r.select("v", requests.clamped(F.col("v"), requests.TIMEOUT).alias("timeout_s"), requests.clamped(F.col("v"), requests.RETRIES).alias("retries"))


TAGS = [*requests.MESSAGES, "odd"]


def messages(s, d):
    rows = s.createDataFrame([("Name", t, "5") for t in TAGS], "field string, tag string, param string")
    return rows.select("tag", requests.message(F.col("field"), F.col("tag"), F.col("param")).alias("message"))


def pipeline_errors(s, d):
    return table(s, d, "documents").select("doc_id", requests.pipeline_error(F.col("size"), F.col("content_type"), F.col("file_name")).alias("error"))


NAMES = ["a.pdf", "a..pdf", "x<y.txt", "run.EXE", "tab\tname.doc", "deep/a.py", "ok.docx", "b.jsp", "q?.js"]


def unsafe_names(s, d):
    return literal(s, NAMES).select("text", requests.unsafe_name(F.col("text")).alias("problem"))


def document_errors(s, d):
    t = table(s, d, "documents")
    c = F.col
    doc = {"id": c("doc_id"), "text": c("text"), "file_name": c("file_name"), "doc_type": c("doc_type"), "hash": c("hash"), "metadata": c("category"), "created_at": c("created_at"), "updated_at": c("updated_at")}
    return t.select("doc_id", requests.document_error(doc).alias("error"))


def index_status(s, d):
    """Classification runs with what indexing made of their documents: pending are documents with a text, failed those without a hash."""
    docs = table(s, d, "documents")
    r = table(s, d, "classification_results").select("result_id", "doc_id")
    failed = docs.where("hash is null").select("doc_id", F.concat(F.lit("no hash: "), F.col("file_name")).alias("error"))
    return requests.with_index_status(r, docs.where("text <> ''"), failed, "doc_id")


_ROOM = {"harbor": 40, "lumen": 15}


def capacity(s, d):
    return requests.admitted(_items(s, d), "queue", "created", "result_id", _ROOM, 25).select("queue", "result_id", "accepted")


def standard_queues(s, d):
    """How full the standard queues are with the items of each kind of work."""
    kinds = F.element_at(F.array(*map(F.lit, jobs.QUEUES)), (F.col("result_id") % len(jobs.QUEUES) + 1).cast("int"))
    n = table(s, d, "classification_results").groupBy(kinds.alias("queue")).agg(F.count("*").alias("n"))
    room = s.createDataFrame([(q, c, w) for q, (c, w) in jobs.QUEUES.items()], "queue string, capacity int, workers int")
    return room.join(n, "queue", "left").select("queue", "capacity", "workers", F.least(F.coalesce("n", F.lit(0)), F.col("capacity").cast("bigint")).alias("held"), F.greatest(F.coalesce("n", F.lit(0)) - F.col("capacity"), F.lit(0)).alias("rejected"))


def reprioritised(s, d):
    items = _items(s, d).select("queue", "result_id", "priority", "created")
    removed = items.where("result_id % 5 = 0")
    new = items.where("result_id % 7 = 0").select("result_id", F.lit(9).cast("bigint").alias("priority"))
    return jobs.queue_order(requests.changed(items, "result_id", removed, new), "queue", "priority", "created", "result_id").select("queue", "result_id", "priority", "place")


def worker_stats(s, d):
    r = table(s, d, "classification_results")
    return requests.workers(r.where("processing_time_ms is not null"), "provider", "processing_time_ms", "success")


def range_merge(s, d):
    """Date ranges of two literal sources."""
    as_of = F.lit(AS_OF).cast("date")
    a = literal(s, RANGES[0]).select("id", dates.date_ranges(F.col("text"), as_of).alias("ranges"))
    b = literal(s, RANGES[1]).select((F.col("id") + 1).alias("id"), dates.date_ranges(F.col("text"), as_of).alias("ranges"))
    return requests.merged_ranges(a, b, "id").select("id", F.posexplode("ranges").alias("n", "r")).select("id", "n", "r.start", "r.end")


RANGES = [["trial January 1-3, 2024", "nothing", "hearing 1/5/2024 to 1/9/2024"], ["set from March 4-6, 2024", "2/1/2024 through 2/2/2024 and May 1-2, 2024"]]
_RANGE_ROWS = [(0, 0, "2024-01-01", "2024-01-03"), (1, 0, "2024-03-04", "2024-03-06"), (2, 0, "2024-01-05", "2024-01-09"), (2, 1, "2024-05-01", "2024-05-02"), (2, 2, "2024-02-01", "2024-02-02")]


def metrics_json(s, d):
    return metrics.report(_points(s, d)).select(F.to_json(F.struct("n", "success_rate")).alias("report"))


def index_mapping(s, d):
    """The fields of the index table and their types."""
    return s.createDataFrame([(f.name, f.dataType.simpleString()) for f in table(s, d, "documents").schema], "field string, type string")


def detected_formats(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", readers.detected(F.col("file_name"), F.col("content_type")).alias("format"))


LINES = "%PDF-1.4\n\x00\x01\x02\x03\x04ab\nBT (Filed \\(today\\)) Tj ET\nok\nfine line\\n here\n\x80\x81\x82\x83x\n"


def pattern_text(s, d):
    docs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return docs.select("id", readers.readable_lines(F.col("text")).alias("out"))


def _docx(lines: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _pdf(shown: bytes, packed: bool) -> bytes:
    data = zlib.compress(shown) if packed else shown
    return b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length " + str(len(data)).encode() + (b" /Filter /FlateDecode" if packed else b"") + b" >>\nstream\n" + data + b"\nendstream endobj\n"


#: Files that the readers are shown, and what they must read: name, content, format, text, pages, success.
FILES = [
    ("a/plain.txt", b"Order of the court\nGranted.", "txt", "Order of the court\nGranted.", 1, True), ("a/broken.txt", b"caf\xe9 closed", "txt", "caf\ufffd closed", 1, True),
    ("b/motion.docx", _docx(["Motion to dismiss", "", "filed today"]), "docx", "Motion to dismiss\n\nfiled today", 1, True), ("b/bad.docx", b"no archive", "docx", None, None, False),
    ("c/plain.pdf", _pdf(b"BT (Filed \\(here\\)) Tj [(one) -20 (two)] TJ ET", False), "pdf", "Filed (here)\nonetwo", 1, True), ("c/packed.pdf", _pdf(b"BT (Compressed text) Tj ET", True), "pdf", "Compressed text", 1, True),
    ("c/none.pdf", b"not a pdf at all", "pdf", None, None, False),
]


def read_files(s, d):
    """Files of every format written to the shared folder, listed, and read again; in the end they are deleted."""
    base = work_dir(s)
    rows = s.createDataFrame([(n, base64.b64encode(c).decode()) for n, c, *_ in FILES], "name string, content string").select("name", F.unbase64("content").alias("content"))
    failed = readers.upload(rows, base, "name", "content").where("error is not null").count()
    if failed or not readers.exists(s, base):
        raise RuntimeError("files could not be written")
    got = readers.extract(s, base)
    out = got.select(F.substring_index("path", "/work-", -1).alias("p"), "format", "text", "page_count", "word_count", "char_count", "success").select(F.expr("substr(p, instr(p, '/') + 1)").alias("name"), "format", "text", "page_count", "word_count", "char_count", "success")
    held = s.createDataFrame(out.collect(), out.schema)  # the few files above
    readers.delete(s, base)
    return held


def _files_sql() -> str:
    def one(n, fmt, text, pages, ok):
        words = "NULL" if text is None else len(text.split())
        size = "NULL" if text is None else len(text.encode())
        return f"({_quoted(n)}, {_quoted(fmt)}, {_quoted(text)}, {'NULL' if pages is None else pages}, {words}, {size}, {str(ok).lower()})"

    rows = ", ".join(one(n, *rest) for n, _, *rest in FILES)
    return f"SELECT name, format, text, CAST(p AS INT) AS page_count, CAST(w AS INT) AS word_count, CAST(c AS BIGINT) AS char_count, success FROM (VALUES {rows}) v(name, format, text, p, w, c, success)"


_BLANK = lambda c: f"coalesce({c}, '') = ''"
_EXT = "lower(regexp_extract(file_name, '\\.([^./]+)$', 1))"
_KNOWN = ", ".join(map(_quoted, sorted(set(readers.READERS) | readers.TEXT_EXTENSIONS)))
_UNSAFE = "CASE WHEN contains(text, '..') THEN 'traversal' " + " ".join(f"WHEN contains(text, {'chr(' + str(ord(c)) + ')'}) THEN 'character'" for c in requests.SUSPICIOUS) + " " + " ".join(f"WHEN ends_with(lower(text), '{e}') THEN 'extension {e}'" for e in requests.DANGEROUS_ENDS) + " END"
_TRIM = "regexp_replace(x, '^[\\t\\n\\x0B\\f\\r\\p{Zs}]+|[\\t\\n\\x0B\\f\\r\\p{Zs}]+$', '', 'g')"
_UNESCAPED = "x"
for _a, _b in (("\\n", " "), ("\\r", " "), ("\\t", " "), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
    _UNESCAPED = f"replace({_UNESCAPED}, {_quoted(_a)}, {_quoted(_b)})"
_PRINTED = "regexp_replace({}, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]', '', 'g')"

QUERIES = {
    "batch_guard": (batch_guard, "SELECT case_number, n, CASE WHEN n < 1 THEN 'empty' WHEN n > 1000 THEN 'too_many' END AS error FROM (SELECT case_number, count(*) FILTER (text <> '') AS n FROM documents GROUP BY 1)"),
    "option_clamps": (clamps, "SELECT CAST(v AS INT) AS v, CAST(CASE WHEN v BETWEEN 1 AND 300 THEN v ELSE 120 END AS INT) AS timeout_s, CAST(CASE WHEN v BETWEEN 0 AND 3 THEN v ELSE 1 END AS INT) AS retries FROM range(-3, 330) t(v)"),
    "validation_messages": (messages, "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(t)}, {_quoted(requests.MESSAGES.get(t, '{field} is invalid').format(field='Name', param='5'))})" for t in TAGS) + ") v(tag, message)"),
    "pipeline_errors": (pipeline_errors, f"SELECT doc_id, CASE WHEN size > {requests.MAX_SIZE} THEN 'too_large' WHEN content_type IS NULL OR content_type NOT IN ({', '.join(map(_quoted, requests.PIPELINE_TYPES))}) THEN 'unsupported_type' WHEN {_BLANK('file_name')} THEN 'no_name' END AS error FROM documents"),
    "unsafe_names": (unsafe_names, f"SELECT text, {_UNSAFE} AS problem FROM (VALUES {', '.join(f'({_quoted(n)})' for n in NAMES)}) v(text)"),
    "document_errors": (document_errors, "SELECT doc_id, CASE " + " ".join(f"WHEN {_BLANK(c)} THEN '{c}'" for c in ("text", "file_name", "doc_type", "hash")) + " WHEN category IS NULL THEN 'metadata' WHEN created_at IS NULL THEN 'created_at' WHEN updated_at IS NULL THEN 'updated_at' END AS error FROM documents"),
    "index_status": (
        index_status,
        "SELECT doc_id, result_id, p AND e IS NULL AS indexed, CASE WHEN p AND e IS NULL THEN doc_id END AS index_id, CASE WHEN p THEN e END AS index_error FROM (SELECT r.doc_id, r.result_id, coalesce(d.text <> '', false) AS p, CASE WHEN d.doc_id IS NOT NULL AND d.hash IS NULL THEN 'no hash: ' || d.file_name END AS e FROM classification_results r LEFT JOIN documents d USING (doc_id))",
    ),
    "queue_capacity": (
        capacity,
        f"SELECT queue, result_id, row_number() OVER (PARTITION BY queue ORDER BY created ASC NULLS FIRST, result_id) <= CASE queue {' '.join(f'WHEN {_quoted(q)} THEN {n}' for q, n in _ROOM.items())} ELSE 25 END AS accepted FROM {_ITEMS}",
    ),
    "standard_queues": (
        standard_queues,
        f"SELECT q AS queue, CAST(c AS INT) AS capacity, CAST(w AS INT) AS workers, least(coalesce(n, 0), c) AS held, greatest(coalesce(n, 0) - c, 0) AS rejected FROM (VALUES {', '.join(f'({i}, {_quoted(q)}, {c}, {w})' for i, (q, (c, w)) in enumerate(jobs.QUEUES.items()))}) v(i, q, c, w) LEFT JOIN (SELECT result_id % {len(jobs.QUEUES)} AS i, count(*) AS n FROM classification_results GROUP BY 1) USING (i)",
    ),
    "queue_changes": (
        reprioritised,
        f"SELECT queue, result_id, p AS priority, CAST(row_number() OVER (PARTITION BY queue ORDER BY p DESC, created ASC NULLS FIRST, result_id) AS INT) AS place FROM (SELECT *, CASE WHEN result_id % 7 = 0 THEN 9 ELSE priority END AS p FROM {_ITEMS} WHERE result_id % 5 <> 0)",
    ),
    "worker_stats": (worker_stats, "SELECT provider, count(*) AS n_items, round(avg(CAST(success AS INT)), 6) AS success_share, CAST(sum(processing_time_ms) AS BIGINT) AS busy_ms, round(sum(processing_time_ms) / (SELECT sum(processing_time_ms) FROM classification_results), 6) AS busy_share FROM classification_results WHERE processing_time_ms IS NOT NULL GROUP BY 1"),
    "range_merge": (range_merge, "SELECT CAST(id AS BIGINT) AS id, CAST(n AS INT) AS n, CAST(a AS DATE) AS start, CAST(b AS DATE) AS \"end\" FROM (VALUES " + ", ".join(f"({i}, {n}, '{a}', '{b}')" for i, n, a, b in _RANGE_ROWS) + ") v(id, n, a, b)"),
    "metrics_json": (metrics_json, "SELECT '{\"n\":' || count(*) || ',\"success_rate\":' || CAST(round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS DOUBLE) || '}' AS report FROM events"),
    "index_mapping": (index_mapping, "SELECT column_name AS field, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type FROM (DESCRIBE documents)"),
    "detected_formats": (detected_formats, f"SELECT doc_id, CASE WHEN {_EXT} IN ({_KNOWN}) THEN {_EXT} ELSE coalesce(CASE content_type {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in readers.MIME_FORMATS.items())} END, 'txt') END AS format FROM documents"),
    "pdf_pattern_text": (
        pattern_text,
        f"SELECT doc_id AS id, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}), lambda x: coalesce(length({_PRINTED.format('x')}) / nullif(strlen(x), 0) > 0.7, false)), lambda x: {_TRIM.replace('regexp_replace(x,', 'regexp_replace(' + _PRINTED.format(_UNESCAPED) + ',')}), lambda x: strlen(x) > 2), ' ') AS out FROM documents WHERE text IS NOT NULL",
    ),
    "read_files": (read_files, _files_sql()),
}
