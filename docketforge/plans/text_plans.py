"""Queries of text, classification, dates, redaction and storage, each with its SQL.

Rules that no text of the tables fires are also shown on a few literal rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, redact, text
from ..functions.regexes import re2
from ..sources import storage
from ..session import spread, table

AS_OF = "2024-07-01"

SNIPPETS = [
    "data/data/data/filename.txt\nDocument content", "report.pdfWed Apr 30 18:55:26 2025\nkept line\nnotes.txt", "Text with &nbsp; spaces and &amp; ampersands &lt;brackets&gt; &#8217; x",
    "<p class=\"a\">Order</p> of <b>court</b> width=200 end", "Swiss Roman 11pt (HP Roman 8) (Port) (FW)\nDocument text here", "1 2 3 4 5 6 7 LAW OFFICE\nkept", "1 5 10 15 20 25 30 kept", "1 2 3 4",
    "C:\\Data\\Lorman Seminar\nDocument here", "\\\\server\\share\\file rest", "motion to suppress the evidence filed by the defendant before this court", "order of the court on the contract and breach of property",
    "Filed: 01/15/2024\nhearing set for 2024-08-01; served on January 5 2024", "trial January 1-3, 2024 and 1/1/2024 to 1/3/2024 in court", "Decided on: March 2020\nincident on May 5, 2021, at 9:30 am",
    "123-45-6789 and 123456789 and A1234567, call 555-123-4567 or a.b@example.com, card 4111 1111 1111 1111, paid $1,234.50 on 01/02/1990", "", "   ",
    "hello <script>alert(1)</script> world javascript:run() now onload=x <iframe src=a>b</iframe> <SCRIPT>kept</SCRIPT>", "the quick and the dead of the county",
]
ERRORS = [
    "You exceeded your current quota", "insufficient_quota: billing", "rate limit reached", "API returned status 429", "status 401 unauthorized", "status 503", "context deadline exceeded", "connection refused",
    "bad request", "cannot unmarshal", "odd", None,
]
DATES = [
    "2024-01-15", "01/15/2024", "1/5/2024", "January 5, 2024", "Jan 5, 2024", "05 January 2024", "5-Jan-2024", "2024/01/05", "2024-1-5", "01-05-2024", "January 2024", "Jan 2024", "1/2024", "2024-01", "2024/01", "today", "tomorrow",
    "next week", "on March 3, 2023 at noon", "1949-12-31", "2040-01-01", "13/45/2024", "junk", "2023-05-05 10:30 am",
]
PATHS = ["documents/a/b.pdf", "../etc/passwd", "/abs/path.pdf", "a|b.txt", "", " ", "documents/x.exe", "documents/x", "documents/2024/05/01/y.docx", "documents/cat/2024/f/g.txt", "other/a/b/c.pdf", "documents/a:b.pdf"]
REPLIES = [
    'Here you are: {"document_type": "order", "legal_category": "Civil Law", "confidence": 0.9} done', '{"document_type": "poem", "confidence": 0.8}', "no json", '{"legal_category": "Tax Law"}', None,
]


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def values_sql(rows: list) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_quoted(v)})" for i, v in enumerate(rows)) + ") v(id, text)"


def literal(spark, rows: list):
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")


def texts(s, d):
    """The corpus and the literal rows (with negative ids)."""
    docs = spread(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null"), "id")
    return docs.unionByName(literal(s, SNIPPETS).select((-1 - F.col("id")).alias("id"), "text"))


TEXTS_SQL = f"(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1 - id, text FROM {values_sql(SNIPPETS)})"


def _map(fn, name="out"):
    return lambda s, d: texts(s, d).select("id", fn(F.col("text")).alias(name))


def _sql(expr: str, name="out") -> str:
    return f"SELECT id, {expr} AS {name} FROM {TEXTS_SQL}"


def _chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for p, by in steps:
        expr = f"regexp_replace({expr}, {_quoted(p)}, {_quoted(by)}, 'g')"
    return expr


def _replaced(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {_quoted(a)}, {_quoted(b)})"
    return expr


_TRIM = f"regexp_replace(x, {_quoted(text.ENDS)}, '', 'g')"
_LINES = "string_split(text, chr(10))"


def _q(p: str) -> str:
    return _quoted(p)


PATHS_SQL = f"array_to_string(list_filter(list_transform({_LINES}, lambda x: {_TRIM}), lambda x, i: NOT (regexp_matches(x, {_q(text.PATH_WITH_TIME)}) OR regexp_matches(x, {_q(text.PATH_NESTED)}) OR (i < 4 AND regexp_matches(x, {_q(text.PATH_AT_START)})))), chr(10))"
HTML_SQL = _chain(_replaced(_chain("{}", [(r"<[^>]*>", " ")]), text.ENTITIES), [(r"&#\d+;", " "), (r"&#x[0-9a-fA-F]+;", " "), (text.ATTRIBUTES, "")])
PRINTER_SQL = _chain(_replaced("{}", [(x, "") for x in text.PRINTER_LITERALS]), [(p, " ") for p in text.PRINTER_PATTERNS])
_NUMS = "regexp_extract_all(x, '\\d+')"
_IS_SEQ = (
    f"(regexp_matches(x, '^\\s*(\\d+\\s+){{5,}}') AND coalesce(list_sum(list_transform(range(1, least(len({_NUMS}), 10)), lambda i: CASE WHEN length({_NUMS}[i]) <= 2 AND length({_NUMS}[i + 1]) <= 2 "
    f"AND try_cast({_NUMS}[i + 1] AS INT) - try_cast({_NUMS}[i] AS INT) = 1 THEN 1 ELSE 0 END)), 0) / (least(len({_NUMS}), 10) - 1) > 0.7)"
)
SEQUENCES_SQL = f"array_to_string(list_filter(list_transform(string_split({{}}, chr(10)), lambda x: {_TRIM}), lambda x: NOT {_IS_SEQ}), chr(10))"
DRIVES_SQL = _chain("{}", [(p, "") for p in text.DRIVE_PATTERNS])
COLLAPSE_SQL = _chain("{}", [(r"\s+", " "), (text.ENDS, "")])


def _fill(template: str, inner: str) -> str:
    return template.replace("{}", inner)


STEPS_SQL = _fill(DRIVES_SQL, _fill(SEQUENCES_SQL, _fill(PRINTER_SQL, _fill(HTML_SQL, PATHS_SQL))))


def clean_html(s, d):
    return texts(s, d).select("id", text.strip_html(F.col("text")).alias("out"))


def type_of(s, d):
    t = texts(s, d)
    words = text.word_count(F.col("text"))
    return t.select("id", classify.document_type(F.col("text"), words, F.lit(2)).alias("document_type"), classify.legal_category(F.col("text")).alias("legal_category"))


def _cascade_sql(rules, otherwise: str, low: str = "lower(text)") -> str:
    def one(ways):
        return " OR ".join("(" + " AND ".join(f"contains({low}, {_q(w)})" for w in words) + ")" for words in ways)

    return "CASE " + " ".join(f"WHEN {one(ways)} THEN {_q(label)}" for label, ways in rules) + f" ELSE {otherwise} END"


WORDS_SQL = "len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+'))"
SIZE_SQL = f"CASE WHEN {WORDS_SQL} < 200 THEN 'notice' WHEN {WORDS_SQL} < 500 THEN 'correspondence' WHEN {WORDS_SQL} > 5000 THEN 'brief' ELSE 'other' END"
TYPE_SQL = _cascade_sql(classify.TYPE_RULES, SIZE_SQL)
CATEGORY_SQL = _cascade_sql(classify.CATEGORY_RULES, "'Civil Law'")


def confidence(s, d):
    words = text.word_count(F.col("text"))
    return texts(s, d).select("id", F.round(classify.confidence(F.col("text"), words, F.lit(2)), 6).alias("confidence"))


def keywords(s, d):
    return texts(s, d).select("id", F.array_join(classify.keywords(F.col("text")), ",").alias("keywords"))


def tags(s, d):
    t = texts(s, d)
    kind = classify.document_type(F.col("text"), text.word_count(F.col("text")), F.lit(2))
    cat = classify.legal_category(F.col("text"))
    two = t.select("id", kind.alias("k"), cat.alias("c"))
    return two.select("id", F.array_join(classify.legal_tags(F.col("k"), F.col("c")), "|").alias("tags"), classify.type_group(F.col("k")).alias("type_group"), classify.sub_category(F.col("c")).alias("sub_category"))


_TAGS_SQL = (
    "CASE " + " ".join(f"WHEN k IN ({', '.join(map(_q, t))}) THEN {_q('|'.join(g))}" for t, g in classify.TYPE_TAGS) + " ELSE '' END",
    "CASE c " + " ".join(f"WHEN {_q(c)} THEN {_q('|'.join(g))}" for c, g in classify.CATEGORY_TAGS) + " ELSE '' END",
)


def type_category(s, d):
    r = table(s, d, "classification_results").where("document_type is not null")
    return r.groupBy(classify.known_type(F.col("document_type")).alias("document_type"), classify.type_group(F.col("document_type")).alias("type_group")).agg(F.count("*").alias("n"))


def error_codes(s, d):
    r = table(s, d, "classification_results").select(F.col("result_id").alias("id"), F.col("error").alias("text"))
    both = r.unionByName(literal(s, ERRORS).select((-1 - F.col("id")).alias("id"), "text"))
    code = classify.error_code(F.col("text"))
    return both.select("id", code.alias("code"), classify.tries_next(code).alias("tries_next"))


def date_formats(s, d):
    rows = literal(s, DATES).unionByName(table(s, d, "classification_results").select((1000 + F.col("result_id")).alias("id"), F.col("filing_date").alias("text")))
    c = dates.cleaned(F.col("text"))
    return rows.select("id", dates.full_date(c).alias("full_date"), dates.partial_date(c).alias("partial_date"))


def _layout_sql(layouts) -> str:
    strp = {"yyyy-MM-dd": "%Y-%m-%d", "M/d/yyyy": "%m/%d/%Y", "MMMM d, yyyy": "%B %d, %Y", "MMM d, yyyy": "%b %d, %Y", "d MMMM yyyy": "%d %B %Y", "d-MMM-yyyy": "%d-%b-%Y", "yyyy/MM/dd": "%Y/%m/%d", "yyyy-M-d": "%Y-%m-%d", "M-d-yyyy": "%m-%d-%Y", "MMMM yyyy": "%d %B %Y", "MMM yyyy": "%d %b %Y", "M/yyyy": "%d %m/%Y", "yyyy-MM": "%d %Y-%m", "yyyy/MM": "%d %Y/%m"}
    one = lambda lay, shape: f"CASE WHEN regexp_full_match(c, {_q(shape)}) THEN CAST(try_strptime({'c' if layouts is dates.FULL else chr(39) + '1 ' + chr(39) + ' || c'}, {_q(strp[lay])}) AS DATE) END"
    return "coalesce(" + ", ".join(one(lay, shape) for lay, shape in layouts) + ")"


CLEAN_DATE_SQL = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(?:on\\s+|at\\s+|the\\s+)', ''), '(?i)\\s+(?:at\\s+.*|,\\s+at\\s+.*)$', ''), '\\s+\\d{1,2}:\\d{2}(?::\\d{2})?(?:\\s*[AaPp][Mm])?', '', 'g')), '\\s+', ' ', 'g')"


def date_windows(s, d):
    as_of = F.lit(AS_OF).cast("date")
    r = table(s, d, "parties").select("party_row_id", F.col("party_date").cast("date").alias("day"))
    return r.select("party_row_id", *[dates.valid(F.col("day"), k, as_of).alias(k) for k in dates.CONTEXT])


def date_extract(s, d):
    as_of = F.lit(AS_OF).cast("date")
    return texts(s, d).select("id", *[dates.extract_date(F.col("text"), k, as_of).alias(k) for k in dates.CONTEXT])


def date_ranges(s, d):
    as_of = F.lit(AS_OF).cast("date")
    t = texts(s, d).select("id", "text", dates.date_ranges(F.col("text"), as_of).alias("r"))
    return t.where(F.size("r") > 0).select("id", dates.range_type(F.col("text")).alias("range_type"), F.explode("r").alias("x")).select("id", "range_type", "x.start", "x.end")


def redaction_hits(s, d):
    return redact.hits(texts(s, d), "id", "text")


def _hits_sql() -> str:
    parts = ", ".join(f"list_transform(regexp_extract_all(text, {_q(p)}, 0), lambda h: {{'pii_type': {_q(n)}, 'hit': h, 'legal_code': {_q(c)}}})" for n, p, c in redact.PATTERNS)
    lists = f"flatten([{parts}])"
    return f"SELECT id, CAST(generate_subscripts(l, 1) AS INT) AS item_no, unnest(l).pii_type AS pii_type, unnest(l).hit AS hit, unnest(l).legal_code AS legal_code FROM (SELECT id, {lists} AS l FROM {TEXTS_SQL})"


def redaction_summary(s, d):
    return redaction_hits(s, d).groupBy("pii_type", "legal_code").agg(F.count("*").alias("n"), F.count_distinct("hit").alias("n_distinct"))


def redaction_mask(s, d):
    return texts(s, d).select("id", redact.masked(F.col("text")).alias("out"))


def _mask_sql() -> str:
    out = f"(SELECT id, text FROM {TEXTS_SQL})"
    for _, p, _ in redact.PATTERNS:
        out = f"(SELECT id, array_to_string(list_transform(range(1, len(h) + 2), lambda i: p[i] || coalesce(repeat('■', strlen(h[i])), '')), '') AS text FROM (SELECT id, string_split_regex(text, {_q(p)}) AS p, regexp_extract_all(text, {_q(p)}, 0) AS h FROM {out}))"
    return f"SELECT id, text AS out FROM {out}"


def redaction_items(s, d):
    """Two given overlapping places of each text masked, and one outside it left out."""
    t = table(s, d, "documents").where("length(text) >= 20").select("doc_id", F.substring("text", 1, 20).alias("text"))
    items = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 6), (4, 8), (90, 95), (7, 3))])
    return t.select("doc_id", redact.redacted(F.col("text"), items).alias("out"))


def text_counts(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.octet_length("text").alias("n_bytes"), F.length("text").alias("n_characters"), text.word_count(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), (F.sha2("text", 256) == F.col("hash")).alias("hash_ok"))


def llm_reply(s, d):
    reply = "document_type string, legal_category string, confidence double"
    p = literal(s, REPLIES).select("id", F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), reply).alias("j"))
    known = classify.known_type(F.col("j.document_type"))
    kind = F.coalesce(F.col("j.document_type"), F.lit("other"))
    bad = (known == "unknown") & F.col("j.document_type").isNotNull()
    conf = F.coalesce("j.confidence", F.lit(0.5))
    return p.select("id", F.when(bad, "other").otherwise(kind).alias("document_type"), F.coalesce("j.legal_category", F.lit("Civil Law")).alias("legal_category"), F.round(F.when(bad, conf * 0.8).otherwise(conf), 6).alias("confidence"))


def event_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def objects(s, d):
    return table(s, d, "storage_objects")


_NAME = "string_split(path, '/')[-1]"
_EXT = "lower(regexp_extract(string_split(path, '/')[-1], '\\.([^.]*)$', 1))"
_KEEP = f"NOT (path LIKE '%/' OR contains({_NAME}, '__MACOSX') OR contains({_NAME}, '.DS_Store') OR {_NAME} LIKE '%.tmp' OR {_NAME} LIKE '%.log') AND size >= 100"


def storage_latest(s, d):
    """The last version of each path."""
    return objects(s, d).groupBy("path").agg(F.max_by("size", F.struct("last_modified", "size")).alias("size"), F.max("last_modified").alias("last_modified"), F.count("*").alias("n_versions"))


def storage_filter(s, d):
    return storage.described(storage.documents(objects(s, d), "pdf", 500, 20000)).select("path", "size", "file_type", "filename").distinct()


def file_search(s, d):
    return storage.by_name(objects(s, d).select("path").distinct(), "pleading").select("path")


def path_checks(s, d):
    p = literal(s, PATHS).select("id", F.col("text").alias("path"))
    more = objects(s, d).select(F.xxhash64("path").alias("id"), "path").distinct()
    return p.unionByName(more).select("path", storage.path_error(F.col("path")).alias("error")).distinct()


_PATH_ERR = "CASE WHEN trim(path) = '' THEN 'empty' WHEN contains(path, '..') THEN 'traversal' WHEN regexp_matches(path, '[|<>:*?\"]') THEN 'invalid_character' WHEN strlen(path) > 500 THEN 'too_long' WHEN starts_with(path, '/') OR starts_with(path, '\\') THEN 'leading_separator' WHEN {e} <> '' AND {e} NOT IN ({a}) THEN 'extension' WHEN strlen({n}) > 255 THEN 'name_too_long' END"


def keys(s, d):
    p = literal(s, PATHS).select(F.col("text").alias("path")).unionByName(objects(s, d).select("path").distinct())
    k = storage.parsed_key(F.col("path"))
    ext = storage.extension(F.col("path"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in storage.FILE_TYPES.items() for x in kv])[ext], F.lit("Unknown"))
    return p.select("path", k.alias("k"), kind.alias("file_type")).select("path", "k.is_valid", "k.category", "k.date", "k.filename", "file_type")


def path_recovery(s, d):
    """By exact name, by name within the path, by the only candidate; and a path of which nothing is stored."""
    some = objects(s, d).select("path").distinct().unionByName(literal(s, STORED).select(F.col("text").alias("path")))
    out = None
    for wanted in WANTED:
        part = storage.recover(some, wanted).select(F.lit(wanted).alias("wanted"), "path", "match_rank")
        out = part if out is None else out.unionByName(part)
    return out


STORED = ["documents/brief.pdf", "documents/brief.pdf.bak", "documents/only_one_7.txt"]
WANTED = ["x/brief.pdf", "y/scan_queue", "doc_9_only_one_8.txt", "zz_missing.pdf"]
_RECOVER_SQL = "SELECT 'x/brief.pdf' AS wanted, 'documents/brief.pdf' AS path, 1 AS match_rank UNION ALL (SELECT 'y/scan_queue', path, 2 FROM storage_objects WHERE starts_with(path, 'documents/scan_queue') ORDER BY path LIMIT 1)"

QUERIES = {
    "clean_paths": (_map(text.drop_path_lines), _sql(PATHS_SQL)),
    "clean_html": (clean_html, _sql(_fill(HTML_SQL, "text"))),
    "clean_printer": (_map(text.strip_printer), _sql(_fill(PRINTER_SQL, "text"))),
    "clean_drives": (_map(text.strip_drives), _sql(_fill(DRIVES_SQL, "text"))),
    "clean_sequences": (_map(text.drop_sequences), _sql(_fill(SEQUENCES_SQL, "text"))),
    "clean_text": (_map(text.clean_text), _sql(_fill(COLLAPSE_SQL, STEPS_SQL))),
    "clean_keep_lines": (
        _map(lambda t: text.clean_text(t, keep_lines=True)),
        _sql(_chain("array_to_string(list_transform(string_split(replace(" + STEPS_SQL + ", chr(13) || chr(10), chr(10)), chr(10)), lambda x: " + _fill(COLLAPSE_SQL, "x") + "), chr(10))", [(r"\n{3,}", "\n\n"), (text.ENDS, "")])),
    ),
    "sanitize_input": (
        _map(text.sanitise),
        _sql(_replaced(_chain(_replaced(_chain(_replaced(_chain("text", [(text.ENDS, ""), (r"(?s)<script[^>]*>.*?</script>", ""), (r"(?s)<script[^>]*>.*$", "")]), [("<script", "")]), [(r"(?s)<iframe[^>]*>.*?</iframe>", ""), (r"(?s)<iframe[^>]*>.*$", "")]), [("<iframe", "")]), [(r"javascript:[^ \t\n\r]*", "")]), [(p, "") for p in text.DANGEROUS])),
    ),
    "text_counts": (text_counts, f"SELECT doc_id, CAST(strlen(text) AS INT) AS n_bytes, CAST(length(text) AS INT) AS n_characters, CAST({WORDS_SQL} AS INT) AS n_words, sha256(text) AS sha256, md5(text) AS md5, sha256(text) = hash AS hash_ok FROM documents"),
    "language_detect": (_map(text.language, "language"), _sql("CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: x IN (" + ", ".join(map(_quoted, text.ENGLISH)) + "))) / len(w) > 0.2 THEN 'en' ELSE 'unknown' END", "language").replace(TEXTS_SQL, f"(SELECT id, regexp_extract_all(lower(text), '[^ \\t\\n\\v\\f\\r]+')[:100] AS w FROM {TEXTS_SQL})")),
    "fallback_text": (lambda s, d: objects(s, d).select("path", text.fallback_text(F.col("path")).alias("text")).distinct(), "SELECT DISTINCT path, 'Document: ' || regexp_replace(n, '[_-]+', ' ', 'g') || ' Type: ' || CASE " + " ".join(f"WHEN contains(lower(n), '{w}') THEN '{w}'" for w in ("motion", "order", "brief", "complaint", "notice")) + " WHEN contains(lower(n), 'letter') THEN 'correspondence' ELSE 'legal document' END AS text FROM (SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS n FROM storage_objects)"),
    "subject_from_summary": (lambda s, d: table(s, d, "classification_results").select("result_id", text.subject_of(F.col("summary")).alias("subject")), "SELECT result_id, CASE WHEN len(w) > 12 THEN array_to_string(w[:12], ' ') || '...' ELSE array_to_string(w, ' ') END AS subject FROM (SELECT result_id, string_split(string_split(summary, '. ')[1], ' ') AS w FROM classification_results)"),
    "classify_rules": (type_of, f"SELECT id, {TYPE_SQL} AS document_type, {CATEGORY_SQL} AS legal_category FROM {TEXTS_SQL}"),
    "classify_confidence": (
        confidence,
        f"SELECT id, round(greatest(least(least(0.7::DOUBLE + CASE WHEN strlen(text) > 1000 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN strlen(text) > 5000 THEN 0.1::DOUBLE ELSE 0 END + {' + '.join(f'CASE WHEN contains(lower(text), {_q(t)}) THEN 0.05::DOUBLE ELSE 0 END' for t in classify.CONFIDENCE_TERMS)}, 0.95) + CASE WHEN {WORDS_SQL} > 0 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN {WORDS_SQL} < 100 OR {WORDS_SQL} > 20000 THEN 0.1::DOUBLE ELSE 0 END, 0.95), 0.3), 6) AS confidence FROM {TEXTS_SQL}",
    ),
    "keywords": (keywords, f"SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(lower(text), {_q(k)}) THEN {_q(k)} END' for k in classify.KEYWORDS)}], lambda x: x IS NOT NULL)[:10], ',') AS keywords FROM {TEXTS_SQL}"),
    "legal_tags_rule": (
        tags,
        f"SELECT id, a || CASE WHEN a <> '' AND b <> '' THEN '|' ELSE '' END || b AS tags, CASE WHEN k IN ({', '.join(map(_q, classify.MOTIONS))}) THEN 'motion' WHEN k IN ({', '.join(map(_q, classify.ORDERS))}) THEN 'order' WHEN k IN ({', '.join(map(_q, classify.PLEADINGS))}) THEN 'pleading' ELSE 'administrative' END AS type_group, coalesce(CASE c {' '.join(f'WHEN {_q(a)} THEN {_q(b)}' for a, b in classify.SUBCATEGORIES.items())} END, '') AS sub_category FROM (SELECT *, {_TAGS_SQL[0]} AS a, {_TAGS_SQL[1]} AS b FROM (SELECT id, {TYPE_SQL} AS k, {CATEGORY_SQL} AS c FROM {TEXTS_SQL}))",
    ),
    "type_category": (
        type_category,
        f"SELECT CASE WHEN document_type IN ({', '.join(map(_q, classify.MOTIONS + classify.ORDERS + classify.PLEADINGS + classify.OTHERS))}) THEN document_type ELSE 'unknown' END AS document_type, CASE WHEN document_type IN ({', '.join(map(_q, classify.MOTIONS))}) THEN 'motion' WHEN document_type IN ({', '.join(map(_q, classify.ORDERS))}) THEN 'order' WHEN document_type IN ({', '.join(map(_q, classify.PLEADINGS))}) THEN 'pleading' ELSE 'administrative' END AS type_group, count(*) AS n FROM classification_results WHERE document_type IS NOT NULL GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"),
    ),
    "error_categories": (
        error_codes,
        f"SELECT id, code, code NOT IN ('API_AUTH_ERROR', 'API_BAD_REQUEST') AS tries_next FROM (SELECT id, CASE WHEN text IS NULL THEN 'unknown' ELSE {_cascade_sql([(c, [[w] for w in ws]) for c, ws in classify.ERROR_RULES], chr(39) + 'UNKNOWN_ERROR' + chr(39))} END AS code FROM (SELECT result_id AS id, error AS text FROM classification_results UNION ALL SELECT -1 - id, text FROM {values_sql(ERRORS)}))",
    ),
    "date_parse_formats": (date_formats, f"SELECT id, {_layout_sql(dates.FULL)} AS full_date, {_layout_sql(dates.PARTIAL)} AS partial_date FROM (SELECT id, {CLEAN_DATE_SQL} AS c FROM (SELECT * FROM {values_sql(DATES)} UNION ALL SELECT 1000 + result_id, filing_date FROM classification_results))"),
    "date_windows": (
        date_windows,
        "SELECT party_row_id, y AND d < a + 1 AS filing_date, y AND d > DATE '1950-01-01' AND d < CAST(a + INTERVAL 10 YEAR AS DATE) AS event_date, y AND d > a - 30 AND d < CAST(a + INTERVAL 5 YEAR AS DATE) AS hearing_date, y AND d < a + 30 AS decision_date, y AND d < a + 1 AS served_date "
        f"FROM (SELECT party_row_id, CAST(party_date AS DATE) AS d, DATE '{AS_OF}' AS a, year(party_date) >= 1950 AND year(party_date) <= 2034 AS y FROM parties)",
    ),
    "date_extract": (date_extract, None),
    "date_ranges": (date_ranges, None),
    "redaction_hits": (redaction_hits, _hits_sql()),
    "redaction_summary": (redaction_summary, f"SELECT pii_type, legal_code, count(*) AS n, count(DISTINCT hit) AS n_distinct FROM ({_hits_sql()}) GROUP BY 1, 2"),
    "redaction_mask": (redaction_mask, _mask_sql()),
    "redaction_items": (redaction_items, "SELECT doc_id, repeat('■', strlen(text[3:8])) || text[9:20] AS out FROM (SELECT doc_id, text[3:22] AS text FROM (SELECT doc_id, '  ' || text AS text FROM documents WHERE length(text) >= 20))".replace("repeat('■', strlen(text[3:8])) || text[9:20]", "text[1:2] || array_to_string(list_transform(range(3, 9), lambda i: repeat('■', strlen(text[i:i]))), '') || text[9:20]")),
    "llm_json_parse": (llm_reply, "SELECT * FROM (VALUES (0, 'order', 'Civil Law', 0.9::DOUBLE), (1, 'other', 'Civil Law', 0.64), (2, 'other', 'Civil Law', 0.5), (3, 'other', 'Tax Law', 0.5), (4, 'other', 'Civil Law', 0.5)) v(id, document_type, legal_category, confidence)"),
    "event_props": (event_props, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "storage_latest": (storage_latest, "SELECT path, arg_max(size, (last_modified, size)) AS size, max(last_modified) AS last_modified, count(*) AS n_versions FROM storage_objects GROUP BY path"),
    "storage_filter": (storage_filter, f"SELECT DISTINCT path, size, {_EXT} AS file_type, {_NAME} AS filename FROM storage_objects WHERE {_KEEP} AND size >= 500 AND size <= 20000 AND {_EXT} LIKE '%pdf'"),
    "storage_count": (lambda s, d: storage.documents(objects(s, d)).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM storage_objects WHERE {_KEEP}"),
    "storage_page": (lambda s, d: objects(s, d).select("path").distinct().orderBy("path").offset(50).limit(50), "SELECT DISTINCT path FROM storage_objects ORDER BY path LIMIT 50 OFFSET 50"),
    "file_search": (file_search, f"SELECT DISTINCT path FROM storage_objects WHERE contains(lower({_NAME}), 'pleading') ORDER BY path LIMIT 20"),
    "path_recovery": (path_recovery, _RECOVER_SQL),
    "path_validate": (path_checks, f"SELECT DISTINCT path, {_PATH_ERR.format(e=_EXT, a=', '.join(map(_q, storage.ALLOWED)), n=_NAME)} AS error FROM (SELECT path FROM storage_objects UNION ALL SELECT text FROM {values_sql(PATHS)})"),
    "storage_key_parse": (
        keys,
        f"SELECT path, ok AS is_valid, CASE WHEN ok THEN p[2] END AS category, CASE WHEN ok THEN p[3] END AS date, CASE WHEN ok THEN array_to_string(p[4:], '/') END AS filename, coalesce(CASE {_EXT} {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in storage.FILE_TYPES.items())} END, 'Unknown') AS file_type FROM (SELECT path, p, len(p) >= 4 AND p[1] = 'documents' AS ok FROM (SELECT path, string_split(path, '/') AS p FROM (SELECT DISTINCT path FROM storage_objects UNION ALL SELECT text FROM {values_sql(PATHS)})))",
    ),
}
