"""Queries of search, facets and index changes over the document index, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import facets, index, predicates, search
from ..operators.predicates import SearchRequest
from ..schema import INDEX_SQL, column_of, document_index
from ..session import spread, table

AS_OF = "2024-07-01"
_FROM, _TO = datetime(2020, 1, 1), datetime(2023, 6, 30, 12)


#: What each filter of a request reads.
_READS = {"date_range": "created_at"}


def _docs(spark, d, *columns):
    return document_index(spark, d, *columns)


def _reads(r: SearchRequest) -> list[str]:
    return [_READS.get(n, n) for n in r.dimensions()] + [column_of(k) for k in r.filters if k != "date_range"] + (["created_at"] if "date_range" in r.filters else [])


def _found(request: SearchRequest, *cols: str):
    return lambda s, d: _docs(s, d, *_reads(request), *cols, "doc_id").where(predicates.compile_request(request.checked())).select("doc_id", *cols)


def _idx(body: str) -> str:
    return f"WITH {INDEX_SQL} {body}"


def _terms_sql(values: str, size: int, where: str = "key IS NOT NULL") -> str:
    return _idx(f"SELECT key, count(*) AS doc_count FROM ({values}) WHERE {where} GROUP BY key ORDER BY doc_count DESC, key LIMIT {size}")


_TAGS = "SELECT unnest(list_distinct(legal_tags)) AS key FROM document_index"


_WORDS_SQL = "regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(terms: list[str], field: str, boost: float = 1.0, source: str = "document_index", fuzzy: bool = False) -> str:
    def same(t):
        e = search.edits_allowed(t) if fuzzy else 0
        return f"lambda x: abs(length(x) - {len(t)}) <= {e} AND levenshtein(x, '{t}') <= {e}" if e else f"lambda x: x = '{t}'"

    w = _WORDS_SQL.format(f=field)
    tf = ", ".join(f"len(list_filter(w, {same(t)})) AS tf{i}" for i, t in enumerate(terms))
    counts = f"(SELECT doc_id, len(w) AS dl, {tf} FROM (SELECT doc_id, {w} AS w FROM {source}) WHERE len(w) > 0)"
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"(SELECT doc_id, {boost} * ({score}) AS score FROM {counts} p, (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM {counts}) a WHERE {hit})"


def _best_sql(terms: list[str], fields: dict[str, float] = search.FIELDS, fuzzy: bool = False) -> str:
    """Scores over the whole index: filters come after."""
    return "(SELECT doc_id, max(score) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM {_bm25_sql(terms, f, b, fuzzy=fuzzy)}" for f, b in fields.items()) + ") GROUP BY doc_id)"


_Q = "supplemental statement trademark"
_QT = search.query_terms(_Q)
_FUZZY = "trademrk suplemental"


def _rounded(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


def fulltext_or(s, d):
    return _rounded(search.bm25(spread(table(s, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", _QT))


def fulltext_top(s, d):
    return _rounded(search.bm25(spread(table(s, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", _QT, top=20))


def fulltext_best(s, d):
    return _rounded(search.best_fields(spread(_docs(s, d, *search.FIELDS), "doc_id"), "doc_id", _Q))


_FLAGSHIP = SearchRequest(query=_Q, status="filed", date_from=_FROM, size=20)


def filtered_search(s, d):
    """The flagship: filters, ranked text search, one page; scores are those of the whole index."""
    r = _FLAGSHIP.checked()
    index_ = spread(_docs(s, d, *search.FIELDS, *_reads(r)), "doc_id")
    ranked = search.best_fields(index_, "doc_id", r.query, kept=predicates.compile_request(r))
    return _rounded(ranked.orderBy(F.desc("score"), F.asc("doc_id")).offset(r.offset).limit(r.size))


_REQUEST = SearchRequest(query=_Q, filters={"status": ["filed", "pending"]}, date_from=_FROM, size=15, offset=5, sort_by="created_at", sort_order="asc")


def _run(s, d, r: SearchRequest):
    return search.search(spread(_docs(s, d, *search.FIELDS, *_reads(r), "created_at"), "doc_id"), r)


def request_page(s, d):
    """One request from end to end: filters, text, order, page and highlights."""
    page = _run(s, d, _REQUEST).page
    return page.select("doc_id", "created_at", F.round("score", 6).alias("score"), F.coalesce(F.size("highlights.text") > 0, F.lit(False)).alias("marked"))


def request_totals(s, d):
    found = _run(s, d, _REQUEST)
    return s.createDataFrame([(found.total, found.max_score)], "total bigint, max_score double").select("total", F.round("max_score", 6).alias("max_score"))


def request_fuzzy(s, d):
    r = SearchRequest(query=_FUZZY, fuzzy_search=True, status="filed", size=50)
    return _rounded(_run(s, d, r).page)


def match_all(s, d):
    return _rounded(_run(s, d, SearchRequest(status="closed", size=100, sort_order="asc")).matches)


_MANY = [f"19-MD-{i:07d}" for i in range(1500)]


def long_list(s, d):
    return predicates.where_in(_docs(s, d, "case_number"), "case_number", _MANY)


def string_range(s, d):
    return _docs(s, d, "case_number").where(predicates.range_of("case_number", "13", "15-C")).select("doc_id", "case_number")


def range_checks(s, d):
    p = table(s, d, "parties")
    a, b, c = F.col("party_date"), F.col("ingested_at"), F.lit(AS_OF).cast("timestamp_ntz")
    return p.select("party_row_id", predicates.valid_range(a, b).alias("is_valid"), predicates.empty_range(a, b).alias("is_empty"), predicates.in_range(a, F.lit(None), c).alias("before"), predicates.in_range(a, b, c).alias("within"))


_NAMED = "SELECT doc_id, string_agg(name, ' ' ORDER BY name) AS {a} FROM {t} WHERE name IS NOT NULL GROUP BY doc_id"


def fulltext_and(s, d):
    """All terms in one of seven fields."""
    names = lambda t, a: table(s, d, t).where("name is not null").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias(a))
    docs = _docs(s, d, "text", "subject", "summary", "case_name", "file_name").join(names("parties", "parties"), "doc_id", "left").join(names("attorneys", "attorneys"), "doc_id", "left")
    return search.all_terms(docs, "orchard trademark", ["subject", "text", "summary", "case_name", "file_name", "parties", "attorneys"]).select("doc_id")


def fuzzy(s, d):
    return search.fuzzy_terms(table(s, d, "documents"), "text", "trademrk orchards of")


def _marked(s, d):
    low = F.lower("text")
    return table(s, d, "documents").where(low.contains("trademark") | low.contains("orchard"))


def highlighted(s, d):
    t = _marked(s, d)
    return t.select("doc_id", search.highlight(F.col("text"), ["trademark", "orchard"]).alias("text"))


def fragments(s, d):
    t = _marked(s, d)
    return t.select("doc_id", F.to_json(search.fragments("text", F.lit(r"(?i)\b(?:trademark|orchard)\b"))).alias("fragments"))


def analysed_terms(s, d):
    """How often each analysed term occurs."""
    words = table(s, d, "documents").select(F.explode(search.analyse(search.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


def tags_all(s, d):
    return _docs(s, d, "legal_tags").where(predicates.all_of("legal_tags", ["damages", "fee award"])).select("doc_id")


def upsert_latest(s, d):
    r = table(s, d, "parties").select("doc_id", "party_no", "name", "ingested_at", "party_row_id")
    keyed = r.withColumn("id", F.concat_ws("/", "doc_id", "party_no"))
    old, new = keyed.where("party_row_id % 2 = 0"), keyed.where("party_row_id % 2 = 1")
    w = index.upsert(index.latest(old, "id", "party_row_id"), new, "id", "party_row_id")
    return w.select(index.safe_id(F.col("id")).alias("id"), "name", "party_row_id")


def merge_dates(s, d):
    """First of two sources of dates wherever it has one."""
    r = table(s, d, "classification_results")
    a = r.where("provider = 'harbor'").groupBy("doc_id").agg(F.max("filing_date").alias("fa"), F.max("hearing_date").alias("ha"))
    b = r.where("provider <> 'harbor'").groupBy("doc_id").agg(F.max("filing_date").alias("fb"), F.max("hearing_date").alias("hb"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("fa", "fb").alias("filing_date"), F.coalesce("ha", "hb").alias("hearing_date"))


def metadata_merge(s, d):
    base = table(s, d, "documents").select("doc_id", "category", "doc_type")
    r = table(s, d, "classification_results").where("success").groupBy("doc_id").agg(F.max("legal_category").alias("category"), F.max("document_type").alias("doc_type"))
    return index.merge(base, r, "doc_id", ["category", "doc_type"])


def delete_anti(s, d):
    bad = table(s, d, "classification_results").where("not success").select("doc_id")
    return index.delete(table(s, d, "documents").select("doc_id", "source"), bad, "doc_id")


def _problem():
    return F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no text").when(F.col("file_name").isNull(), "no name")


def bulk_result(s, d):
    return index.bulk(table(s, d, "documents"), "case_number", _problem())


def bulk_failures(s, d):
    docs = table(s, d, "documents")
    return index.bulk_failures(docs, "case_number", _problem()).groupBy("case_number", "error").agg(F.count("*").alias("n"))


def nested_parties(s, d):
    return index.nested_parties(table(s, d, "parties")).select("doc_id", F.size("parties").alias("n"), F.col("parties")[0]["name"].alias("first"), F.size(F.filter("parties", lambda p: F.lower(p["role"]) == "plaintiff")).alias("n_plaintiffs"))


def authors(s, d):
    return index.with_author(table(s, d, "documents").select("doc_id"), table(s, d, "attorneys"))


def _bundle_sql(sizes: dict[str, int]) -> str:
    parts = [f"SELECT '{f}' AS facet, {f if f != 'legal_tags' else 'unnest(list_distinct(legal_tags))'} AS key FROM document_index" for f in sizes]
    return "SELECT facet, key, doc_count FROM (SELECT facet, key, count(*) AS doc_count, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, key) AS r FROM (" + " UNION ALL ".join(parts) + ") WHERE key IS NOT NULL GROUP BY facet, key) WHERE r <= CASE facet " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sizes.items()) + " END"


_STATS = ("court", "judge", "category", "doc_type")
_STATS_SQL = "SELECT count(*) AS total_documents, count(DISTINCT court) AS n_courts, count(DISTINCT judge) AS n_judges, count(DISTINCT category) AS n_categories, count(DISTINCT doc_type) AS n_doc_types FROM document_index"
_BUCKETS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS doc_count FROM documents WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {i} AND created_at < TIMESTAMP '{AS_OF}'" for k, i in (("last_7_days", "7 DAYS"), ("last_30_days", "30 DAYS"), ("last_90_days", "90 DAYS"), ("last_year", "1 YEAR")))


def buckets(s, d):
    """A facet written as the JSON of a reply and read again."""
    rows = facets.terms(_docs(s, d, "doc_type"), "doc_type", 50).agg(F.collect_list(F.struct("key", "doc_count")).alias("buckets"))
    reply = rows.select(F.to_json(F.struct("buckets")).alias("j"))
    return reply.select(F.explode(facets.parsed_buckets(F.col("j"))).alias("b")).select("b.key", "b.doc_count")


QUERIES = {
    "search_term": (_found(SearchRequest(status="filed"), "status"), _idx("SELECT doc_id, status FROM document_index WHERE status = 'filed'")),
    "search_terms_any": (_found(SearchRequest(legal_tags=["venue", "appeal"])), _idx("SELECT doc_id FROM document_index WHERE list_has_any(legal_tags, ['venue', 'appeal'])")),
    "search_tags_all": (tags_all, _idx("SELECT doc_id FROM document_index WHERE list_has_all(legal_tags, ['damages', 'fee award'])")),
    "search_wildcard": (_found(SearchRequest(case_number="19-MD-*"), "case_number"), _idx("SELECT doc_id, case_number FROM document_index WHERE case_number LIKE '19-MD-%'")),
    "search_date_range": (_found(SearchRequest(date_from=_FROM, date_to=_TO)), _idx(f"SELECT doc_id FROM document_index WHERE created_at >= TIMESTAMP '{_FROM}' AND created_at <= TIMESTAMP '{_TO}'")),
    "search_combined": (
        _found(SearchRequest(doc_type="motion_to_*", court=["Superior Court of Norvane, Lindenau County", "Superior Court of Vermoor, Ravensey County", "United States District Court for the Northern District of Norvane"], date_from=_FROM)),
        _idx(f"SELECT doc_id FROM document_index WHERE doc_type LIKE 'motion\\_to\\_%' ESCAPE '\\' AND court IN ('Superior Court of Norvane, Lindenau County', 'Superior Court of Vermoor, Ravensey County', 'United States District Court for the Northern District of Norvane') AND created_at >= TIMESTAMP '{_FROM}'"),
    ),
    "search_sorted_page": (
        lambda s, d: predicates.page(_docs(s, d, "created_at"), "created_at", "asc", 25, 50).select("doc_id", "created_at"),
        _idx("SELECT doc_id, created_at FROM document_index ORDER BY created_at ASC NULLS LAST, doc_id LIMIT 25 OFFSET 50"),
    ),
    "fulltext_or": (fulltext_or, f"SELECT doc_id, round(score, 6) AS score FROM {_bm25_sql(_QT, 'text', source='documents')}"),
    "fulltext_top": (fulltext_top, f"SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM {_bm25_sql(_QT, 'text', source='documents')} ORDER BY score DESC, doc_id LIMIT 20)"),
    "fulltext_best_fields": (fulltext_best, _idx(f"SELECT doc_id, round(score, 6) AS score FROM {_best_sql(_QT)}")),
    "search_filtered_ranked": (
        filtered_search,
        _idx(f"SELECT doc_id, round(score, 6) AS score FROM {_best_sql(_QT)} JOIN document_index USING (doc_id) WHERE status = 'filed' AND created_at >= TIMESTAMP '{_FROM}' ORDER BY score DESC, doc_id LIMIT 20"),
    ),
    "search_request_page": (
        request_page,
        _idx(f"SELECT doc_id, created_at, round(score, 6) AS score, regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}])(?:supplemental|statement|trademark)(?:[^\\p{{L}}\\p{{N}}]|$)') AS marked FROM {_best_sql(_QT)} JOIN document_index USING (doc_id) WHERE status IN ('filed', 'pending') AND created_at >= TIMESTAMP '{_FROM}' ORDER BY created_at ASC NULLS LAST, doc_id LIMIT 15 OFFSET 5"),
    ),
    "search_total": (request_totals, _idx(f"SELECT count(*) AS total, round(max(score), 6) AS max_score FROM {_best_sql(_QT)} JOIN document_index USING (doc_id) WHERE status IN ('filed', 'pending') AND created_at >= TIMESTAMP '{_FROM}'")),
    "search_fuzzy_request": (request_fuzzy, _idx(f"SELECT doc_id, round(score, 6) AS score FROM {_best_sql(search.query_terms(_FUZZY), fuzzy=True)} JOIN document_index USING (doc_id) WHERE status = 'filed' ORDER BY score DESC, doc_id LIMIT 50")),
    "search_match_all": (match_all, _idx("SELECT doc_id, 1.0::DOUBLE AS score FROM document_index WHERE status = 'closed'")),
    "search_by_author": (_found(SearchRequest(author="Nathaniel Trorozzdell"), "author"), _idx("SELECT doc_id, author FROM document_index WHERE author = 'Nathaniel Trorozzdell'")),
    "search_by_judge": (_found(SearchRequest(judge=["Stadagnovic", "Grilongura", "Banavrvane"]), "judge"), _idx("SELECT doc_id, judge FROM document_index WHERE judge IN ('Stadagnovic', 'Grilongura', 'Banavrvane')")),
    "search_long_list": (long_list, "SELECT doc_id, case_number FROM documents WHERE case_number IN (" + ", ".join(f"'{v}'" for v in _MANY) + ")"),
    "search_string_range": (string_range, "SELECT doc_id, case_number FROM documents WHERE case_number >= '13' AND case_number <= '15-C'"),
    "date_range_checks": (
        range_checks,
        f"SELECT party_row_id, coalesce(party_date <= ingested_at, true) AS is_valid, party_date IS NULL AND ingested_at IS NULL AS is_empty, party_date IS NOT NULL AND coalesce(party_date <= TIMESTAMP '{AS_OF}', true) AS before, party_date IS NOT NULL AND coalesce(party_date >= ingested_at, true) AND coalesce(party_date <= TIMESTAMP '{AS_OF}', true) AS within FROM parties",
    ),
    "fulltext_and": (
        fulltext_and,
        _idx(f", wide AS (SELECT i.*, p.parties, t.attorneys FROM document_index i LEFT JOIN ({_NAMED.format(a='parties', t='parties')}) p USING (doc_id) LEFT JOIN ({_NAMED.format(a='attorneys', t='attorneys')}) t USING (doc_id)) SELECT doc_id FROM wide WHERE " + " OR ".join(f"coalesce(list_has_all({_WORDS_SQL.format(f=f)}, ['orchard', 'trademark']), false)" for f in ("subject", "text", "summary", "case_name", "file_name", "parties", "attorneys"))),
    ),
    "fulltext_fuzzy": (fuzzy, "SELECT DISTINCT t AS term, w AS match FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents), (VALUES ('trademrk', 2), ('orchards', 2), ('of', 0)) q(t, e) WHERE levenshtein(w, t) <= e"),
    "highlight": (highlighted, "SELECT doc_id, regexp_replace(' ' || text, '(?i)([^\\p{L}\\p{N}])(trademark|orchard)\\b', '\\1<mark>\\2</mark>', 'g')[2:] AS text FROM documents WHERE contains(lower(text), 'trademark') OR contains(lower(text), 'orchard')"),
    "highlight_fragments": (fragments, None),
    "analysed_terms": (analysed_terms, None),
    "facet_tags": (lambda s, d: facets.terms(_docs(s, d, "legal_tags"), "legal_tags", 100), _terms_sql(_TAGS, 100)),
    "facet_doc_types": (lambda s, d: facets.terms(_docs(s, d, "doc_type"), "doc_type", 50), _terms_sql("SELECT doc_type AS key FROM document_index", 50)),
    "facet_field_prefix": (lambda s, d: facets.terms(_docs(s, d, "court"), "metadata.court", 50, prefix="Superior"), _terms_sql("SELECT court AS key FROM document_index", 50, "starts_with(key, 'Superior')")),
    "facet_filtered_exclude": (
        lambda s, d: facets.terms(_docs(s, d, "status", "created_at", "doc_type").where(predicates.compile_request(SearchRequest(filters={"status": "filed", "date_range": {"from": _FROM, "to": _TO}}))), "doc_type", 50, exclude=["order", "brief"]),
        _terms_sql(f"SELECT doc_type AS key FROM document_index WHERE status = 'filed' AND created_at BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'", 50, "key IS NOT NULL AND key NOT IN ('order', 'brief')"),
    ),
    "field_options": (lambda s, d: facets.bundle(_docs(s, d, *facets.BUNDLE)), _idx(_bundle_sql(facets.BUNDLE))),
    "document_stats": (lambda s, d: facets.stats(_docs(s, d, *_STATS)), _idx(_STATS_SQL)),
    "document_report": (
        lambda s, d: facets.document_report(_docs(s, d, *_STATS, "legal_tags")),
        _idx(f"SELECT * FROM ({_bundle_sql({'doc_type': 50, 'legal_tags': 100})}) UNION ALL SELECT CASE WHEN k = 'total' THEN 'total' ELSE 'distinct' END, nullif(k, 'total'), n FROM (SELECT unnest(['total', 'court', 'judge']) AS k, unnest([total_documents, n_courts, n_judges]) AS n FROM ({_STATS_SQL}))"),
    ),
    "combined_aggregation": (
        lambda s, d: facets.combined(_docs(s, d, "document_type", "court", "judge", "created_at"), ["document_types", "courts", "unheard_of", "judges", "date_ranges", "courts"], AS_OF),
        _idx(f"SELECT CASE facet WHEN 'document_type' THEN 'document_types' WHEN 'court' THEN 'courts' ELSE 'judges' END AS facet, key, doc_count FROM ({_bundle_sql({'document_type': 20, 'court': 25, 'judge': 30})}) UNION ALL SELECT 'date_ranges', key, doc_count FROM ({_BUCKETS_SQL})"),
    ),
    "bucket_parsing": (buckets, _terms_sql("SELECT doc_type AS key FROM document_index", 50)),
    "cardinality_approx": (lambda s, d: facets.stats(_docs(s, d, *_STATS), exact=False), None),
    "date_range_buckets": (lambda s, d: facets.date_buckets(_docs(s, d, "created_at"), AS_OF), _BUCKETS_SQL),
    "stats_by_period": (lambda s, d: facets.by_period(_docs(s, d, "status", "created_at"), "status", "month"), _idx("SELECT status AS key, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS period, count(*) AS doc_count FROM document_index GROUP BY ALL")),
    "stats_by_periods": (
        lambda s, d: facets.by_periods(_docs(s, d, "category", "court", "judge", "author", "created_at"), ["category", "court", "judge", "author"], ["day", "week", "month", "year"]),
        _idx("SELECT dimension, key, grain, period, count(*) AS doc_count FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS dimension, {g} AS key, '{p}' AS grain, CAST(date_trunc('{p}', created_at) AS TIMESTAMP) AS period FROM document_index" for g in ("category", "court", "judge", "author") for p in ("day", "week", "month", "year")) + ") GROUP BY ALL"),
    ),
    "upsert_latest": (
        upsert_latest,
        "SELECT replace(id, '/', '_') AS id, name, party_row_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY party_row_id % 2 DESC, party_row_id DESC) AS r FROM (SELECT *, doc_id || '/' || party_no AS id FROM parties)) WHERE r = 1",
    ),
    "delete_anti": (delete_anti, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM classification_results WHERE NOT success AND doc_id IS NOT NULL)"),
    "metadata_merge": (metadata_merge, "SELECT d.doc_id, coalesce(r.c, d.category) AS category, coalesce(r.t, d.doc_type) AS doc_type FROM documents d LEFT JOIN (SELECT doc_id, max(legal_category) AS c, max(document_type) AS t FROM classification_results WHERE success GROUP BY doc_id) r USING (doc_id)"),
    "merge_dates": (
        merge_dates,
        "SELECT doc_id, coalesce(a.f, b.f) AS filing_date, coalesce(a.h, b.h) AS hearing_date FROM (SELECT doc_id, max(filing_date) AS f, max(hearing_date) AS h FROM classification_results WHERE provider = 'harbor' GROUP BY doc_id) a FULL JOIN (SELECT doc_id, max(filing_date) AS f, max(hearing_date) AS h FROM classification_results WHERE provider <> 'harbor' GROUP BY doc_id) b USING (doc_id)",
    ),
    "bulk_result": (bulk_result, "SELECT count(*) FILTER (k AND p IS NULL) AS indexed, count(*) FILTER (k AND p IS NOT NULL) AS failed, count(*) FILTER (NOT k) AS skipped FROM (SELECT coalesce(case_number, '') <> '' AS k, CASE WHEN coalesce(text, '') = '' THEN 'no text' WHEN file_name IS NULL THEN 'no name' END AS p FROM documents)"),
    "bulk_failures": (bulk_failures, "SELECT case_number, 'no text' AS error, count(*) AS n FROM documents WHERE coalesce(case_number, '') <> '' AND coalesce(text, '') = '' GROUP BY 1 UNION ALL SELECT case_number, 'no name', count(*) FROM documents WHERE coalesce(case_number, '') <> '' AND coalesce(text, '') <> '' AND file_name IS NULL GROUP BY 1"),
    "nested_parties": (
        nested_parties,
        "SELECT doc_id, CAST(count(*) AS INT) AS n, nullif(arg_min(coalesce(name, '~none~'), party_no), '~none~') AS first, CAST(count(*) FILTER (lower(role) = 'plaintiff') AS INT) AS n_plaintiffs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, party_no ORDER BY ingested_at DESC, party_row_id DESC) AS r FROM parties) WHERE r = 1 GROUP BY doc_id",
    ),
    "index_authors": (authors, "SELECT d.doc_id, a.author FROM documents d LEFT JOIN (SELECT doc_id, arg_min(name, (attorney_no, attorney_row_id)) AS author FROM attorneys WHERE trim(name) <> '' GROUP BY doc_id) a USING (doc_id)"),
}
