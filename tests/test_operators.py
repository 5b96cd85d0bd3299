"""Predicates, facets, search, index, jobs, metrics on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docketforge.functions.regexes import re2
from docketforge.operators import facets, index, jobs, metrics, predicates, search
from docketforge.operators.predicates import SearchRequest
from docketforge.schema import column_of


@pytest.fixture
def docs(spark):
    rows = [
        (1, "order", "19-CV-1", "filed", ["a", "b", "a"], datetime(2024, 1, 1), "the motion to dismiss is denied", "S one", None),
        (2, "brief", "19-CV-2", "sealed", ["b"], datetime(2024, 6, 1), "a brief on the motion motion", None, "X"),
        (3, "order", None, None, None, None, None, None, None),
        (4, "order_x", "20-CV-1", "filed", [], datetime(2024, 6, 30, 12), "", "", "Y"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, doc_type string, case_number string, status string, legal_tags array<string>, created_at timestamp, text string, subject string, category string")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


@pytest.mark.parametrize(
    "request_, want",
    [
        (SearchRequest(), [1, 2, 3, 4]), (SearchRequest(doc_type="order"), [1, 3]), (SearchRequest(doc_type="order*"), [1, 3, 4]), (SearchRequest(doc_type="order_?"), [4]), (SearchRequest(case_number="1?-CV-*"), [1, 2]),
        (SearchRequest(legal_tags=["a", "b"]), [1, 2]), (SearchRequest(legal_tags=["a", "b"], legal_tags_match_all=True), [1]), (SearchRequest(status="filed", date_from=datetime(2024, 6, 1)), [4]),
        (SearchRequest(filters={"status": ["filed", "sealed"], "date_range": {"from": datetime(2024, 1, 1)}}), [1, 2, 4]),
    ],
)
def test_requests(docs, request_, want):
    assert ids(docs.where(predicates.compile_request(request_.checked()))) == want


def test_request_bounds():
    r = SearchRequest(size=500, offset=-3, sort_order="up").checked()
    assert (r.size, r.offset, r.sort_order) == (100, 0, "desc") and SearchRequest(size=0).checked().size == 20
    assert SearchRequest(court=["x"], date_to=datetime(2024, 1, 1)).dimensions() == ["court", "date_range"]
    with pytest.raises(ValueError):
        column_of("file_url")


def test_pages_put_together_are_the_sorted_result(docs):
    parts = [r[0] for off in range(0, 4, 2) for r in predicates.page(docs, "created_at", "desc", 2, off).select("doc_id").collect()]
    assert parts == [4, 2, 1, 3]
    got, more = predicates.cursor_page(docs, "doc_id", predicates.encode_cursor(1), 2, 4)
    assert ids(got) == [2, 3] and more["has_more"] and predicates.decode_cursor(more["next_cursor"]) == 3 and predicates.decode_cursor("junk") == 0


def test_facets_count_a_tag_once_a_row(docs):
    assert [tuple(r) for r in facets.terms(docs, "metadata.legal_tags").collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in facets.terms(docs, "doc_type", prefix="ord", exclude=["order"]).collect()] == [("order_x", 1)]
    b = {(r.facet, r.key): r.doc_count for r in facets.bundle(docs, {"doc_type": 1, "legal_tags": 9}).collect()}
    assert b == {("doc_type", "order"): 2, ("legal_tags", "a"): 1, ("legal_tags", "b"): 2}


def test_date_buckets_hold_empty_ones_and_exclude_the_day_itself(docs):
    got = {r.key: r.doc_count for r in facets.date_buckets(docs, "2024-06-30").collect()}
    assert got == {"last_7_days": 0, "last_30_days": 1, "last_90_days": 1, "last_year": 2}


def test_bm25_prefers_more_occurrences_and_skips_null(docs):
    got = [r.doc_id for r in search.bm25(docs, "doc_id", "text", ["motion"], top=5).collect()]
    assert got == [2, 1]
    assert ids(search.all_terms(docs, "motion dismiss", ["text", "subject"])) == [1]
    assert {(r.term, r.match) for r in search.fuzzy_terms(docs, "text", "motoin briew to").collect()} == {("motoin", "motion"), ("briew", "brief"), ("to", "to")}
    assert docs.where("doc_id = 1").select(search.highlight(F.col("text"), ["motion"])).first()[0].count("<mark>motion</mark>") == 1
    assert search.stem("motions") == "motion" and search.stem("granted") == "grant"


def test_re2_boundary_is_ascii(spark):
    df = spark.sql("select 'é12345678 x' as t")
    assert df.select(F.regexp_extract_all("t", F.lit(re2(r"\b\d{8}\b")), F.lit(0))).first()[0] == ["12345678"]


def test_index_changes(spark):
    old = spark.createDataFrame([("a/1", "x", 1), ("b", "y", 2)], "id string, v string, t int")
    new = spark.createDataFrame([("b", "z", 3), ("b", "w", 4), ("c", None, 1)], "id string, v string, t int")
    up = {r.id: r.v for r in index.upsert(old, new, "id", "t").collect()}
    assert up == {"a/1": "x", "b": "w", "c": None}
    assert [r.id for r in index.delete(old, new, "id").collect()] == ["a/1"]
    merged = {r.id: r.v for r in index.merge(old, spark.createDataFrame([("b", None), ("a/1", "n")], "id string, v string"), "id", ["v"]).collect()}
    assert merged == {"a/1": "n", "b": "y"}
    b = index.bulk(spark.createDataFrame([("a", None), ("", "bad"), (None, None), ("c", "bad")], "id string, p string"), "id", F.col("p")).first()
    assert tuple(b) == (1, 1, 2)
    assert old.select(index.safe_id(F.col("id"))).first()[0] == "a_1"


def test_jobs(spark):
    items = spark.createDataFrame([("j", "ok"), ("j", "error"), ("k", "error"), ("k", "skipped")], "job string, outcome string")
    got = {r.job: (r.total, r.status) for r in jobs.progress(items, "job").collect()}
    assert got == {"j": (2, "completed"), "k": (2, "failed")}
    delays = [r[0] for r in spark.range(1, 9).select(jobs.backoff(F.col("id"))).collect()]
    assert delays == [5, 10, 20, 40, 80, 160, 300, 300]
    q = spark.createDataFrame([(1, "q", 1, 5), (2, "q", 3, 9), (3, "q", 3, 2), (4, "q", 3, 2)], "id int, q string, p int, c int")
    assert [r.id for r in jobs.queue_order(q, "q", "p", "c", "id").orderBy("place").collect()] == [3, 4, 2, 1]


def test_metrics(spark):
    p = spark.createDataFrame([(1, "m", 1, 10.0), (2, "m", 2, 20.0), (3, "m", 3, 0.0)], "id int, name string, ts int, value double")
    assert metrics.moving_average(p, "name", "ts", "value", "id").first().ema == 7.5
    e = spark.createDataFrame([(i, "x", i, ok) for i, ok in enumerate([True, False, False, True, False])], "id int, k string, ts int, ok boolean")
    got = [(r.failures, r.open) for r in metrics.breaker(e, "k", "ts", "id", 2).orderBy("id").collect()]
    assert got == [(0, False), (1, False), (2, True), (0, False), (1, False)]
