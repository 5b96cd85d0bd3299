"""Whole search requests, masking, windows by bytes, queues and reports on small fixtures."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docketforge.functions import redact
from docketforge.operators import facets, index, metrics, predicates, projection, requests, search
from docketforge.operators.predicates import SearchRequest


@pytest.fixture
def docs(spark):
    rows = [
        (1, "the motion to dismiss is denied", "Motion one", "People v. Roe", "filed", datetime(2024, 1, 1), "A. One", "Garcia"),
        (2, "a brief on the motion and the motion", None, None, "sealed", datetime(2024, 6, 1), None, "Smith"),
        (3, None, None, None, None, None, None, None),
        (4, "Übergabe der Motion über die Straße", "x", "y", "filed", datetime(2023, 6, 30), "A. One", None),
        (5, "nothing of that kind", "", "", "filed", datetime(2024, 2, 2), "B. Two", "Garcia"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, subject string, case_name string, status string, created_at timestamp, author string, judge string")


FIELDS = {"text": 2.0, "subject": 1.5, "case_name": 1.5}


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_filters_do_not_change_scores(docs):
    every = {r.doc_id: r.score for r in search.search(docs, SearchRequest(query="motion"), fields=FIELDS).matches.collect()}
    kept = {r.doc_id: r.score for r in search.search(docs, SearchRequest(query="motion", status="filed"), fields=FIELDS).matches.collect()}
    assert set(every) == {1, 2, 4} and kept == {k: every[k] for k in (1, 4)}


def test_a_whole_request(docs):
    found = search.search(docs, SearchRequest(query="motion", size=2, offset=1), fields=FIELDS)
    scores = {r.doc_id: r.score for r in found.matches.collect()}
    best = sorted(scores, key=lambda k: (-scores[k], k))
    assert found.total == 3 and found.max_score == max(scores.values()) and sorted(ids(found.page)) == sorted(best[1:3])
    by_date = search.search(docs, SearchRequest(query="motion", sort_by="created_at", sort_order="asc", size=2), fields=FIELDS)
    assert ids(by_date.page) == [4, 1]
    marks = {r.doc_id: r.highlights for r in search.search(docs, SearchRequest(query="motion dismiss"), fields=FIELDS).page.collect()}
    assert marks[1].text == ["the <mark>motion</mark> to <mark>dismiss</mark> is denied"] and marks[1].subject == ["<mark>Motion</mark> one"] and marks[2].subject is None
    nothing = search.search(docs, SearchRequest(query="absent"), fields=FIELDS)
    assert nothing.total == 0 and nothing.max_score is None and nothing.page.count() == 0
    empty = search.search(docs.where("false"), SearchRequest(query="motion"), fields=FIELDS)
    assert empty.total == 0


def test_without_query_all_match_with_score_one(docs):
    found = search.search(docs, SearchRequest(judge=["Garcia"]), fields=FIELDS)
    assert found.total == 2 and found.max_score == 1.0 and sorted(ids(found.page)) == [1, 5]
    assert ids(search.search(docs, SearchRequest(author="A. One", date_from=datetime(2024, 1, 1)), fields=FIELDS).page) == [1]


def test_fuzzy_and_words_of_any_script(docs):
    assert sorted(ids(search.search(docs, SearchRequest(query="motoin", fuzzy_search=True), fields=FIELDS).matches)) == [1, 2, 4]
    assert ids(search.search(docs, SearchRequest(query="ÜBERGABE straße"), fields=FIELDS).matches) == [4]
    assert ids(search.search(docs, SearchRequest(query="bergabe"), fields=FIELDS).matches) == []


def test_long_lists_are_joined(docs, monkeypatch):
    short = sorted(ids(predicates.where_in(docs, "status", ["filed", "sealed"])))
    monkeypatch.setattr(predicates, "LONG_LIST", 1)
    assert sorted(ids(predicates.where_in(docs, "status", ["filed", "sealed", "filed"]))) == short == [1, 2, 4, 5]


def test_masks_have_the_length_of_what_they_hide(spark):
    t = "call 555-123-4567, é123-45-6789 or a.b@example.com; $1,234.50 and 01/02/1990"
    got = spark.createDataFrame([(t,), ("",), (None,), ("no hit",)], "t string").select(redact.masked(F.col("t")).alias("m")).collect()
    assert got[0].m.startswith("call ■■■■■■■■■■■■, é■") and len(got[0].m) == len(t) and got[1].m == "" and got[2].m is None and got[3].m == "no hit"
    items = "array(struct(0 as start, 2 as end), struct(1 as start, 3 as end), struct(50 as start, 60 as end))"
    assert spark.sql("select 'éxyz' as t").select(redact.redacted(F.col("t"), F.expr(items))).first()[0] == "■■■■z"
    assert spark.sql("select 'éxyz' as t").select(redact.redacted(F.col("t"), F.expr("cast(array() as array<struct<start: int, end: int>>)"))).first()[0] == "éxyz"


def test_windows_and_prompts_count_bytes(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé日𝒳 ") for _ in range(n)) for n in (0, 3, 166, 400, 900, 2500)]
    df = spark.createDataFrame([(t, 37) for t in texts], "t string, n int")
    got = df.select("t", projection.window(F.col("t")).alias("w"), projection.window_bytes(F.col("t")).alias("b"), projection.prompt(F.col("t"), F.lit("f"), F.lit(1), F.col("n")).alias("p")).collect()
    for r in got:
        raw = r.t.encode()
        if len(raw) <= 500:
            assert r.w == r.t and bytes(r.b) == raw
        else:
            start = next(i for i in range(500, 504) if raw[i] & 0xC0 != 0x80)
            assert bytes(r.b) == raw[500:1500] and r.w == raw[start : start + 1000].decode("utf-8", "ignore")
        shown = r.p.split("Text:\n")[1]
        assert shown == (r.t if len(raw) <= 37 else raw[:37].decode("utf-8", "ignore") + "...")


def test_upsert_keeps_old_rows_of_other_keys(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 9)], "id string, v string, t int")
    new = spark.createDataFrame([("b", "z", 3), ("b", "w", None), ("c", None, 1)], "id string, v string, t int")
    assert {r.id: r.v for r in index.upsert(old, new, "id", "t").collect()} == {"a": "x", "b": "z", "c": None}
    assert index.upsert(old, new.where("false"), "id", "t").count() == 2


def test_moving_average_equals_the_recursion(spark):
    rng = random.Random(1)
    rows = [(i, m, i, rng.random() * 100) for m, n in (("one", 1), ("few", 5), ("many", 500)) for i in range(n)]
    got = {r.name: r.ema for r in metrics.moving_average(spark.createDataFrame(rows, "id int, name string, ts int, value double"), "name", "ts", "value", "id").collect()}
    for m in got:
        avg = None
        for _, _, _, x in (r for r in rows if r[1] == m):
            avg = x if avg is None else (avg + x) / 2
        assert got[m] == pytest.approx(avg, abs=1e-6)


def test_queue_capacity_and_changes(spark):
    items = spark.createDataFrame([(i, "q" if i < 6 else "r", 10 - i, i % 2) for i in range(9)], "id int, q string, created int, priority int")
    got = {r.id: r.accepted for r in requests.admitted(items, "q", "created", "id", {"q": 2}, 100).collect()}
    assert [i for i, ok in got.items() if i < 6 and ok] == [4, 5] and all(got[i] for i in (6, 7, 8))
    changed = requests.changed(items, "id", items.where("id = 0"), spark.createDataFrame([(1, 9), (77, 9)], "id int, priority int"))
    assert {r.id: r.priority for r in changed.collect()}[1] == 9 and changed.count() == 8


def test_combined_aggregation_drops_unknown_names(docs):
    docs = docs.withColumn("document_type", F.col("status")).withColumn("category", F.lit(None).cast("string")).withColumn("court", F.lit("c"))
    got = {(r.facet, r.key): r.doc_count for r in facets.combined(docs, ["judges", "nonsense", "date_ranges"], "2024-06-30").collect()}
    assert got["judges", "Garcia"] == 2 and got["date_ranges", "last_30_days"] == 1 and {f for f, _ in got} == {"judges", "date_ranges"}
    assert facets.combined(docs, None, "2024-06-30").count() == 0
    j = json.dumps({"buckets": [{"key": "a", "doc_count": 2}, {"key": None, "doc_count": 1}, {"key": "b"}]})
    df = docs.limit(1).select(facets.parsed_buckets(F.lit(j)).alias("b"), facets.parsed_buckets(F.lit("junk")).alias("n"))
    assert [tuple(x) for x in df.first().b] == [("a", 2)] and df.first().n == []
