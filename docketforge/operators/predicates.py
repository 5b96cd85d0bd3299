"""Search requests and the predicates they compile to."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MULTI_VALUED, column_of


@dataclass
class SearchRequest:
    query: str = ""
    doc_type: str | None = None
    case_number: str | None = None
    case_name: str | None = None
    author: str | None = None
    status: str | None = None
    judge: list[str] = field(default_factory=list)
    court: list[str] = field(default_factory=list)
    legal_tags: list[str] = field(default_factory=list)
    legal_tags_match_all: bool = False
    date_from: datetime | None = None
    date_to: datetime | None = None
    size: int = 20
    offset: int = 0
    sort_by: str = "relevance"
    sort_order: str = "desc"
    include_highlights: bool = True
    fuzzy_search: bool = False
    filters: dict = field(default_factory=dict)

    def checked(self) -> SearchRequest:
        """Sizes and order within their bounds: size 1..100 (else 20 or 100), offset from 0, order asc or desc."""
        self.size = 20 if self.size <= 0 else min(self.size, 100)
        self.offset = max(self.offset, 0)
        self.sort_order = self.sort_order if self.sort_order in ("asc", "desc") else "desc"
        return self

    def dimensions(self) -> list[str]:
        """The filters that are set."""
        names = ("doc_type", "case_number", "case_name", "author", "status", "judge", "court", "legal_tags")
        out = [n for n in names if getattr(self, n)]
        return out + (["date_range"] if self.date_from or self.date_to else [])


def like_pattern(value: str) -> str:
    """A wildcard value (* any run, ? one character) as a LIKE pattern."""
    escaped = re.sub(r"([\\%_])", r"\\\1", value)
    return escaped.replace("*", "%").replace("?", "_")


def term(name: str, value) -> Column:
    """Exact equality; for fields of many values containment; * and ? are wildcards."""
    col = column_of(name)
    many = col in MULTI_VALUED
    if isinstance(value, (list, tuple)):
        if many:
            return F.arrays_overlap(col, F.array(*map(F.lit, value)))
        return F.col(col).isin(*value)
    if isinstance(value, str) and re.search(r"[*?]", value):
        pattern = like_pattern(value)
        return F.exists(col, lambda x: x.like(pattern)) if many else F.col(col).like(pattern)
    return F.array_contains(col, value) if many else F.col(col) == F.lit(value)


def all_of(name: str, values: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, values)), column_of(name))) == 0


def date_range(name: str, start: datetime | None, end: datetime | None) -> Column:
    """Both ends inclusive, either may be missing."""
    col = F.col(column_of(name))
    parts = ([col >= F.lit(start)] if start else []) + ([col <= F.lit(end)] if end else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def range_of(name: str, start: str | None, end: str | None) -> Column:
    """A range of any field by the bounds as they are written, both inclusive."""
    col = F.col(column_of(name))
    parts = ([col >= F.lit(start)] if start else []) + ([col <= F.lit(end)] if end else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


#: Values of a list from which it is joined instead of written into the predicate.
LONG_LIST = 1000


def where_in(df: DataFrame, name: str, values: list) -> DataFrame:
    """Rows whose value (or one of whose values) is in a list; a long list becomes a semi join."""
    if len(values) <= LONG_LIST:
        return df.where(term(name, list(values)))
    col = column_of(name)
    kind = df.schema[col].dataType
    many = col in MULTI_VALUED
    wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"__v {(kind.elementType if many else kind).simpleString()}")
    if many:
        return df.join(wanted, F.array_contains(F.col(col), F.col("__v")), "left_semi")
    return df.join(wanted, F.col(col) == F.col("__v"), "left_semi")


def valid_range(start: Column, end: Column) -> Column:
    """Whether a range is none or runs forward: an open side is always fine."""
    return F.coalesce(start <= end, F.lit(True))


def empty_range(start: Column, end: Column) -> Column:
    return start.isNull() & end.isNull()


def in_range(value: Column, start: Column, end: Column) -> Column:
    """Whether a value lies in a range, ends included; an open side never excludes, a null value is in no range."""
    return value.isNotNull() & F.coalesce(value >= start, F.lit(True)) & F.coalesce(value <= end, F.lit(True))


def compile_request(r: SearchRequest) -> Column:
    """All filters of a request, and'ed."""
    parts: list[Column] = []
    for name in ("doc_type", "case_number", "case_name", "author", "status", "judge", "court"):
        value = getattr(r, name)
        if value:
            parts.append(term(name, value))
    if r.legal_tags:
        parts.append(all_of("legal_tags", r.legal_tags) if r.legal_tags_match_all else term("legal_tags", r.legal_tags))
    if r.date_from or r.date_to:
        parts.append(date_range("created_at", r.date_from, r.date_to))
    parts += [custom_filter(k, v) for k, v in r.filters.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def custom_filter(name: str, value) -> Column:
    """A facet filter: string, list, or a date range that counts only with both ends."""
    if isinstance(value, dict):
        if "from" in value and "to" in value:
            return date_range("created_at", value["from"], value["to"])
        return F.lit(True)
    return term(name, value)


def page(df: DataFrame, sort_by: str, order: str, size: int, offset: int, key: str = "doc_id") -> DataFrame:
    """One page in a total order: nulls last, ties by key."""
    col = F.col(column_of(sort_by))
    return df.orderBy(col.asc_nulls_last() if order == "asc" else col.desc_nulls_last(), F.col(key).asc()).offset(offset).limit(size)


def encode_cursor(index: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"index": index}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> int:
    if not cursor:
        return 0
    try:
        return max(0, int(json.loads(base64.urlsafe_b64decode(cursor))["index"]))
    except (ValueError, KeyError, TypeError):
        return 0


def cursor_page(df: DataFrame, key: str, cursor: str, limit: int, total: int) -> tuple[DataFrame, dict]:
    """A page of 1..500 rows (else 50) in the order of key, and what the next request needs."""
    limit = limit if 1 <= limit <= 500 else 50
    start = decode_cursor(cursor)
    more = start + limit < total
    return df.orderBy(key).offset(start).limit(limit), {"next_cursor": encode_cursor(start + limit) if more else "", "has_more": more, "total_estimated": total}
