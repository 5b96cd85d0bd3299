"""Checks of requests, files and metadata: what is wrong, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sanitise

#: Categories that a request may name, and extensions that may be uploaded or never.
CATEGORIES = ["criminal law", "civil law", "contract law", "family law", "property law", "employment law", "intellectual property", "tax law", "bankruptcy", "personal injury"]
UPLOADS = ["pdf", "docx", "doc", "txt", "rtf"]
NAME_PIECES = ["..", "/", "\\", ":", "*", "?", '"', "<", ">", "|"]
MAX_UPLOAD = 100 * 1024 * 1024


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def index_error(doc_id: Column, text: Column, doc_type: Column, category: Column, file_name: Column, hash_: Column, created: Column, updated: Column) -> Column:
    """The first field that an index request lacks."""
    needed = {"document_id": doc_id.cast("string"), "text": text, "document_type": doc_type, "legal_category": category, "file_name": file_name, "hash": hash_}
    out = F.when(created.isNull(), "created_at").when(updated.isNull(), "updated_at")
    for name, col in reversed(list(needed.items())):
        out = F.when(_blank(col), name).otherwise(out)
    return out


def upload_error(name: Column, size: Column, least: int = 1, most: int = MAX_UPLOAD) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(size < least, "too_small").when(size > most, "too_large").when(~ext.isin(*UPLOADS), "extension").when(name.contains("..") | name.contains("\x00"), "name")


def name_error(name: Column) -> Column:
    out = F.when(F.octet_length(name) > 255, "too_long")
    for piece in reversed(NAME_PIECES):
        out = F.when(name.contains(piece), f"has {piece}").otherwise(out)
    return F.when(_blank(name), "empty").otherwise(out)


def size_error(size: Column, most: int) -> Column:
    return F.when(size <= 0, "empty").when(size > most, "too_large")


def metadata_ok(meta: Column) -> Column:
    """At most 50 keys of 1..100 bytes with values of at most 1000, none changed by sanitising."""
    fine = lambda e: (F.octet_length(e["key"]).between(1, 100)) & (F.octet_length(e["value"]) <= 1000) & (sanitise(e["key"]) == e["key"]) & (sanitise(e["value"]) == e["value"])
    return F.coalesce((F.size(meta) <= 50) & F.forall(F.map_entries(meta), fine), F.lit(True))


def known_category(category: Column) -> Column:
    return F.lower(category).isin(*CATEGORIES)


def result_error(confidence: Column, doc_type: Column, category: Column) -> Column:
    return F.when(~confidence.between(0, 1) | confidence.isNull(), "confidence").when(_blank(doc_type), "document_type").when(_blank(category), "legal_category")
