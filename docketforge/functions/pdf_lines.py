"""What rendering leaves in the text of PDF files: tests of single lines, and the text without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import re2
from .text import collapse, trimmed

#: Words of the file format, of form fields, and of headers and footers.
FORMAT_WORDS = ["endobj", "stream", "endstream", "xref", "trailer", "startxref", "%%eof", "%%page:"]
FORM_WORDS = ["name", "address", "date", "phone", "signature", "title", "city", "state", "zip", "email", "age", "sex", "occupation"]
EDGE_WORDS = ["page ", "of ", "continued", "confidential", "draft", "proprietary", "exhibit ", "attachment ", "schedule ", "case no", "docket", "filed", "clerk", "court"]
EDGE_PATTERNS = [r"(?i)^page\s+\d+", r"(?i)^\d+\s+of\s+\d+$", r"^-\s*\d+\s*-$"]


def _any(col: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | col.contains(w)
    return hit


def _count(line: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(line, f"[^{pattern}]", ""))


def is_format(line: Column) -> Column:
    low = F.lower(line)
    hit = F.lit(False)
    for w in FORMAT_WORDS:
        hit = hit | (low == w) | low.startswith(w + " ")
    return hit


def is_numeric(line: Column) -> Column:
    return line.rlike(r"^[\p{Nd}., -]+$")


def is_repeated(line: Column) -> Column:
    """Mostly layout characters, or half of it one of them."""
    dense = F.regexp_replace(line, r"[ \t]", "")
    share = _count(dense, r".\-_=*+~") / F.nullif(F.length(dense), F.lit(0))
    single = F.lit(False)
    for c in ".-_=*+~":
        n = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        single = single | ((n >= 5) & (F.octet_length(line) > 10) & (n / F.octet_length(dense) > 0.5))
    return (F.octet_length(line) >= 5) & (F.coalesce(share > 0.7, F.lit(False)) | F.coalesce(single, F.lit(False)))


def is_form_field(line: Column) -> Column:
    dots, letters = _count(line, "."), _count(line, r"\p{L}")
    named = _any(F.lower(line), FORM_WORDS) & (dots > letters)
    return (F.octet_length(line) >= 10) & (dots >= 5) & (letters > 0) & (letters < 20) & (named | (line.contains(":") & (dots > 10)))


def is_edge(line: Column) -> Column:
    """A header or footer: page numbers, short dates, document ids, short lines with telling words."""
    hit = F.lit(False)
    for p in EDGE_PATTERNS:
        hit = hit | line.rlike(re2(p))
    date = line.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{4}") & (F.octet_length(line) < 30)
    ident = F.replace(line, F.lit(" "), F.lit("")).rlike(r"^[A-Z0-9-]{8,}$")
    return (F.length(line) > 0) & (hit | date | ident | ((F.octet_length(line) < 50) & _any(F.lower(line), EDGE_WORDS)))


def contents_line(line: Column) -> Column:
    """A line of a table of contents without its dots."""
    title = F.trim(F.regexp_extract(line, r"^(.+?)(\.{5,})(\s*)(\d+)?\s*$", 1))
    number = F.regexp_extract(line, r"^(.+?)(\.{5,})(\s*)(\d+)?\s*$", 4)
    short = F.when(number != "", F.concat(title, F.lit(" (page "), number, F.lit(")"))).otherwise(title)
    return F.when((F.octet_length(title) > 3) & title.rlike(r"[\p{L}\p{Nd}]"), short).otherwise(line)


def is_artifact(line: Column) -> Column:
    bare = (F.octet_length(line) < 3) & ~line.rlike(r"[\p{L}\p{Nd}]")
    return (line != "") & (is_format(line) | is_numeric(line) | bare | is_repeated(line) | is_form_field(line) | is_edge(line))


def without_artifacts(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: ~is_artifact(x))
    return F.array_join(F.transform(lines, contents_line), "\n")


def normalised(text: Column) -> Column:
    """White space collapsed and characters that do not print left out."""
    return trimmed(F.regexp_replace(collapse(text), r"[\p{C}\p{Zl}\p{Zp}]", ""))
