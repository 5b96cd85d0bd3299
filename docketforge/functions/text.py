"""Cleaning and measuring of extracted text, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import re2

#: Extensions of documents whose paths are printed into texts.
_EXT = "(?:txt|pdf|doc|docx|rtf|html?)"
_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: Printed paths, attributes of tags and drive paths.
PATH_WITH_TIME = rf"(?i)^(?:data/)*[^/\s]+\.{_EXT}{_DAY}\s+{_MONTH}\s+\d{{1,2}}\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s+\d{{4}}"
PATH_NESTED = rf"(?i)^(?:data/){{2,}}[^/\s]+\.{_EXT}"
PATH_AT_START = rf"(?i)^[^/\s]*(?:/[^/\s]*)*\.{_EXT}\s*"
#: Entities and what they stand for; &amp; comes last so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "..."), ("&amp;", "&"),
]
ATTRIBUTES = r"\b(?:bgcolor|color|style|class|id|width|height|font|size|face)=\w+"
#: What printers leave in texts.
PRINTER_LITERALS = ["HP LaserJet", "HPLASIII.PRS", "(HP Roman 8)", "(Port)", "(FW)", "Swiss Roman 11pt", "Swiss Bold 11pt"]
PRINTER_PATTERNS = [r"\^4<[^>]*>", r"\\[0-9]{4}[a-zA-Z]*", r"[\\^][<>|,()@'hdxlXtP]{5,}", r"\\t'[a-zA-Z@0-9<>]{3,}", r"[\\^@|<>'()]{8,}", r"\\x[0-9a-fA-F]{2}"]
DRIVE_PATTERNS = [r'[A-Z]:\\[^\\/:*?"<>|\r\n\s]*(?:\\[^\\/:*?"<>|\r\n\s]*)*', r"\\\\[^\s\\]+(?:\\[^\s\\]+)*", r"\\{3,}"]
#: Frequent English words.
ENGLISH = "the and or of to in a is that for with as on by at from this be are was were an it not have has had".split()


def _sub(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, re2(pattern), by)


#: White space of any script at either end.
ENDS = r"^[\t\n\x0B\f\r\p{Zs}]+|[\t\n\x0B\f\r\p{Zs}]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def drop_path_lines(text: Column) -> Column:
    """Without lines that are printed paths; a bare file name counts on the first three lines only. Lines are trimmed."""
    bare = F.transform(_lines(text), trimmed)
    keep = F.filter(bare, lambda x, i: ~(x.rlike(re2(PATH_WITH_TIME)) | x.rlike(re2(PATH_NESTED)) | ((i < 3) & x.rlike(re2(PATH_AT_START)))))
    return F.array_join(keep, "\n")


def strip_html(text: Column) -> Column:
    out = _sub(text, r"<[^>]*>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return _sub(_sub(_sub(out, r"&#\d+;", " "), r"&#x[0-9a-fA-F]+;", " "), ATTRIBUTES, "")


def strip_printer(text: Column) -> Column:
    for literal in PRINTER_LITERALS:
        text = F.replace(text, F.lit(literal), F.lit(""))
    for pattern in PRINTER_PATTERNS:
        text = _sub(text, pattern, " ")
    return text


def is_sequence(line: Column) -> Column:
    """Whether a line begins with five numbers and most of its first ten count up by one (numbers of at most two digits)."""
    numbers = F.slice(F.regexp_extract_all(line, F.lit(r"\d+"), F.lit(0)), 1, 10)
    steps = F.zip_with(F.slice(numbers, 1, 9), F.slice(numbers, 2, 9), lambda a, b: F.when(b.isNull(), F.lit(0)).when((F.length(a) <= 2) & (F.length(b) <= 2) & (F.try_subtract(b.try_cast("int"), a.try_cast("int")) == 1), 1).otherwise(0))
    up = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return line.rlike(re2(r"^\s*(\d+\s+){5,}")) & (F.size(numbers) >= 5) & (up / (F.size(numbers) - 1) > 0.7)


def drop_sequences(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(_lines(text), trimmed), lambda x: ~is_sequence(x)), "\n")


def strip_drives(text: Column) -> Column:
    for pattern in DRIVE_PATTERNS:
        text = _sub(text, pattern, "")
    return text


def collapse(text: Column) -> Column:
    return trimmed(_sub(text, r"\s+", " "))


def clean_text(text: Column, paths: bool = True, html: bool = True, printer: bool = True, sequences: bool = True, drives: bool = True, keep_lines: bool = False) -> Column:
    """The switched-on steps in their fixed order, then white space collapsed (or, with keep_lines, only within lines)."""
    for on, step in ((paths, drop_path_lines), (html, strip_html), (printer, strip_printer), (sequences, drop_sequences), (drives, strip_drives)):
        text = step(text) if on else text
    if keep_lines:
        lines = F.transform(_lines(F.replace(text, F.lit("\r\n"), F.lit("\n"))), lambda x: collapse(x))
        return trimmed(_sub(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    return collapse(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def language(text: Column) -> Column:
    """en if more than a fifth of the first hundred words are frequent English ones, else unknown."""
    words = F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), 1, 100)
    share = F.size(F.filter(words, lambda w: w.isin(*ENGLISH))) / F.nullif(F.size(words), F.lit(0))
    return F.when(share > 0.2, "en").otherwise("unknown")


#: What is taken out of user input beside script and frame blocks.
DANGEROUS = ["vbscript:", "onload=", "onerror=", "<object", "</object>", "<embed", "</embed>"]


def sanitise(text: Column) -> Column:
    """Input without NULs, script and frame blocks, script protocols and other dangerous pieces."""
    text = trimmed(F.replace(text, F.lit("\x00"), F.lit("")))
    for tag in ("script", "iframe"):
        text = F.regexp_replace(text, rf"(?s)<{tag}[^>]*>.*?</{tag}>", "")
        text = F.regexp_replace(text, rf"(?s)<{tag}[^>]*>.*$", "")
        text = F.replace(text, F.lit(f"<{tag}"), F.lit(""))
    text = F.regexp_replace(text, r"javascript:[^ \t\n\r]*", "")
    for piece in DANGEROUS:
        text = F.replace(text, F.lit(piece), F.lit(""))
    return text


def fallback_text(path: Column) -> Column:
    """Text for a document without any, made of its file name."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    low = F.lower(name)
    kind = F.lit("legal document")
    for word, label in (("letter", "correspondence"), ("notice", "notice"), ("complaint", "complaint"), ("brief", "brief"), ("order", "order"), ("motion", "motion")):
        kind = F.when(low.contains(word), label).otherwise(kind)
    return F.concat_ws(" ", F.lit("Document:"), F.regexp_replace(name, "[_-]+", " "), F.lit("Type:"), kind)


def subject_of(summary: Column, words: int = 12) -> Column:
    """The first sentence of a summary, of at most so many words."""
    first = F.split(F.split(summary, r"\. ")[0], " ")
    return F.when(F.size(first) > words, F.concat(F.array_join(F.slice(first, 1, words), " "), F.lit("..."))).otherwise(F.array_join(first, " "))
