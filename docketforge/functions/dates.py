"""Dates in legal text: finding, parsing and judging them. as_of stands for the present day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import re2

#: Layouts of full and of partial dates, in the order in which they are tried.
FULL = [
    ("yyyy-MM-dd", r"\d{4}-\d{2}-\d{2}"), ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("MMMM d, yyyy", r"[A-Za-z]{3,9} \d{1,2}, \d{4}"), ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("d MMMM yyyy", r"\d{1,2} [A-Za-z]{3,9} \d{4}"),
    ("d-MMM-yyyy", r"\d{1,2}-[A-Za-z]{3}-\d{4}"), ("yyyy/MM/dd", r"\d{4}/\d{2}/\d{2}"), ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"), ("M-d-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
]
PARTIAL = [("MMMM yyyy", r"[A-Za-z]{3,9} \d{4}"), ("MMM yyyy", r"[A-Za-z]{3} \d{4}"), ("M/yyyy", r"\d{1,2}/\d{4}"), ("yyyy-MM", r"\d{4}-\d{2}"), ("yyyy/MM", r"\d{4}/\d{2}")]
#: What announces each kind of date.
CONTEXT = {
    "filing_date": r"(?i)(?:filed|filing|file date|date filed)(?:\s+on)?\s*:?\s*([^,\n\r;]+)",
    "event_date": r"(?i)(?:on or about|incident|occurred|violation|event)(?:\s+on)?\s*:?\s*([^,\n\r;]+)",
    "hearing_date": r"(?i)(?:hearing|scheduled|arraignment|calendar)(?:\s+(?:set|on|for))?\s*:?\s*([^,\n\r;]+)",
    "decision_date": r"(?i)(?:decided|ruling|ordered|judgment|entered)(?:\s+on)?\s*:?\s*([^,\n\r;]+)",
    "served_date": r"(?i)(?:served|service)(?:\s+on)?\s*:?\s*([^,\n\r;]+)",
}
#: How ranges of dates are written.
RANGE_DAYS = r"(?i)(?:from\s+)?(\w+)\s+(\d{1,2})\s*[-–—]\s*(\d{1,2}),?\s+(\d{4})"
RANGE_SLASH = r"(?i)(\d{1,2}/\d{1,2}/\d{4})\s+(?:to|through|thru)\s+(\d{1,2}/\d{1,2}/\d{4})"


def cleaned(s: Column) -> Column:
    s = F.regexp_replace(s, re2(r"(?i)^(?:on\s+|at\s+|the\s+)"), "")
    s = F.regexp_replace(s, re2(r"(?i)\s+(?:at\s+.*|,\s+at\s+.*)$"), "")
    s = F.regexp_replace(s, re2(r"\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?"), "")
    return F.regexp_replace(F.trim(s), re2(r"\s+"), " ")


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _first(s: Column, layouts) -> Column:
    return F.coalesce(*[F.when(s.rlike(f"^{shape}$"), F.try_to_date(s, layout)) for layout, shape in layouts])


def full_date(s: Column) -> Column:
    return _first(s, FULL)


def partial_date(s: Column) -> Column:
    """The first day of the month."""
    return _first(s, PARTIAL)


def relative_date(s: Column, as_of: Column) -> Column:
    low = F.lower(s)
    return (
        F.when(low.contains("today"), as_of).when(low.contains("tomorrow"), F.date_add(as_of, 1)).when(low.contains("yesterday"), F.date_sub(as_of, 1))
        .when(low.contains("next week"), F.date_add(as_of, 7)).when(low.contains("last week"), F.date_sub(as_of, 7)).when(low.contains("next month"), F.add_months(as_of, 1))
    )


def valid(d: Column, kind: str, as_of: Column) -> Column:
    """Whether a date is plausible for its kind."""
    years = (F.year(d) >= 1950) & (F.year(d) <= F.year(as_of) + 10)
    more = {
        "filing_date": d < F.date_add(as_of, 1), "served_date": d < F.date_add(as_of, 1), "event_date": (d > F.lit("1950-01-01").cast("date")) & (d < F.add_months(as_of, 120)),
        "hearing_date": (d > F.date_sub(as_of, 30)) & (d < F.add_months(as_of, 60)), "decision_date": d < F.date_add(as_of, 30),
    }.get(kind, F.lit(True))
    return years & more


def parse_date(s: Column, kind: str, as_of: Column) -> Column:
    """The first of full, partial and relative readings that is plausible."""
    ways = [full_date, partial_date, lambda c: relative_date(c, as_of)]
    return let(cleaned(s), lambda c: F.coalesce(*[let(way(c), lambda t: F.when(valid(t, kind, as_of), t)) for way in ways]))


def extract_date(text: Column, kind: str, as_of: Column) -> Column:
    """The date after the first announcement of its kind; the capture ends at a comma, as it does for requests."""
    found = F.nullif(F.trim(F.regexp_extract(text, re2(CONTEXT[kind]), 1)), F.lit(""))
    return let(found, lambda f: F.when(f.isNotNull(), parse_date(f, kind, as_of)))


def date_ranges(text: Column, as_of: Column) -> Column:
    """array<struct<start, end>> of all date ranges."""
    take = lambda p, g: F.regexp_extract_all(text, F.lit(re2(p)), F.lit(g))
    day = lambda m, d, y: parse_date(F.concat(m, F.lit(" "), d, F.lit(", "), y), "event_date", as_of)
    at = lambda g, i: F.get(take(RANGE_DAYS, g), i)
    days = F.transform(take(RANGE_DAYS, 1), lambda m, i: F.struct(day(m, at(2, i), at(4, i)).alias("start"), day(m, at(3, i), at(4, i)).alias("end")))
    one = lambda x: parse_date(x, "event_date", as_of)
    slash = F.transform(take(RANGE_SLASH, 1), lambda a, i: F.struct(one(a).alias("start"), one(F.get(take(RANGE_SLASH, 2), i)).alias("end")))
    return F.filter(F.concat(days, slash), lambda r: r["start"].isNotNull() & r["end"].isNotNull())


def range_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("trial"), "trial_dates").when(low.contains("hearing"), "hearing_period").when(low.contains("conference"), "conference_period").when(low.contains("deposition"), "deposition_period").otherwise("event_period")
