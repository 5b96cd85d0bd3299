"""Pattern redaction: hits, their legal reason, and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regexes import re2

#: Name, pattern and legal code of what is redacted, in order.
PATTERNS = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b", "CCP_1798.3"),
    ("driver_license", r"\b[A-Z]\d{7}\b", "GOV_6254"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "CCPA"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "CCPA"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "CCP_1798.3"),
    ("bank_account", r"\b\d{8,17}\b", "CCP_1798.3"),
    ("date_of_birth", r"\b(0[1-9]|1[0-2])/\d{1,2}/\d{2,4}\b", "GOV_6254"),
    ("financial_statements", r"\$\s*\d{1,3}(,\d{3})*(\.\d{2})?", "CCP_1798.3"),
]


def with_custom(custom: list[str] | None) -> list[tuple[str, str, str]]:
    """The built-in patterns and those of the request that are valid."""
    out = list(PATTERNS)
    for p in custom or []:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(("custom", p, "CUSTOM"))
    return out


def _item(name: str, code: str):
    return lambda h: F.struct(F.lit(name).alias("pii_type"), h.alias("hit"), F.lit(code).alias("legal_code"))


def hits(df: DataFrame, key: str, text: str, custom: list[str] | None = None) -> DataFrame:
    """(key, item_no, pii_type, hit, legal_code): all matches of all patterns in order; overlaps stay."""
    found = [
        F.transform(F.regexp_extract_all(F.col(text), F.lit(re2(p)), F.lit(0)), _item(n, c))
        for n, p, c in with_custom(custom)
    ]
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.concat(*found)).alias("i", "h"))
    return rows.select(key, (F.col("i") + 1).alias("item_no"), "h.pii_type", "h.hit", "h.legal_code")


def _marked(pattern: str, mark: str):
    def one(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        # between the hits stands what a split by them leaves; both are bound once
        both = F.array(F.struct(F.split(t, pattern, -1).alias("parts"), hits.alias("hits")))
        return F.transform(both, lambda b: F.array_join(F.transform(b["parts"], lambda x, i: F.concat(x, F.coalesce(mask_of(F.get(b["hits"], i), mark), F.lit("")))), ""))[0]

    return one


def masked(text: Column, mark: str = "■", custom: list[str] | None = None) -> Column:
    """Every match of the patterns as marks, pattern after pattern; a match gives as many marks as it has bytes."""
    for _, p, _ in with_custom(custom):
        text = F.transform(F.array(text), _marked(re2(p), mark))[0]
    return text


def redacted(text: Column, items: Column, mark: str = "■") -> Column:
    """The text with the given items (array<struct<start int, end int>>, 0-based, end exclusive, in characters) as marks.

    Items outside the text, empty or reversed ones are left out; where items overlap each character is masked once.
    """
    hit = lambda i: F.exists(items, lambda r: (r["start"] <= i) & (i < r["end"]))
    spread_out = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.when(hit(i), F.repeat(F.lit(mark), F.octet_length(c))).otherwise(c))
    return F.when(F.size(items) > 0, F.array_join(spread_out, "")).otherwise(text)


def mask_of(hit: Column, mark: str = "■") -> Column:
    return F.repeat(F.lit(mark), F.octet_length(hit))
