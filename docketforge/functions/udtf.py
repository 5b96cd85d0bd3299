"""Table functions for SQL: redactions(text) gives a row a hit."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .redact import PATTERNS


@udtf(returnType="item_no int, pii_type string, hit string, legal_code string")
class Redactions:
    def __init__(self):
        self.patterns = [(n, re.compile(p, re.ASCII), c) for n, p, c in PATTERNS]

    def eval(self, text: str):
        no = 0
        for name, pattern, code in self.patterns:
            for m in pattern.finditer(text or ""):
                no += 1
                yield no, name, m.group(), code


def register(spark: SparkSession) -> None:
    """SELECT d.doc_id, r.* FROM documents d, LATERAL redactions(d.text) r"""
    spark.udtf.register("redactions", Redactions)
