"""Deterministic classification by words and measures of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules in order; each is alternatives of words that must all occur.
TYPE_RULES = [
    ("motion_to_suppress", [["motion", "suppress"]]), ("motion_to_dismiss", [["motion", "dismiss"]]), ("motion_to_compel", [["motion", "compel"]]), ("motion_in_limine", [["motion", "limine"]]),
    ("motion_summary_judgment", [["motion", "summary"]]), ("motion_to_suppress", [["motion"]]), ("order", [["order", "court"]]), ("ruling", [["ruling"]]), ("judgment", [["judgment"]]),
    ("brief", [["brief"], ["memorandum"]]), ("complaint", [["complaint"], ["plaintiff"]]), ("answer", [["answer", "defendant"]]), ("plea", [["plea"]]), ("notice", [["notice"]]),
    ("correspondence", [["letter"], ["correspondence"]]),
]
CATEGORY_RULES = [
    ("Criminal Law", [["criminal"], ["prosecution"]]), ("Contract Law", [["contract"], ["breach"]]), ("Family Law", [["family"], ["divorce"], ["custody"]]), ("Property Law", [["property"], ["real estate"]]),
    ("Employment Law", [["employment"], ["workplace"]]), ("Intellectual Property", [["intellectual property"], ["patent"], ["trademark"]]), ("Tax Law", [["tax"], ["irs"]]),
    ("Bankruptcy", [["bankruptcy"], ["chapter 7"], ["chapter 11"]]), ("Personal Injury", [["personal injury"], ["negligence"]]),
]
SUBCATEGORIES = {"Criminal Law": "Felony", "Contract Law": "Commercial", "Family Law": "Divorce", "Property Law": "Commercial Real Estate", "Employment Law": "Wrongful Termination"}
CONFIDENCE_TERMS = ["court", "plaintiff", "defendant", "motion", "order", "contract"]
KEYWORDS = [
    "plaintiff", "defendant", "court", "judge", "jury", "motion", "order", "contract", "agreement", "breach", "damages", "liability", "negligence", "evidence", "discovery", "deposition", "trial", "settlement", "appeal",
]
TYPE_TAGS = [
    (["motion_to_suppress", "motion_to_dismiss", "motion_to_compel", "motion_in_limine"], ["Pre-Trial", "Motion Practice"]), (["order"], ["Court Order", "Judicial Decision"]),
    (["brief"], ["Legal Argument", "Case Law"]), (["complaint", "answer"], ["Pleadings", "Case Initiation"]),
]
CATEGORY_TAGS = [("Criminal Law", ["Criminal Procedure", "Constitutional Law"]), ("Contract Law", ["Commercial Law", "Business Disputes"]), ("Family Law", ["Domestic Relations", "Child Custody"])]
MOTIONS = ["motion_to_suppress", "motion_to_dismiss", "motion_to_compel", "motion_in_limine", "motion_summary_judgment", "motion_to_strike", "motion_for_reconsideration", "motion_to_amend", "motion_for_continuance"]
ORDERS = ["order", "ruling", "judgment", "sentence", "injunction"]
PLEADINGS = ["brief", "complaint", "answer", "plea", "reply"]
OTHERS = ["docket_entry", "notice", "stipulation", "correspondence", "transcript", "evidence", "other", "unknown"]
#: Error codes by words of the message, in order, and those after which another provider is tried.
ERROR_RULES = [
    ("QUOTA_EXCEEDED", ["quota", "billing"]), ("RATE_LIMIT", ["rate limit", "status 429"]), ("API_AUTH_ERROR", ["status 401", "unauthorized"]), ("API_SERVER_ERROR", ["status 5", "server error"]),
    ("TIMEOUT", ["timeout", "context deadline exceeded"]), ("NETWORK_ERROR", ["connection", "network"]), ("API_BAD_REQUEST", ["status 400", "bad request"]), ("RESPONSE_PARSE_ERROR", ["json", "unmarshal"]),
]


def _rule(low: Column, ways: list[list[str]]) -> Column:
    hit = F.lit(False)
    for words in ways:
        one = F.lit(True)
        for w in words:
            one = one & low.contains(w)
        hit = hit | one
    return hit


def _cascade(low: Column, rules, otherwise: Column) -> Column:
    out = otherwise
    for label, ways in reversed(rules):
        out = F.when(_rule(low, ways), label).otherwise(out)
    return out


def type_by_size(words: Column, pages: Column) -> Column:
    return F.when(words < 200, "notice").when(words < 500, "correspondence").when(words > 5000, "brief").when((pages == 1) & (words < 1000), "order").when(pages > 10, "brief").otherwise("other")


def document_type(text: Column, words: Column, pages: Column) -> Column:
    return _cascade(F.lower(text), TYPE_RULES, type_by_size(words, pages))


def legal_category(text: Column) -> Column:
    return _cascade(F.lower(text), CATEGORY_RULES, F.lit("Civil Law"))


def sub_category(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SUBCATEGORIES.items() for x in kv])[category], F.lit(""))


def confidence(text: Column, words: Column, pages: Column) -> Column:
    low = F.lower(text)
    size = F.octet_length(text)
    base = F.lit(0.7) + F.when(size > 1000, 0.1).otherwise(0.0) + F.when(size > 5000, 0.1).otherwise(0.0)
    for t in CONFIDENCE_TERMS:
        base = base + F.when(low.contains(t), 0.05).otherwise(0.0)
    c = F.least(base, F.lit(0.95)) + F.when((words > 0) & (pages > 0), 0.05).otherwise(0.0) - F.when((words < 100) | (words > 20000), 0.1).otherwise(0.0)
    return F.greatest(F.least(c, F.lit(0.95)), F.lit(0.3))


def keywords(text: Column, most: int = 10) -> Column:
    low = F.lower(text)
    return F.slice(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in KEYWORDS])), 1, most)


def legal_tags(doc_type: Column, category: Column) -> Column:
    parts = [F.when(doc_type.isin(*types), F.array(*map(F.lit, tags))) for types, tags in TYPE_TAGS] + [F.when(category == c, F.array(*map(F.lit, tags))) for c, tags in CATEGORY_TAGS]
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def type_group(doc_type: Column) -> Column:
    return F.when(doc_type.isin(*MOTIONS), "motion").when(doc_type.isin(*ORDERS), "order").when(doc_type.isin(*PLEADINGS), "pleading").otherwise("administrative")


def known_type(doc_type: Column) -> Column:
    """The type itself if it is one, else unknown."""
    return F.when(doc_type.isin(*MOTIONS, *ORDERS, *PLEADINGS, *OTHERS), doc_type).otherwise("unknown")


def error_code(message: Column) -> Column:
    return F.when(message.isNull(), "unknown").otherwise(_cascade(F.lower(message), [(c, [[w] for w in words]) for c, words in ERROR_RULES], F.lit("UNKNOWN_ERROR")))


def tries_next(code: Column) -> Column:
    return ~code.isin("API_AUTH_ERROR", "API_BAD_REQUEST")
