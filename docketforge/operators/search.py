"""Ranked full-text search: analysis, BM25, fuzzy terms and highlights."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..schema import column_of
from ..session import work_dir
from .predicates import SearchRequest, compile_request

K1, B = 1.2, 0.75
#: Fields that a query searches, with their boosts.
FIELDS = {"text": 2.0, "subject": 1.5, "case_name": 1.5, "file_name": 1.0}
#: The stop words of the analyser.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Groups of words that mean the same in a search.
SYNONYMS = [
    ["motion", "petition", "application"], ["defendant", "accused", "respondent"], ["plaintiff", "petitioner", "complainant"], ["attorney", "counsel", "lawyer"],
    ["judge", "court", "magistrate"], ["order", "ruling", "decision"], ["suppress", "exclude", "prohibit"], ["dismiss", "quash", "deny"],
]


#: What a word is: a run of letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"


def tokens(col: Column, stop: bool = False) -> Column:
    """The lower-cased words of a text; null gives none."""
    words = F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))
    words = F.coalesce(words, F.array().cast("array<string>"))
    return F.filter(words, lambda w: ~w.isin(*STOP)) if stop else words


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def _equals(term: str, fuzzy: bool):
    edits = edits_allowed(term) if fuzzy else 0
    if not edits:
        return lambda x: x == term
    # levenshtein with a bound gives -1 beyond it
    return lambda x: (F.abs(F.length(x) - len(term)) <= edits) & (F.levenshtein(x, F.lit(term), edits) >= 0)


def scored(df: DataFrame, key: str, terms: list[str], fields: dict[str, float], kept: Column | None = None, fuzzy: bool = False) -> DataFrame:
    """(key, score) of the kept rows in which a term occurs: the best of the fields' boosted BM25 scores.

    One pass reads the fields and counts the words and the terms in each row. The statistics
    (rows, mean length, document frequencies) are those of all rows of df, kept or not, and are
    observed in the same pass, so that a filter never changes a score. Only the counts of rows
    with a term are written, to the shared folder. With fuzzy a word counts for a term within the
    edits that the term's length allows.
    """
    spark = df.sparkSession
    terms = list(terms)
    empty = f"`{key}` {df.schema[key].dataType.simpleString()}, score double"
    if not terms or not fields:
        return spark.createDataFrame([], empty)
    names = {f: f"f{i}" for i, f in enumerate(fields)}
    count = lambda w: F.struct(F.size(w).alias("dl"), *[F.size(F.filter(w, _equals(t, fuzzy))).alias(f"tf{i}") for i, t in enumerate(terms)])
    counts = F.struct(*[F.transform(F.array(tokens(F.col(f))), count)[0].alias(n) for f, n in names.items()])
    # explode keeps the counts from being made again in each place that uses them
    keep = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    per = df.select(key, keep.alias("kept"), F.explode(F.array(counts)).alias("c")).select(key, "kept", "c.*")
    seen = Observation()
    aggs = []
    for n in names.values():
        aggs += [F.count_if(F.col(f"{n}.dl") > 0).alias(f"{n}_n"), F.sum(f"{n}.dl").alias(f"{n}_len")]
        aggs += [F.count_if(F.col(f"{n}.tf{i}") > 0).alias(f"{n}_df{i}") for i in range(len(terms))]
    any_term = " or ".join(f"{n}.tf{i} > 0" for n in names.values() for i in range(len(terms)))
    hits = per.observe(seen, *aggs).where(f"kept and ({any_term})").select(key, *names.values())
    path = work_dir(spark)
    hits.write.parquet(path)
    s = {k: v or 0 for k, v in seen.get.items()}
    best = []
    for f, n in names.items():
        mean = s[f"{n}_len"] / s[f"{n}_n"] if s[f"{n}_n"] else 1.0
        dl = F.col(f"{n}.dl")
        parts = []
        for i in range(len(terms)):
            tf, df_ = F.col(f"{n}.tf{i}"), s[f"{n}_df{i}"]
            idf = math.log(1 + (s[f"{n}_n"] - df_ + 0.5) / (df_ + 0.5))
            parts.append(F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(mean)))))
        best.append(sum(parts[1:], parts[0]) * fields[f])
    score = F.greatest(*best) if len(best) > 1 else best[0]
    return spark.read.schema(hits.schema).parquet(path).select(key, score.alias("score"))


def bm25(df: DataFrame, key: str, field: str, terms: list[str], top: int | None = None) -> DataFrame:
    """(key, score) of the rows in which a term occurs in one field."""
    out = scored(df, key, terms, {field: 1.0})
    return out.orderBy(F.desc("score"), F.asc(key)).limit(top) if top else out


def best_fields(df: DataFrame, key: str, query: str, fields: dict[str, float] = FIELDS, kept: Column | None = None, fuzzy: bool = False) -> DataFrame:
    """(key, score): the best of the fields' boosted scores."""
    return scored(df, key, query_terms(query), fields, kept, fuzzy)


@dataclass
class Found:
    """What a search gives: all matches, their number, the highest score, and the page asked for with its highlights."""

    matches: DataFrame
    total: int
    max_score: float | None
    page: DataFrame


def search(index: DataFrame, request: SearchRequest, key: str = "doc_id", fields: dict[str, float] = FIELDS) -> Found:
    """A whole request: filters, ranked text (fuzzy if asked for), order, page, highlights, total and highest score.

    Without a query every row that passes the filters matches with score 1. Nulls come last in
    any order and ties go by key. Highlights are made for the rows of the page only.
    """
    r = request.checked()
    kept = compile_request(r)
    terms = query_terms(r.query)
    if terms:
        matches = scored(index, key, terms, fields, kept, r.fuzzy_search)
    else:
        matches = index.where(kept).select(key, F.lit(1.0).alias("score"))
    one = matches.agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
    if r.sort_by in ("relevance", "relevance_score", "_score"):
        order = F.asc("score") if r.sort_order == "asc" else F.desc("score")
        ids = matches.orderBy(order, F.asc(key)).offset(r.offset).limit(r.size)
        rows = ids.join(index, key)
    else:
        col = F.col(column_of(r.sort_by))
        order = col.asc_nulls_last() if r.sort_order == "asc" else col.desc_nulls_last()
        rows = matches.join(index, key).orderBy(order, F.asc(key)).offset(r.offset).limit(r.size)
    if r.include_highlights and terms and not r.fuzzy_search:
        pattern = F.lit(rf"(?i)(?<![^\W_])(?:{'|'.join(map(re.escape, terms))})(?![^\W_])")
        marks = [F.when(F.col(f).isNotNull(), fragments(F.col(f), pattern)).alias(f) for f in ("text", "subject", "case_name") if f in index.columns]
        rows = rows.withColumn("highlights", F.struct(*marks))
    return Found(matches, one.n, one.top, rows)


def all_terms(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows one of whose fields has all terms."""
    want = F.array(*map(F.lit, query_terms(query)))
    hit = F.lit(False)
    for f in fields:
        hit = hit | (F.size(F.array_except(want, tokens(F.col(f)))) == 0)
    return df.where(hit)


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def fuzzy_terms(df: DataFrame, field: str, query: str) -> DataFrame:
    """(term, match): the words of a field within the edits that a term's length allows."""
    words = df.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("match")).distinct()
    hits = F.array_compact(F.array(*[F.when((F.abs(F.length("match") - len(t)) <= edits_allowed(t)) & F.levenshtein(F.col("match"), F.lit(t), edits_allowed(t)).between(0, edits_allowed(t)), F.lit(t)) for t in query_terms(query)]))
    return words.select(F.explode(hits).alias("term"), "match")


def highlight(col: Column, terms: list[str]) -> Column:
    """The text with each term in <mark>."""
    return F.regexp_replace(col, rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, terms))})(?![\p{{L}}\p{{N}}])", "<mark>$1</mark>")


@F.pandas_udf(ArrayType(StringType()))
def fragments(texts: pd.Series, pattern: pd.Series) -> pd.Series:
    """At most three fragments of about 200 characters around the first hits, which are in <mark>."""

    def cut(text, pat):
        if text is None:
            return None
        out, end = [], -1
        rx = re.compile(pat)
        for m in rx.finditer(text):
            if m.start() < end:
                continue
            start = max(0, m.start() - 100)
            end = min(len(text), start + 200)
            out.append(rx.sub(lambda k: f"<mark>{k.group()}</mark>", text[start:end]))
            if len(out) == 3:
                break
        return out

    return pd.Series([cut(t, p) for t, p in zip(texts, pattern)])


_VOWELS = "aeiou"


def stem(word: str) -> str:
    """Suffix stripping after Porter (1980), steps 1a to 1c."""

    def has_vowel(s: str) -> bool:
        return any(c in _VOWELS or (c == "y" and i and s[i - 1] not in _VOWELS) for i, c in enumerate(s))

    def measure(s: str) -> int:
        kinds = "".join("v" if c in _VOWELS or (c == "y" and i and s[i - 1] not in _VOWELS) else "c" for i, c in enumerate(s))
        return len(re.findall("v+c", kinds))

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        if word.endswith(end) and has_vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                return word + "e"
            if len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz":
                return word[:-1]
            break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return word


_CANON = {w: g[0] for g in SYNONYMS for w in g}


@F.pandas_udf(ArrayType(StringType()))
def analyse(words: pd.Series) -> pd.Series:
    """Words after stop words, synonyms and stemming."""
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            known[w] = stem(_CANON.get(w, w))
        return known[w]

    return pd.Series([None if ws is None else [one(w) for w in ws if w not in STOP] for ws in words])
