"""Problem 9: template residue, filler, error pages and script notices in place of content.

Character n-gram models of each kind of residue are held against one of the corpus itself.
Windows in which residue is the likelier source mark the places where it stands. Filler and
notices exclude a text by how much of it they cover; a field of a template excludes it when
the marked place proves to be a field left unfilled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

GRAM = 4
SLOTS = 1 << 17
#: The classical filler text, and what people type to fill a page.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea "
    "commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    "semper luctus auctor congue dignissim malesuada faucibus lectus mattis mollis norbit nullam orci porta pulvinar rutrum sollicitudin tempus tellus ultrices vestibulum viverra pellentesque habitant morbi tristique senectus netus "
    "fames turpis egestas curabitur pretium tincidunt lacus gravida blandit accumsan integer vitae justo eget bibendum arcu vivamus suscipit felis donec sagittis vulputate aenean erat volutpat maecenas",
)
LATIN_ENDS = ("um", "us", "is", "it", "at", "em", "or", "o", "a", "ent", "unt", "que", "et", "am", "os", "ur")
TYPED = ("asdf", "qwerty", "jkl;", "blah", "test", "foo bar", "xxx", "abc abc", "lorem")
FILLER_NOUNS = ("text", "placeholder text", "sample text", "dummy text", "filler text", "body text", "body copy", "content", "copy", "paragraph", "placeholder paragraph", "final wording", "final text")
FILLER_PHRASES = ("{n} goes here", "your {n} here", "insert {n} here", "type your {n} here", "{n} to follow", "{n} to come", "{n} to be supplied", "replace with {n}", "replace this {n}", "edit this {n}", "this page is a placeholder", "{n}")
#: What error pages speak of, and what they say of it.
NOTICE_SUBJECTS = ("page", "file", "document", "server", "service", "site", "request", "resource", "system", "database", "gateway", "viewer", "search", "session", "connection", "node", "store", "archive", "index", "shard", "cache", "bucket", "thread pool", "converter")
NOTICE_PREDICATES = (
    "not found", "could not be found", "could not be loaded", "could not be displayed", "could not be located on this server", "failed to load", "timed out", "is not available", "is temporarily unavailable", "is unavailable right now", "is down for maintenance",
    "refused the connection", "rejected the request", "returned no data", "ran out of memory", "is overloaded", "does not exist", "has been moved", "encountered an unexpected error", "has expired", "answered with status 500", "responded with an error",
    "no responde", "no está disponible", "no se encontró", "introuvable", "est momentanément indisponible", "n'est pas disponible", "nicht gefunden", "ist derzeit nicht erreichbar", "nicht verfügbar",
)
#: Status codes with their standard phrases, and other standing phrases of error pages in four languages.
STATUS = (
    "400 bad request", "401 unauthorized", "403 forbidden", "404 not found", "405 method not allowed", "408 request timeout", "410 gone", "429 too many requests", "500 internal server error", "501 not implemented", "502 bad gateway",
    "503 service unavailable", "504 gateway timeout",
)
NOTICE_PHRASES = (
    "page not found", "file not found", "access denied", "permission denied", "too many requests", "an error occurred", "something went wrong", "oops", "sorry", "please try again later", "please contact the administrator", "please contact support", "contact the help desk",
    "return to home page", "go back", "home | search | log in", "loading", "request id", "reference", "incident", "error code", "error", "err", "code", "retry in 30 s", "you must log in to view this page", "your address was blocked", "invalid token", "token is no longer valid",
    "session expired", "caused by: connection reset after 100 ms", "upstream connect error", "traceback (most recent call last)", "exception in thread pool-5: null", "exception in thread main", "exception in worker thread: null", "caused by: null", "null pointer exception", "http 500", "http 404", "http error", "stack trace", "at line", "<h1>", "<noscript>", "content unavailable",
    "página no encontrada", "acceso denegado", "tiempo de espera agotado", "inténtelo de nuevo más tarde", "error al cargar el documento", "page introuvable", "accès refusé", "délai d'attente dépassé", "veuillez réessayer plus tard", "erreur lors du chargement du document", "erreur",
    "seite nicht gefunden", "zugriff verweigert", "zeitüberschreitung", "bitte versuchen sie es später erneut", "fehler beim laden des dokuments", "fehler",
)
#: Parts of notices that scripts are required: a request, what is to be switched on, what for.
ASKING = ("please", "kindly", "you must", "you need to", "this site asks you to", "to continue,", "in order to use this page,")
SWITCHING = ("enable", "activate", "allow", "permit", "turn on", "switch on")
SCRIPTS = ("javascript", "scripts", "scripting", "script execution", "client-side scripting", "js and cookies", "javascript in your browser", "scripting in your browser")
PURPOSES = ("and reload the page", "and try again", "and try once more", "to continue", "to view this page", "to view this document", "in order to read the file", "to run this app", "to pass the browser check", "to use the document viewer", "before the record can be shown")
SCRIPT_PHRASES = (
    "javascript is disabled in your browser", "javascript is required", "scripts are required", "scripts are blocked: content not shown", "this page requires javascript", "your browser does not support javascript", "content unavailable without client-side scripting",
    "veuillez activer javascript pour afficher le document", "les scripts sont bloqués : contenu non affiché", "cette page nécessite javascript", "bitte aktivieren sie javascript, um die seite anzuzeigen", "ohne skripte kann der inhalt nicht dargestellt werden",
    "active javascript para ver la página", "esta página requiere scripts habilitados", "habilite javascript en su navegador",
)
FIELDS = ("case_number", "court_name", "hearing_date", "filing_date", "client_address", "amount_due", "exhibit_no", "party_name", "judge", "firm", "counsel", "defendant", "plaintiff", "date", "name", "address", "title")
#: How templates write a field; {u} upper case with _, {l} lower case with _, {s} in words, {t} words in title case, {c} without spaces.
FIELD_FORMS = (
    "{{{{{l}}}}}", "{{{{ {c} }}}}", "{{{l}}}", "${{{l}}}", "#{{{l}}}", "<%= {l} %>", "%{u}%", "@@{u}@@", "__{u}__", "<<{s}>>", "«{c}»", "[[{c}]]",
    "[insert {s}]", "[enter {s} here]", "[{t} – tbd]", "[{s} to be completed]", "<{s} of record>", "&lt;{u}&gt;", "[●]", "xx/xx/20xx",
)
#: An exact check of a marked place: a field left unfilled.
_IN = r"[A-Za-zÀ-ÿ][\w À-ÿ\s-]{0,40}"
UNFILLED = re.compile(
    rf"\{{\{{\s*{_IN}\}}\}}|[$#]\{{\s*{_IN}\}}|\{{\s*[a-z]+(?:_[a-z]+)*\s*\}}|<%=?\s*{_IN}%>|%[A-Z]+(?:_[A-Z]+)*%|@@\w+@@|__[A-Z]+(?:_[A-Z]+)*__|<<\s*{_IN}>>|«\s*{_IN}»|\[\[\s*{_IN}\]\]"
    rf"|\[\s*(?:INSERT|Insert|insert|ENTER|Enter|enter|TYPE|type|FILL IN|fill in)\s+{_IN}\]|\[{_IN}[–-]\s*TBD\]|\[{_IN}\s(?:to\s+be\s+(?:completed|determined|confirmed|inserted))\]|\[(?:TBD|TBC|●)\]"
    rf"|<\s*[a-z][a-z\s]{{0,40}}\sof\s+record>|&lt;\s*{_IN}&gt;|\bXX/XX/(?:20)?XX(?:XX)?\b"
)
#: Width of the windows in characters and the mean log likelihood ratio a character from which one is marked, by kind.
WINDOWS = {"filler": (24, 0.9), "notice": (12, 0.9), "template": (4, 0.8)}
#: Share of a text, or of its running words, from which residue has taken the place of its content; and running words that a caption beside it may have.
COVERAGE, RUNNING_COVERAGE, CAPTION_WORDS = 0.5, 0.6, 1
#: Characters around a marked place within which the field it belongs to begins and ends.
FIELD_REACH = 60
#: Characters of filler in a row that are no quotation.
FILLER_SPAN = 120

_RUNNING = re.compile(r"\b[a-zà-ÿ]{4,}")
_FOLD = bytes.maketrans(b"123456789\t\n\r\x0b\x0c\xa0", b"000000000      ")


def codes(text: str) -> np.ndarray:
    """Slots of the character n-grams of the lower-cased text, digits being one."""
    raw = text.lower().replace("–", "-").replace("…", "~").replace("●", "\x7f").encode("latin-1", "replace").translate(_FOLD)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.empty(0, np.uint32)
    n = len(b) - GRAM + 1
    h = b[:n].copy()
    for i in range(1, GRAM):
        h *= np.uint32(0x01000193)
        h ^= b[i : n + i]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - 17)


def samples() -> dict[str, list[str]]:
    """The texts that each model of residue is fitted on: made of the parts above by rule, none of them a text of the corpus."""
    rng = np.random.default_rng(9)
    words = " ".join(FILLER).split()
    filler = list(FILLER) + [" ".join(rng.choice(words, 12)) + ". " for _ in range(400)]
    # made-up Latin: beginnings of these words with other endings
    stems = sorted({w[:k] for w in words for k in (3, 4, 5) if len(w) > k})
    filler += [" ".join(rng.choice(stems) + rng.choice(LATIN_ENDS) for _ in range(12)) + ". " for _ in range(600)]
    filler += [f"{w} {w} {w} {w} {w} {w} " for w in TYPED] * 25 + [p.format(n=n) + ". " for p in FILLER_PHRASES for n in FILLER_NOUNS] * 6
    notice = [f"the {s} {p}. " for s in NOTICE_SUBJECTS for p in NOTICE_PREDICATES] + [f"the {a} {b} 12 {p}. " for a, b in zip(NOTICE_SUBJECTS, NOTICE_SUBJECTS[1:]) for p in NOTICE_PREDICATES[::3]] + [f" {p}. " for p in NOTICE_PHRASES] * 8
    notice += [f"{x} - " for x in STATUS] * 6 + [f"{a} {x}. " for x in STATUS for a in ("http", "error", "oops!", "err", "<h1>")] + [f"{w} {n}. " for w in ("error", "err", "code", "fehler", "erreur", "status", "request id", "reference #", "ref") for n in ("404", "500", "1c6e3f", "a68e92ba6")] + [f"<h1>{w} {n} " for w in ("error", "err", "code") for n in ("404", "500")] * 4
    notice += [f"{a} {w} {x} {rng.choice(PURPOSES)}. " for a in ASKING for w in SWITCHING for x in SCRIPTS] + [f"{x}. " for x in SCRIPT_PHRASES] * 12
    field = []
    for f in FIELDS:
        w = f.replace("_", " ")
        form = {"u": f.upper(), "l": f, "s": w, "t": w.title(), "c": w.title().replace(" ", "")}
        field += [" " + x.format(**form) + " " for x in FIELD_FORMS]
    field += [f"{a}[●]{b}" for a in " n s e a l o r t".split(" ") for b in (" ", ", ")] * 4
    return {"filler": filler, "notice": notice, "template": field}


def ratios(prose: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind the log likelihood ratio of every n-gram, clipped so that no single one decides."""
    base = np.log((prose + 0.5) / (prose.sum() + 0.5 * SLOTS))
    out = {}
    for kind, texts in samples().items():
        n = np.zeros(SLOTS)
        for t in texts:
            np.add.at(n, codes(t), 1)
        own = np.log((n + 0.02) / (n.sum() + 0.02 * SLOTS))
        out[kind] = np.clip(own - base, -4.0, 4.0).astype(np.float32)
        out[kind][n == 0] = np.minimum(out[kind][n == 0], -0.5 if kind != "notice" else -0.25)
    return out


def marked(scores: np.ndarray, width: int, least: float) -> np.ndarray | None:
    """Which characters lie in a window whose mean score reaches least; None if there is no such window."""
    n = len(scores)
    width = min(width, n)
    if not n:
        return None
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    hit = np.flatnonzero((total[width:] - total[:-width]) >= least * width)
    if not len(hit):
        return None
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge[:-1]) > 0


def longest_run(mask: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def outside(text: str, mask: np.ndarray) -> str:
    """What a text holds outside the marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([1], mask.astype(np.int8), [1]))))
    parts = [text[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return " ".join([*parts, text[len(mask) :]])


def runs(mask: np.ndarray):
    """(first, last) of the runs of marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def excluded(text: str, mask: np.ndarray, least: int) -> bool:
    """Whether residue has taken the place of content: it covers enough of the text, or of its running words.

    A caption beside it, a heading, a number or a date holds hardly any running words, so the same
    rule serves texts of any length.
    """
    covered = int(mask.sum())
    if covered >= COVERAGE * len(text.strip()):
        return True
    if covered < least:
        return False
    inside = len(_RUNNING.findall(text)) - (left := len(_RUNNING.findall(outside(text, mask))))
    return left <= CAPTION_WORDS or inside >= RUNNING_COVERAGE * (inside + left)


def residue_of(text: str, tables: dict[str, np.ndarray]) -> str:
    """The kind of residue that excludes a text, or ''."""
    if not text.strip():
        return ""
    c = codes(" " + text)  # so that a field at the very beginning has its context; places are one further on
    if not len(c):
        return ""
    hit = marked(tables["template"][c], *WINDOWS["template"])
    if hit is not None:
        # the windows say where a field may stand; each such place is checked, and nothing else
        for a, b in runs(hit):
            for m in UNFILLED.finditer(text, max(0, a - FIELD_REACH), min(len(text), b + FIELD_REACH)):
                if m.start() <= b + GRAM and m.end() >= a - GRAM:
                    return "template"
    filler = marked(tables["filler"][c], *WINDOWS["filler"])
    if filler is not None and (longest_run(filler) >= FILLER_SPAN or excluded(text, filler[1:], 16)):
        return "filler"
    notice = marked(tables["notice"][c], *WINDOWS["notice"])
    if notice is not None and excluded(text, notice[1:], 9):
        return "notice"
    return ""


def prose_counts(texts: DataFrame) -> np.ndarray:
    """How often each n-gram slot occurs in all texts: SLOTS numbers, however large the corpus."""

    def run(batches):
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    n += np.bincount(codes(t), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return out


def residue(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kind) of the documents to be excluded, kind being template, filler or notice.

    Null, empty and blank texts are none; rows that repeat give repeated rows; an empty table
    gives an empty result; extra columns are not looked at. The corpus model counts every text.
    """
    tables = ratios(prose_counts(docs))

    def run(batches):
        for batch in batches:
            ids, kinds = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = residue_of(t, tables) if t else ""
                if kind:
                    ids.append(d)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, kind string")


def without_residue(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no residue, with all their columns; null, empty and blank texts stay."""
    tables = ratios(prose_counts(docs.select(F.col(text).alias("text"))))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not (t and residue_of(t, tables)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(_docs(spark, sf_dir)).select("doc_id").distinct()


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue, filtered in the pass that judges them."""
    return without_residue(_docs(spark, sf_dir))
