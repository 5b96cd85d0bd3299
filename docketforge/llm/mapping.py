"""Problem 1: mapping freely typed values to the entries of a reference list.

An automaton over all canonical names and aliases finds every mention embedded in a value;
the longest mentions that do not overlap win, and a value whose remaining words mean nothing
is mapped to what its mentions agree on. Other values go to token-set similarity: the share
of the two sets of words that is in common, where two words are equal if they differ by one
typing slip or, in court names, if one is a short form of the other. In court names a word
counts the more the fewer entries have it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

#: What people write for the entries of the two short lists, beside the entry itself.
ALIASES = {
    "document_type": {
        "motion_to_suppress": ["mts", "suppression motion", "mot to suppress", "motion for suppression of evidence", "moción de supresión"],
        "motion_to_dismiss": ["mtd", "dismissal motion", "motion for dismissal", "mot to dismiss", "requête en irrecevabilité"],
        "motion_to_compel": ["mtc", "mot compel", "mot to compel", "motion compelling discovery", "motion to compel production"],
        "motion_in_limine": ["mil", "mot in limine", "limine motion", "motion limine evidence", "motion limine"],
        "motion_summary_judgment": ["msj", "mot for summ j", "summary judgment motion", "motion for summary judgment", "motion for summary judgement"],
        "motion_to_strike": ["strike motion", "mot to strike", "motion striking pleading"],
        "motion_for_reconsideration": ["motion to reconsider", "mot for recons", "reconsideration motion"],
        "motion_to_amend": ["motion for leave to amend", "amendment motion", "mot to amend"],
        "motion_for_continuance": ["continuance request motion", "mot for cont", "motion to continue hearing"],
        "order": ["court order", "signed order", "ord", "beschluss"],
        "ruling": ["court ruling", "bench ruling"],
        "judgment": ["final judgment", "judgement", "jdgmt"],
        "sentence": ["sentencing", "sentence imposed", "criminal sentence"],
        "injunction": ["permanent injunction", "preliminary injunction", "injunctive relief", "inj"],
        "brief": ["legal brief", "opening brief", "brief on appeal", "br"],
        "complaint": ["complaint filed", "civil complaint", "verified complaint", "compl"],
        "answer": ["answer to complaint", "defendant s answer", "defendants answer", "ans"],
        "plea": ["guilty plea", "plea entered", "plea form"],
        "reply": ["reply papers", "reply to opposition", "rply"],
        "docket_entry": ["docket line", "docket minute entry", "dkt entry", "dkt ent"],
        "notice": ["notice of hearing", "notice of filing", "ntc"],
        "stipulation": ["joint stipulation", "stipulated agreement", "stip"],
        "correspondence": ["letter", "corresp"],
        "transcript": ["hearing transcript", "deposition transcript", "transcpt", "tr"],
        "evidence": ["item of evidence", "evidence exhibit", "evid"],
        "other": ["other type", "otros", "oth"],
    },
    "legal_category": {
        "Criminal Law": ["crim", "crim law", "criminal", "strafrecht", "derecho penal"],
        "Civil Law": ["civ", "civil", "civil matters", "zivilrecht", "droit civil"],
        "Contract Law": ["contract", "contracts", "law of contracts", "vertragsrecht"],
        "Family Law": ["fam", "family", "family matters", "familienrecht", "derecho de familia"],
        "Property Law": ["property", "prop law", "real property law", "droit des biens"],
        "Employment Law": ["empl", "employment", "labor employment", "arbeitsrecht"],
        "Intellectual Property": ["ip", "i p", "ip law", "intellectual prop", "propriété intellectuelle"],
        "Tax Law": ["tax", "taxation", "tax matters", "steuerrecht", "derecho tributario"],
        "Bankruptcy": ["bk", "bankr", "bankruptcy law", "insolvency"],
        "Personal Injury": ["pi", "pers inj", "injury personal", "personal injury law", "bodily injury pi", "bodily injury"],
    },
}
#: Words around a mention that do not change what is meant.
NOISE = frozenset("re doc the a an amended sealed filed signed entered copy no nr law".split())
#: Words that do not tell one entry from another where the rest agrees.
SMALL = frozenset("to for of in on".split())
#: Shares of words in common from which a value stands for an entry: of both, and of the entry alone where the value adds none.
OVERLAP, LEAST_OF_NAME = 0.75, 2 / 3
#: Share of the weight of both sets of words in common from which a court is meant.
COURT_OVERLAP = 0.66
#: Words of rank, which short forms leave out, and what they weigh beside other words.
RANKS, RANK = frozenset("superior district appeal".split()), 0.5
#: What the short words of court names stand for.
COURT_WORDS = {
    "ct": "court", "dist": "district", "cty": "county", "cnty": "county", "co": "county", "super": "superior", "sup": "superior", "app": "appeal",
    "appellate": "appeal", "div": "division", "1st": "first", "2nd": "second", "usdc": "district", "nd": "northern", "sd": "southern", "ed": "eastern", "wd": "western",
}
#: Words of court names that do not tell one court from another.
COURT_COMMON = frozenset("united states us u s the of for court county division state".split())


def fold(value: str) -> str:
    """Lower case without accents; everything but letters and digits is a space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9]+", plain))


def slip(a: str, b: str) -> bool:
    """Whether a and b differ by at most one insertion, deletion, replacement or exchange of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j, k = len(a), len(b)
    while j > i and k > i and a[j - 1] == b[k - 1]:
        j, k = j - 1, k - 1
    return max(j - i, k - i) <= 1 or (j - i == 2 and k - i == 2 and a[i] == b[i + 1] and a[i + 1] == b[i])


def same_word(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 3 and slip(a, b))


def shortens(short: str, full: str) -> bool:
    """Whether a word may be a short form of another: an initial, or letters of it in their order, the first one included."""
    if not short or len(short) == 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def court_words(value: str) -> list[str]:
    """The words of a court name in full, without those that all names have."""
    low = fold(re.sub(r"\b([A-Za-z])\.\s?([A-Za-z])\.", r"\1\2 ", value.replace("'", "")))
    words = [COURT_WORDS.get(w, w) for w in low.split()]
    return [w for w in dict.fromkeys(words) if w not in COURT_COMMON]


class ListMapper:
    """Maps values to the entries of one list. entries: (item_id, label)."""

    def __init__(self, list_name: str, entries: list[tuple[int, str]]):
        self.court = list_name == "court_name"
        self.exact = {label for _, label in entries}
        self.seen: dict[str, int] = {}
        self.stands: dict[str, list[str]] = {}
        names: dict[str, int] = {}
        for item, label in entries:
            names[fold(label)] = item
        for item, label in entries:
            for alias in ALIASES.get(list_name, {}).get(label, []):
                names.setdefault(fold(alias), item)
        if self.court:
            self.keys = {item: court_words(label) for item, label in entries}
            times = Counter(w for words in self.keys.values() for w in words)
            #: how much a word of a court tells; a word of no court tells most
            self.weight = {w: math.log(1 + len(entries) / n) * (RANK if w in RANKS else 1) for w, n in times.items()}
            self.unknown = math.log(1 + len(entries))
        self.names = names
        self.by_size: dict[int, list[tuple[list[str], int]]] = {}
        for name, item in names.items():
            self.by_size.setdefault(len(name.split()), []).append((name.split(), item))
        self.automaton = ahocorasick.Automaton()
        for name in names:
            self.automaton.add_word(f" {name} ", name)
        if names:
            self.automaton.make_automaton()

    def mentions(self, text: str) -> tuple[set[int], list[str]]:
        """Items of the longest mentions that do not overlap, and the words outside them."""
        padded = f" {text} "
        found = sorted(((end - len(n) - 1, end, n) for end, n in self.automaton.iter(padded)), key=lambda f: (f[0] - f[1], f[0])) if self.names else []
        taken: list[tuple[int, int, str]] = []
        for start, end, name in found:
            if all(end <= s + 1 or start >= e - 1 for s, e, _ in taken):
                taken.append((start, end, name))
        rest, at = [], 0
        for start, end, _ in sorted(taken):
            rest += padded[at:start].split()
            at = end
        rest += padded[at:].split()
        return {self.names[n] for _, _, n in taken}, rest

    def alike(self, word: str) -> list[str]:
        """The words of court names that a word may stand for: itself, one slip away, or in full."""
        known = self.stands.get(word)
        if known is None:
            if word in self.weight:
                known = [word]
            else:
                known = [w for w in self.weight if min(len(w), len(word)) >= 5 and slip(w, word)] or [w for w in self.weight if shortens(word, w)]
            if len(self.stands) > 100_000:
                self.stands.clear()
            self.stands[word] = known
        return known

    def similar_court(self, value: str) -> int:
        """The only court of the highest weighted similarity, if that reaches COURT_OVERLAP."""
        words = [w for w in court_words(value) if w not in NOISE and not w.isdigit()]
        stands = [(w, self.alike(w)) for w in words]
        best, at = 0.0, []
        for item, key in self.keys.items():
            left, strange = list(key), 0.0
            for w, means in stands:
                met = next((m for m in means if m in left), None)
                if met:
                    left.remove(met)
                elif not any(m in key for m in means):
                    strange += max((self.weight[m] for m in means), default=self.unknown)
            whole = sum(map(self.weight.__getitem__, key))
            score = (whole - sum(map(self.weight.__getitem__, left))) / (whole + strange) if whole else 0.0
            if score > best + 1e-9:
                best, at = score, [item]
            elif score > best - 1e-9:
                at.append(item)
        return at[0] if best >= COURT_OVERLAP and len(at) == 1 else 0

    def __call__(self, value: str) -> int:
        """item_id of the entry meant, 0 if none is."""
        known = self.seen.get(value)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[value] = self.find(value)
        return known

    def find(self, value: str) -> int:
        text = fold(value)
        items, rest = self.mentions(text)
        if len(items) == 1 and all(w in NOISE or w.isdigit() or len(w) == 1 for w in rest):
            return items.pop()
        if self.court:
            return self.similar_court(value)
        words = [w for w in text.split() if w not in NOISE and not w.isdigit()]
        found: dict[int, int] = {}
        for name, item in self.by_size.get(len(words), []):
            slips = self.similar(words, name)
            if slips is not None and slips <= found.get(item, 9):
                found[item] = slips
        least = [i for i, s in found.items() if s == min(found.values())]
        if not found:  # a space typed in the wrong place, or left out
            joined = "".join(words)
            least = list({i for n, i in self.names.items() if len(joined) >= 5 and " " in n and slip(joined, n.replace(" ", ""))})
        if not least:
            scores: dict[int, float] = {}
            for names in self.by_size.values():
                for name, item in names:
                    scores[item] = max(scores.get(item, 0), self.overlap(words, name))
            least = [i for i, x in scores.items() if x and x == max(scores.values())]
        return least[0] if len(least) == 1 else 0

    @staticmethod
    def overlap(words: list[str], name: list[str]) -> float:
        """Share of words in common of two sets of words, one slip a word allowed; 0 below OVERLAP.

        Small words do not count where the value adds no word to the name.
        """

        def alike(a: list[str], b: list[str]) -> int:
            left = list(b)
            for w in sorted(a, key=lambda w: w not in left):
                near = w if w in left else next((n for n in left if same_word(n, w)), None)
                if near is not None:
                    left.remove(near)
            return len(b) - len(left)

        a, b = ([w for w in v if w not in SMALL] for v in (words, name))
        n, m = alike(words, name), alike(a, b)
        if m >= 2 and m == len(a) and m >= LEAST_OF_NAME * len(b):
            return m / len(b)
        score = n / (len(words) + len(name) - n) if n else 0
        return score if score >= OVERLAP else 0

    @staticmethod
    def similar(words: list[str], name: list[str]) -> int | None:
        """Slips (at most one) between two sets of words that are alike word for word; None if they aren't."""
        left, slips = list(name), 0
        for w in words:
            if w in left:
                left.remove(w)
            else:
                near = next((n for n in left if same_word(n, w)), None)
                if near is None:
                    return None
                left.remove(near)
                slips += 1
        return slips if not left and slips <= 1 else None


FIELDS = ("document_type", "legal_category", "court_name")


def mappers(items: list[tuple]) -> dict[str, ListMapper]:
    """A mapper for each list of (item_id, list_name, item_label)."""
    return {f: ListMapper(f, sorted((i, label) for i, name, label in items if name == f)) for f in FIELDS}


def map_values(results: DataFrame, items: DataFrame) -> DataFrame:
    """(result_id, field_name, item_id) of every typed value that is no entry of its list.

    Null and blank values and those equal to an entry give no row; item_id is 0 where no entry
    is meant, and for every value when the list is empty. Repeated rows give repeated rows;
    extra columns are not looked at. The list is a fixed table and travels with the task.
    """
    entries = [tuple(r) for r in items.select("item_id", "list_name", "item_label").collect()]

    def run(batches):
        own = mappers(entries)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for i, field in enumerate(FIELDS):
                m = own[field]
                for rid, value in zip(ids, batch.column(i + 1).to_pylist()):
                    if value is not None and value.strip() and value not in m.exact:
                        out[0].append(rid)
                        out[1].append(field)
                        out[2].append(m(value))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["result_id", "field_name", "item_id"])

    src = results.select("result_id", "document_type", "legal_category", F.col("court_info.court_name").alias("court_name"))
    return src.mapInArrow(run, "result_id bigint, field_name string, item_id bigint")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "classification_results").select("result_id", "document_type", "legal_category", "court_info")
    return map_values(spread(results, "result_id"), table(spark, sf_dir, "reference_items"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that no entry is meant by, with how often they occur."""
    results = table(spark, sf_dir, "classification_results")
    none = p1_found(spark, sf_dir).where("item_id = 0")
    value = F.when(F.col("field_name") == "document_type", F.col("document_type")).when(F.col("field_name") == "legal_category", F.col("legal_category")).otherwise(F.col("court_info.court_name"))
    return none.join(results.select("result_id", "document_type", "legal_category", "court_info"), "result_id").groupBy("field_name", value.alias("value")).agg(F.count("*").alias("n"))
