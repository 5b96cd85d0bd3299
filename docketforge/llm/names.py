"""Problem 5: linking the variant spellings of persons, companies, law firms and courts.

Distinct spellings are parsed into words with a role. A symmetric-delete index on the telling
words (every word and every word less one letter) finds words that are one slip apart, and
with them pairs of spellings; no group is compared beyond these pairs. A pair is aligned word
by word by optimal assignment, in which initials, cut words and nicknames may stand for full
ones. Spellings written out are joined into entities; a shortened one joins an entity when all
that it may stand for is that one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forget, table
from .mapping import COURT_COMMON, RANKS, court_words, fold, shortens, slip

#: Given names with their short forms.
NICKNAMES = {
    "abigail": "abby", "alexander": "alex sandy", "amelia": "amy", "anthony": "tony", "barbara": "barb", "benjamin": "ben", "bernard": "bernie", "catherine": "cathy kate",
    "charles": "chuck charlie", "christine": "chris tina", "daniel": "dan", "deborah": "deb debbie", "douglas": "doug", "edward": "ed ted", "eleanor": "ellie nell", "elizabeth": "beth betty liz",
    "florence": "flo", "francisco": "paco", "frederick": "fred", "gabriel": "gabe", "gerald": "jerry", "gregory": "greg", "guadalupe": "lupe", "harold": "hal", "helena": "lena",
    "henry": "harry hank", "ignacio": "nacho", "irene": "rene", "isabella": "bella izzy", "james": "jim", "jennifer": "jen", "jonathan": "jon", "joseph": "joe", "kenneth": "ken", "kimberly": "kim",
    "konstantin": "kostya", "lawrence": "larry", "leonard": "len", "lillian": "lily", "margaret": "peggy maggie", "martha": "marty", "matthew": "matt", "michael": "mike", "natalie": "nat",
    "nathaniel": "nate", "nicholas": "nick", "patricia": "patty trish pat", "penelope": "penny", "philip": "phil", "rebecca": "becky", "richard": "dick rick", "robert": "bob rob", "ronald": "ron",
    "samuel": "sam", "stephanie": "steph", "susan": "sue", "theodore": "ted teddy", "theresa": "terry", "thomas": "tom", "victoria": "vicky", "vincent": "vince", "walter": "walt",
    "william": "bill will", "winifred": "winnie",
}
FORMAL: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL.setdefault(_s, set()).add(_full)
#: Words before and after names that do not tell persons apart.
TITLES = frozenset("mr mrs ms mx dr hon judge esq phd md jr".split())
#: Words after a name that do tell persons apart (jr. comes and goes with one bar number).
KIN = {"sr": "sr", "ii": "2", "iii": "3", "iv": "4"}
#: Legal forms as they are written.
FORMS = {
    "llc": "llc", "limited liability company": "llc", "lp": "lp", "limited partnership": "lp", "llp": "llp", "limited liability partnership": "llp", "pllc": "pllc", "pc": "pc",
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
}
#: Lines of business in company names, with short forms that are not just their beginning.
TRADES = {
    "marine": "", "construction": "", "textiles": "", "manufacturing": "mfg", "laboratories": "labs", "properties": "props", "logistics": "", "railway": "ry", "mutual": "", "mining": "",
    "publishing": "publg", "equipment": "", "transport": "", "electric": "", "savings": "", "freight": "frt", "software": "sftwr", "brewing": "", "foundry": "fdry", "pharmacy": "", "petroleum": "",
    "insurance": "", "chemical": "", "distribution": "distrib", "investments": "invs", "dairy": "dy", "hospital": "", "development": "", "holdings": "hldgs", "engineering": "engg",
}
#: Values that name nobody.
NOBODY = frozenset(
    "n a|na|unknown|none|does 1 through 20|pro se|tbd|tbc|see caption|see file|see attached|various|none assigned|not assigned|unassigned|anonymous|self represented|in propria persona|null|nil|redacted|sealed|john doe|jane doe|doe|to be determined".split("|")
)
_DOES = re.compile(r"(?:does?|roes?|john does|jane does)(?: \d+)?(?: (?:through|to) \d+)?")


@dataclass(frozen=True)
class Parsed:
    kind: str  # person, company, firm, court or other
    keys: tuple[str, ...]  # telling words: family name, company's or partners' names
    given: str = ""
    middle: str = ""
    kin: str = ""
    trade: str = ""
    form: str = ""
    full: bool = True  # the given name is written out
    words: tuple[str, ...] = field(default=())


def _form(words: list[str]) -> tuple[list[str], str]:
    for n in (3, 2, 1):
        tail = " ".join(words[-n:])
        if len(words) > n and tail in FORMS:
            return words[:-n], FORMS[tail]
    return words, ""


def trade_of(word: str) -> str:
    """The line of business a word stands for: whole, misspelt or cut short; '' if none."""
    if word in TRADES:
        return word
    if len(word) >= 5:
        near = [t for t in TRADES if slip(t, word)]
        if len(near) == 1:
            return near[0]
    short = [t for t, s in TRADES.items() if s == word]
    if short:
        return short[0]
    begins = [t for t in TRADES if len(word) >= 3 and t.startswith(word)]
    return begins[0] if len(begins) == 1 else ""


def given_of(word: str) -> set[str]:
    """The formal names that a given name stands for."""
    out = set(FORMAL.get(word, ()))
    if word in NICKNAMES:
        out.add(word)
    return out


def parse(value: str, kind: str, courts: frozenset = frozenset()) -> Parsed | None:
    """A spelling by the roles of its words; None if it names nobody. courts: names of courts as they are written out."""
    text = fold(value)
    if not text or text in NOBODY or _DOES.fullmatch(text) or not re.search("[a-z]", text):
        return None
    plain = fold(re.sub(r"(?<=\b[A-Za-z])\.(?=[A-Za-z]\b)", "", value).replace("'", ""))
    plain = re.sub(r"\b([a-z]) (?=[a-z]\b)", r"\1 ", plain)
    words = plain.split()
    if kind == "court":
        w = court_words(value)
        w = [next((r for r in sorted(RANKS) if slip(r, x)), x) for x in w if not any(len(c) >= 5 and slip(c, x) for c in COURT_COMMON)]
        w = list(dict.fromkeys(w))
        return Parsed("court", tuple(sorted(w)), full=value in courts) if w else None
    former = re.search(r"\bformerly\b", plain)
    if former:
        words = plain[: former.start()].split()
    if words[:1] == ["the"]:
        words = words[1:]
    if kind == "organization":
        words = " ".join(words)
        words = re.sub(r"^law offices? of ", "", re.sub(r" attorneys at law$", "", words)).split()
        words, form = _form(words)
        names = tuple(sorted(w for w in words if w != "and"))
        return Parsed("firm", names, form=form, words=names) if names else None
    body, form = _form(words)
    trades = [(i, trade_of(w)) for i, w in enumerate(body)] if len(body) > 1 else []
    trades = [(i, t) for i, t in trades if t]
    if kind == "party" and trades and (form or body[-1] not in NICKNAMES) and not ("," in value and not form and _given_like(body[1:])):
        i, t = trades[-1]
        rest = tuple(w for j, w in enumerate(body) if j != i)
        return Parsed("company", tuple(sorted(rest)), trade=t, form=form)
    if kind == "party" and form:
        return Parsed("company", tuple(sorted(body)), form=form)
    return _person(value, words)


def _given_like(words: list[str]) -> bool:
    return any(w in NICKNAMES or w in FORMAL or len(w) == 1 for w in words)


def _person(value: str, words: list[str]) -> Parsed | None:
    comma = value.find(",")
    marks = re.findall(r"[^\W\d_]+\.?|,", value)
    low = [(fold(m), m.endswith(".")) for m in marks if m != ","]
    low = [(w, dot) for w, dot in low if w]
    kin = next((KIN[w] for w, _ in low if w in KIN), "")
    names = [(w, dot) for w, dot in low if w not in TITLES and w not in KIN and w not in ("ph", "d") or (w == "d" and len(low) < 4)]
    if not names:
        return None
    before = fold(value[:comma]).split() if comma > 0 else []
    before = [w for w in before if w not in TITLES]
    after = [w for w in fold(value[comma + 1 :]).split() if w not in TITLES and w not in KIN] if comma > 0 else []
    if after and len(before) == 1:
        family, rest = before[0], [(w, d) for w, d in names if w != before[0]]
    elif len(names) == 1:
        return Parsed("person", (names[0][0],), full=False, kin=kin)
    elif names[-1][0] in NICKNAMES and names[0][0] not in NICKNAMES and names[0][0] not in FORMAL and len(names[0][0]) > 1:
        family, rest = names[0][0], names[1:]
    else:
        family, rest = names[-1][0], names[:-1]
    given, dot = rest[0] if rest else ("", False)
    middle = next((w[0] for w, _ in rest[1:]), "")
    cut_short = len(given) == 1 or (dot and len(given) <= 4)
    return Parsed("person", (family,), given=given, middle=middle, kin=kin, full=bool(given) and not cut_short)


def cheapest(cost: list[list[float]]) -> float:
    """The least sum of costs of an assignment of every row to a column of its own (Kuhn 1955); rows are at most columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    u, v, at, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        at[0], j = i, 0
        least, done = [inf] * (m + 1), [False] * (m + 1)
        while True:
            done[j] = True
            row, best, nxt = at[j], inf, 0
            for k in range(1, m + 1):
                if done[k]:
                    continue
                c = cost[row - 1][k - 1] - u[row] - v[k]
                if c < least[k]:
                    least[k], way[k] = c, j
                if least[k] < best:
                    best, nxt = least[k], k
            for k in range(m + 1):
                if done[k]:
                    u[at[k]] += best
                    v[k] -= best
                else:
                    least[k] -= best
            j = nxt
            if not at[j]:
                break
        while j:
            at[j] = at[way[j]]
            j = way[j]
    return -v[0]


#: Costs of a pair of words: equal, one slip apart, a short form; more than all others together: no pair.
SLIP, SHORT, NEVER = 1.0, 1.5, 1e6


def word_cost(a: str, b: str, short: bool) -> float:
    if a == b:
        return 0.0
    if min(len(a), len(b)) >= 4 and slip(a, b):
        return SLIP
    return SHORT if short and (shortens(a, b) or shortens(b, a)) else NEVER


def assign(a: tuple[str, ...], b: tuple[str, ...], short: bool = False, spare: frozenset = frozenset()) -> float | None:
    """The least cost of an assignment of the words of a to those of b, or None if some word has no match.

    Only words of spare may be left over, and only on one side, for the other side names less.
    """
    left, right = list(a), list(b)
    for w in a:  # equal words belong together
        if w in right:
            left.remove(w)
            right.remove(w)
    if len(left) > len(right):
        left, right = right, left
    if len(left) < len(right):
        # what one side has beside the other is of the spare words, and enough is left to tell
        over = sorted((w for w in right if w in spare), key=right.index)[: len(right) - len(left)]
        if len(over) < len(right) - len(left) or min(len(a), len(b)) < 2:
            return None
        for w in over:
            right.remove(w)
    if not left:
        return 0.0
    cost = cheapest([[word_cost(x, y, short) for y in right] for x in left])
    return cost if cost < NEVER else None


def given_alike(a: str, b: str) -> bool:
    """Two given names written out: equal, one slip apart, or short forms of one name."""
    if a == b:
        return True
    fa, fb = given_of(a), given_of(b)
    if fa and fb:
        return bool(fa & fb)
    if min(len(a), len(b)) >= 4 and slip(a, b):
        return True
    # a misspelt name against the short form of the right one
    return any(min(len(f), len(o)) >= 4 and slip(f, o) for f in (fa or fb) for o in ((b,) if fa else (a,)))


def begins(short: str, full: str) -> bool:
    """Whether an initial or cut given name may stand for a full one (or for what that is short of)."""
    names = {full} | given_of(full)
    return any(n.startswith(short) for n in names)


def same_person(a: Parsed, b: Parsed) -> bool:
    if a.kin != b.kin or assign(a.keys, b.keys) is None or (a.middle and b.middle and a.middle != b.middle):
        return False
    if not a.given or not b.given:
        return False
    if a.full and b.full:
        return given_alike(a.given, b.given)
    short, full = (a, b) if not a.full else (b, a)
    if not full.full:
        return short.given.startswith(full.given) or full.given.startswith(short.given)
    return begins(short.given, full.given)


def same(a: Parsed, b: Parsed) -> bool:
    if a.kind != b.kind:
        return False
    if a.kind == "person":
        return same_person(a, b)
    if a.kind == "court":
        return assign(a.keys, b.keys, short=True, spare=RANKS) is not None
    if a.form and b.form and a.form != b.form:
        return False
    if a.trade and b.trade and a.trade != b.trade:
        return False
    return assign(a.keys, b.keys) is not None


def marks(p: Parsed) -> set[str]:
    """Marks of which two spellings of one entity share one: letters that a given name may begin with; those that the words of a
    court begin with, less one; else the kind."""
    if p.kind == "court":
        first = sorted(w[0] for w in p.keys if w not in RANKS)
        return {"".join(first)} | {"".join(first[:i] + first[i + 1 :]) for i in range(len(first))}
    if p.kind != "person":
        return {p.kind}
    return set(p.given[:2]) | {n[0] for n in given_of(p.given)} or {""}


def written_out(p: Parsed) -> bool:
    return p.full and (p.kind not in ("company", "firm") or bool(p.form))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (field_name, case_number, name) of the four fields; parties without a case are linked under ''."""
    part = lambda d, f, case, name: d.select(F.lit(f).alias("field_name"), case.alias("case_number"), name.alias("name"))
    none = F.lit("")
    parties = table(spark, sf_dir, "parties")
    attorneys = table(spark, sf_dir, "attorneys")
    results = table(spark, sf_dir, "classification_results")
    out = part(parties, "party", F.coalesce("case_number", none), F.col("name"))
    out = out.unionByName(part(attorneys, "attorney", none, F.col("name"))).unionByName(part(attorneys, "organization", none, F.col("organization")))
    out = out.unionByName(part(results, "court", none, F.col("court_info.court_name")))
    return out.where("trim(name) <> ''").distinct()


#: Spellings in a block from which it is compared in a grid of cells.
BLOCK = 2000
_PARSED: dict[tuple, Parsed | None] = {}


def _parsed(value: str, kind: str, courts: frozenset) -> Parsed | None:
    key = (value, kind)
    if key not in _PARSED:
        if len(_PARSED) > 200_000:
            _PARSED.clear()
        _PARSED[key] = parse(value, kind, courts)
    return _PARSED[key]


def _spellings(courts: frozenset):
    """(field_name, case_number, name) -> with word and mark for each telling word and mark, whether it is written out, and its reading."""

    def run(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for fld, case, name in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p = parse(name, fld, courts)
                if p is None:
                    continue
                words = tuple(dict.fromkeys(w for w in p.keys if len(w) >= 4)) or p.keys[:1]
                for w in words:
                    for m in marks(p):
                        for c, x in zip(cols, (fld, case, name, w, m, written_out(p), repr(p))):
                            c.append(x)
            kinds = [pa.string()] * 5 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["field_name", "case_number", "name", "word", "mark", "full", "reading"])

    return run


def _variants(batches):
    """(field_name, case_number, word, variant): each word and, if it may slip, each word less one letter."""
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [])
        for fld, case, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) >= 4)}:
                for c, x in zip(cols, (fld, case, w, v)):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["field_name", "case_number", "word", "variant"])


def _pair(a: Parsed, b: Parsed) -> tuple[int, bool, bool] | None:
    """How two spellings go together: 0 both written out, 1 the first short and the second written out, 2 both short; or not at all."""
    x, y = written_out(a), written_out(b)
    if not same(a, b):
        return None
    return (0 if x and y else 2 if x == y else 1), a.keys == b.keys, bool(a.middle) and a.middle == b.middle


def _compare_cells(courts: frozenset):
    """Rows (cell, diagonal, side, id, field_name, name) sorted by cell -> pairs (a, b, kind, exact, told).

    The spellings of side 0 are compared with those of side 1, and in a cell of the diagonal with
    each other. A cell holds at most some thousand spellings. Of kind 1 a is the short one.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())

    def pairs(rows):
        own = [(i, _parsed(n, f, courts)) for _, side, i, f, n in rows if not side]
        other = [(i, _parsed(n, f, courts)) for _, side, i, f, n in rows if side]
        diagonal = any(d for d, *_ in rows)
        for k, (i, p) in enumerate(own):
            for j, q in own[k + 1 :] + other if diagonal else other:
                how = _pair(p, q) if i != j else None
                if how:
                    a, b = ((j, i) if written_out(p) else (i, j)) if how[0] == 1 else (min(i, j), max(i, j))
                    yield (a, b, *how)

    def batch_of(out):
        cols = list(zip(*out)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "b", "kind", "exact", "told"])

    def run(batches):
        cell, rows, out = None, [], []
        for batch in batches:
            for c, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if c != cell:
                    out += pairs(rows)
                    cell, rows = c, []
                    if len(out) > 8192:
                        yield batch_of(out)
                        out = []
                rows.append(row)
        out += pairs(rows)
        yield batch_of(out)

    return run


def _near_words(words: DataFrame) -> DataFrame:
    """Pairs (field_name, case_number, x, y), x < y, of words one slip apart: one edit, or an exchange of neighbours."""
    key = ["field_name", "case_number"]
    variant = words.mapInArrow(_variants, "field_name string, case_number string, word string, variant string")
    met = variant.withColumnRenamed("word", "x").join(variant.withColumnRenamed("word", "y"), [*key, "variant"]).where("x < y").select(*key, "x", "y").distinct()
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return met.where((F.levenshtein("x", "y") <= 1) | ((F.length("x") == F.length("y")) & (F.levenshtein("x", "y") == 2) & (letters(F.col("x")) == letters(F.col("y")))))


def linked_names(names: DataFrame, courts: list[tuple[int, str]]) -> DataFrame:
    """names(field_name, case_number, name) -> (field_name, case_number, cluster, name).

    Names of one field and case with the same cluster stand for one entity. Null, blank and
    placeholder values are left out; repeated rows count once; an empty table gives an empty
    result. The courts of the reference list (item_id, label) are those written out.

    A block holds the distinct spellings with one telling word and mark, and those with a later
    word one slip apart; the rows that bear them do not count. Only spellings of one word are
    compared with each other and with these others, so words that slip into one another in a chain
    do not make one block. A large block is compared in a grid of cells.
    """
    out = frozenset(label for _, label in courts)
    own = names.select("field_name", "case_number", "name").where("trim(name) <> ''").distinct()
    key = ["field_name", "case_number"]
    index = cut(own.mapInArrow(_spellings(out), "field_name string, case_number string, name string, word string, mark string, full boolean, reading string").withColumn("id", F.xxhash64(*key, "name")))
    near = cut(_near_words(index.select(*key, "word").distinct()))
    base = index.select(*key, "word", "mark", "id", "name")
    foreign = base.join(near.select(*key, F.col("y").alias("word"), "x"), [*key, "word"]).select(*key, F.col("x").alias("word"), "mark", "id", "name")
    rows = base.withColumn("side", F.lit(0)).unionByName(foreign.withColumn("side", F.lit(1)))
    block = F.xxhash64(*key, "word", "mark")
    rows = cut(rows.select(block.alias("block"), "side", "id", "field_name", "name"))
    large = rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    sized = rows.join(large, "block", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1)))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = sized.withColumn("part", part).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # cell (i, j): the own spellings of part i against the others of part j and, for i < j, the own ones of part j
    cell = lambda rows, i, j, side: rows.select(F.xxhash64("block", i, j).alias("cell"), (F.col(i) == F.col(j)).alias("diagonal"), F.lit(side).alias("side"), "id", "field_name", "name")
    grid = cell(cells.where("side = 0"), "part", "k", 0).unionByName(cell(cells.where("side = 0 and k < part"), "k", "part", 1)).unionByName(cell(cells.where("side = 1"), "k", "part", 1))
    met = grid.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare_cells(out), "a bigint, b bigint, kind int, exact boolean, told boolean")
    pairs = cut(met.groupBy("a", "b", "kind").agg(F.bool_or("exact").alias("exact"), F.bool_or("told").alias("told")))
    forget(rows, near)

    nodes = index.groupBy("id").agg(F.first("field_name").alias("field_name"), F.first("case_number").alias("case_number"), F.first("name").alias("name"), F.first("full").alias("full"), F.first("reading").alias("reading"))
    fits = pairs.where("kind = 1")
    loose = pairs.where("kind = 2").join(fits.select("a"), "a", "left_anti").join(fits.select(F.col("a").alias("b")), "b", "left_anti")
    comp = cut(components(pairs.where("kind = 0").select("a", "b").unionByName(loose.select("a", "b"))))
    root = nodes.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("comp", "id").alias("root"))
    told = fits.join(root.select(F.col("id").alias("b"), "root"), "b")
    # of what a short spelling may stand for, the same words count before others, and of these the same middle initial
    tier = F.struct(F.col("exact"), F.col("told"))
    best = told.groupBy("a").agg(F.max(tier).alias("t"))
    top = told.join(best, "a").where((F.col("exact") == F.col("t.exact")) & (F.col("told") == F.col("t.told")) | ((F.col("exact") == F.col("t.exact")) & ~F.col("t.told")))
    chosen = top.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).withColumnRenamed("a", "id")
    by_reading = nodes.groupBy(*key, "reading").agg(F.min("id").alias("same_reading"))
    placed = nodes.join(root, "id").join(chosen, "id", "left").join(by_reading, [*key, "reading"])
    cluster = F.when(F.col("lo").isNull(), F.when(F.col("full"), F.col("root")).otherwise(F.col("root"))).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("same_reading"))
    return placed.select(*key, cluster.cast("string").alias("cluster"), "name")


def _courts(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    items = table(spark, sf_dir, "reference_items").where("list_name = 'court_name'").select("item_id", "item_label")
    return sorted((r.item_id, r.item_label) for r in items.collect())  # a fixed list


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the entity it stands for."""
    return linked_names(mentions(spark, sf_dir), _courts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = cut(p5_entities(spark, sf_dir))
    key = ["field_name", "case_number", "cluster"]
    pairs = names.withColumnRenamed("name", "name_a").join(names.withColumnRenamed("name", "name_b"), key).where("name_a < name_b")
    return pairs.select("field_name", "case_number", "name_a", "name_b")
