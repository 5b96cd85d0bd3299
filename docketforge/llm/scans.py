"""Problem 6: noise in text from scanned pages, and its repair into readable paragraphs.

Words of the whole corpus are grouped by a skeleton in which glyphs that scanners confuse are
the same; a rare form is a misread one if the form that rules its group is frequent. Where two
frequent forms have one skeleton the words beside them decide which is meant. Lines
that repeat within a record when their digits are masked are running headers where they
break into the text or stand at a page's edge. The repair drops headers and page numbers,
joins divided words and flows the lines of each paragraph together with SQL windows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spread, table

#: What is read for a glyph, two characters for one and one for one.
LIGATURE = ("ﬁ", "fi")
PAIRS = (("d", "cl"), ("m", "rn"), ("h", "li"), ("u", "ii"), ("w", "vv"))
SINGLES = (("e", "c"), ("t", "f"), ("i", "l"), ("l", "1"), ("o", "0"), ("s", "5"), ("g", "q"))
#: A frequent form occurs in at least this share of the records: so there are at most
#: (distinct words of a record) / SHARE of them, however large the corpus is. At least LEAST records.
SHARE, LEAST = 0.0004, 8
#: A form counts beside the ruling form of its skeleton if it is at most so many times rarer.
RARER = 25
MIN_LENGTH = 4
#: A shorter form counts as true if it is at most so many times rarer than the most frequent form, and is looked for only in words that stand alone.
SHORT_RARER = 35

#: Of two frequent forms of one skeleton the other is meant where it stands so many times more often beside the same words,
#: and beside them in at least so many records.
BESIDE, LEAST_BESIDE = 10, 8

_SINGLES = str.maketrans({"e": "c", "t": "f", "i": "l", "1": "l", "0": "o", "5": "s", "g": "q"})
_WORD = re.compile(r"[^\W_]+")
#: Short words that stand alone: no parts of divided words, abbreviations, compounds or numbers.
_ALONE = re.compile(r"(?<![\w'’.\-¬­@/§&])(?<![-¬­]\n)(?<![-¬­] \n)(?<![-¬­]\r\n)(?:[A-ZÀ-Þ](?=[a-z0-9à-ÿ]))?[a-z0-9à-ÿ]{1,5}(?![\w'’.\-¬­@/])")
_NO_SHORT = re.compile(r"[ivxlcdm]+|[1-9].*|[^a-zà-ÿ]*|.", re.I)
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_BREAK = re.compile(r"([-¬­])[ \t]*\r?\n\s*(?=([^\W\d_]+))")
_BEFORE = re.compile(r"[^\W\d_]+$")
_MAIL_AFTER = re.compile(r"[\w.+-]*(?:@| ?\[at\]| ?\(at\))")
_DIGITS = re.compile(r"\d+")
#: How the number of a page stands alone on its line.
PAGE_SURE = re.compile(r"(?:p\.|page|pág\.|página|seite|s\.) ?\d{1,4}(?: ?(?:of|de|von|sur|/) ?\d{1,4})?|- ?\d{1,4} ?-|– ?\d{1,4} ?–|\d{1,3}/\d{1,3}|\[\d{1,4}\]|· ?\d{1,4} ?·", re.I)
PAGE_BARE = re.compile(r"\d{1,3}|[ivxl]{1,7}")
#: Words that run on in a sentence and hardly stand in a heading.
_RUNNING_WORD = re.compile(r"(?<![^\s])[a-zà-ÿ][^\W_]{3,}")
#: What sets a running header off from other repeated headings.
_HEADING_MARK = re.compile(r" [—|] |\((?:continued|CONTINUED|cont\.)\)|^Case .*\d|^CASE .*\d")
_AT_END = re.compile(r"\S {2,}(\d{1,3}|[ivxl]{1,7})$")
_ENDS = (".", "!", "?", ":", ";", "”", '"', ")", "]")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}


def skeleton(word: str) -> str:
    """The lower-cased word with each confusable glyph in the form it is misread as."""
    word = word.replace(*LIGATURE)
    for true, read in PAIRS:
        if true in word:
            word = word.replace(true, read)
    return word.translate(_SINGLES)


def skeleton_column(word: Column) -> Column:
    word = F.replace(word, F.lit(LIGATURE[0]), F.lit(LIGATURE[1]))
    for true, read in PAIRS:
        word = F.replace(word, F.lit(true), F.lit(read))
    return F.translate(word, "eti105g", "cflolsq")


def _number(mark: str) -> int:
    if mark.isdigit():
        return int(mark)
    values = [_ROMAN[c] for c in mark]
    return sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values))


def _words(batches):
    """(word, n): in how many records each word and each hyphenated pair occurs, by batch of records."""
    for batch in batches:
        n: Counter = Counter({"": batch.num_rows})
        for text in batch.column(0).to_pylist():
            low = text.lower()
            n.update({w for w in _WORD.findall(low) if MIN_LENGTH <= len(w) <= 24})
            n.update({w for w in _ALONE.findall(low) if 1 < len(w) < MIN_LENGTH})
            if "-" in low:
                n.update(set(_COMPOUND.findall(low)))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])


def frequent_forms(texts: DataFrame) -> DataFrame:
    """(word, skeleton, n) of the frequent words and hyphenated pairs, counted over all texts.

    Of the words of a skeleton the most frequent counts, and those not much rarer.
    """
    src = texts.where("text <> ''").select("text")
    counts = src.mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # the records are counted in the same pass, as the empty word
    counts = cut(counts.where(F.col("n") >= LEAST))
    records = counts.where("word = ''").select("n").first()
    least = max(LEAST, (records.n if records else 0) * SHARE)
    frequent = counts.where((F.col("word") != "") & (F.col("n") >= least)).select("word", skeleton_column(F.col("word")).alias("skeleton"), "n")
    ruling = F.max("n").over(Window.partitionBy("skeleton"))
    return frequent.withColumn("top", ruling).where(F.col("n") * RARER >= F.col("top")).select("word", "skeleton", "n")


def doubtful_forms(rows: list[tuple[str, str, int]]) -> dict[str, list[str]]:
    """Each frequent form that may be a misreading of other frequent forms, with these, the most frequent first."""
    by: dict[str, list[str]] = {}
    for w, s, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if "-" not in w and len(w) >= MIN_LENGTH and _HAS_LETTER.search(w):
            by.setdefault(s, []).append(w)
    out = {}
    for group in by.values():
        for w in group if len(group) > 1 else ():
            true = [t for t in group if t != w and Lexicon._one_way(w, t)]
            if true:
                out[w] = true
    return out


def contexts(texts: DataFrame, rows: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """(form, neighbour, records) of the doubtful forms and those they may stand for; the neighbour before has a space after it, the one after a space before it.

    Only frequent neighbours count, so there are at most (forms) x 2 x (frequent words). No job where no form is doubtful.
    """
    if not doubtful_forms(rows):
        return []

    def run(batches):
        lexicon = Lexicon(rows)
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                n.update(lexicon.around(_WORD.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in n], pa.string()), pa.array([x for _, x in n], pa.string()), pa.array(n.values(), pa.int64())], names=["form", "beside", "n"])

    counted = texts.where("text <> ''").select("text").mapInArrow(run, "form string, beside string, n bigint")
    return [tuple(r) for r in counted.groupBy("form", "beside").agg(F.sum("n").alias("n")).collect()]


class Lexicon:
    def __init__(self, rows: list[tuple[str, str, int]], beside: list[tuple[str, str, int]] = ()):
        self.words = {w for w, _, _ in rows}
        self.doubtful = doubtful_forms(rows)
        self.rivals = frozenset(self.doubtful) | {t for ts in self.doubtful.values() for t in ts}
        self.beside = {(w, x): n for w, x, n in beside}
        self.ruling: dict[str, str] = {}
        self.choice: dict[str, list[str]] = {}
        for w, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            if "-" not in w and _HAS_LETTER.search(w):
                self.ruling[s] = w
                self.choice.setdefault(s, []).insert(0, w)
        most = max((n for _, _, n in rows), default=0)
        self.short = {s: w for s, w in self.ruling.items() if len(w) < MIN_LENGTH}
        common = {w for w, _, n in rows if n * SHORT_RARER >= most}
        self.short = {s: w for s, w in self.short.items() if w in common}
        self.ruling = {s: w for s, w in self.ruling.items() if len(w) >= MIN_LENGTH}
        self.seen: dict[str, str] = {}
        self.seen_short: dict[str, str] = {}

    def support(self, form: str, before: str, after: str) -> int:
        """In how many records a form stands beside these words."""
        return self.beside.get((form, before + " "), 0) + self.beside.get((form, " " + after), 0)

    def meant(self, word: str, before: str, after: str) -> str:
        """The form that a lower-cased word was misread from where it stands beside these words, or ''."""
        if word in self.doubtful:
            own = self.support(word, before, after)
            for true in self.doubtful[word]:
                n = self.support(true, before, after)
                if n >= LEAST_BESIDE and n >= BESIDE * own:
                    return true
            return ""
        top = self.true_form(word)
        if top:
            others = [w for w in self.choice.get(skeleton(word), ()) if self._one_way(word, w)]
            if len(others) > 1:
                return max(others, key=lambda w: self.support(w, before, after))
        return top

    def around(self, row: list[str]) -> set[tuple[str, str]]:
        """(form, neighbour) of the doubtful forms, and of those they may stand for, in the words of a text."""
        out = set()
        last = len(row) - 1
        for i, w in enumerate(row):
            if w in self.rivals:
                if i and row[i - 1] in self.words:
                    out.add((w, row[i - 1] + " "))
                if i < last and row[i + 1] in self.words:
                    out.add((w, " " + row[i + 1]))
        return out

    def pending(self, row: list[str]) -> list[tuple[str, str, str]]:
        """The doubtful forms in the words of a text, each with the words beside it."""
        return sorted({(w, row[i - 1] if i else "", row[i + 1] if i + 1 < len(row) else "") for i, w in enumerate(row) if w in self.doubtful})

    def true_form(self, word: str) -> str:
        """The frequent form that a lower-cased word was misread from, or ''."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            known = ""
            if word not in self.words and len(word) >= MIN_LENGTH and _HAS_LETTER.search(word):
                top = self.ruling.get(skeleton(word), "")
                if top and self._one_way(word, top):
                    known = top
            self.seen[word] = known
        return known

    def short_form(self, word: str) -> str:
        """The common form of less than MIN_LENGTH letters that a lower-cased word standing alone was misread from, or ''."""
        known = self.seen_short.get(word)
        if known is None:
            if len(self.seen_short) > 400_000:
                self.seen_short.clear()
            known = ""
            if word not in self.words and not _NO_SHORT.fullmatch(word):
                top = self.short.get(skeleton(word), "")
                if top and self._one_way(word, top):
                    known = top
            self.seen_short[word] = known
        return known

    @staticmethod
    def _one_way(read: str, true: str) -> bool:
        """Whether read comes from true by confusions in the direction in which they happen."""
        reach = {(0, 0)}
        moves = [LIGATURE] + [(r, t) for t, r in (*PAIRS, *SINGLES)]
        while reach:
            fresh = set()
            for i, j in reach:
                if i == len(read) and j == len(true):
                    return True
                if i < len(read) and j < len(true) and read[i] == true[j]:
                    fresh.add((i + 1, j + 1))
                for r, t in moves:
                    if read.startswith(r, i) and true.startswith(t, j):
                        fresh.add((i + len(r), j + len(t)))
            reach = fresh
        return False


def divided(text: str, lexicon: Lexicon):
    """(place of the mark, end) of each word divided over two lines; compounds and mail addresses are none."""
    for m in _BREAK.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 40), m.start())
        if not before:
            continue
        if m.group(1) == "-":
            left, right = before.group().lower(), m.group(2).lower()
            if f"{left}-{right}" in lexicon.words or _MAIL_AFTER.match(text, m.end()):
                continue
            start = text.rfind(" ", 0, before.start()) + 1
            if "@" in text[start : m.start()]:
                continue
        yield m.start(), m.end()


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """Indices of the lines that are running headers, and of those that bear a page's number."""
    bare = [line.strip() for line in lines]
    sure = {i for i, b in enumerate(bare) if b and len(b) <= 24 and PAGE_SURE.fullmatch(b)}
    maybe = [i for i, b in enumerate(bare) if b and len(b) <= 7 and PAGE_BARE.fullmatch(b)]
    masked: dict[str, list[int]] = {}
    for i, b in enumerate(bare):
        if 6 <= len(b) <= 110 and i not in sure:
            key = b.lower()
            key = _AT_END.sub(lambda m: m.group()[0], key)
            # misread glyphs in a header do not make it another one
            masked.setdefault(_DIGITS.sub("#", skeleton(key)), []).append(i)
    # the numbers of pages without a word rise by one from page to page
    numbers = [(i, _number(bare[i].lower())) for i in maybe]
    rising = set()
    for (i, x), (j, y) in zip(numbers, numbers[1:]):
        if y == x + 1 and bare[i].isdigit() == bare[j].isdigit():
            rising |= {i, j}
    for i, x in numbers:
        # or the line stands apart: indented, or before the end of a page
        if lines[i][:4] == "    " or (i + 1 < len(lines) and lines[i + 1 : i + 2] == ["\f"]):
            rising.add(i)
    pages = sure | rising
    filled = [i for i, b in enumerate(bare) if b]
    at = {i: k for k, i in enumerate(filled)}

    def breaks_in(i: int) -> bool:
        k = at[i]
        before = next((filled[j] for j in range(k - 1, -1, -1) if filled[j] not in pages and bare[filled[j]] != bare[i]), None)
        after = next((filled[j] for j in range(k + 1, len(filled)) if filled[j] not in pages), None)
        if (k and filled[k - 1] in pages) or (k + 1 < len(filled) and filled[k + 1] in pages):
            return True
        return (before is not None and not bare[before].endswith(_ENDS)) and (after is not None and bare[after][:1].islower())

    headers: set[int] = set()
    for places in masked.values():
        line = bare[places[0]]
        if len(places) < 2 or "\t" in line or not any(c.isalpha() for c in line) or len(_RUNNING_WORD.findall(line)) > 1:
            continue
        numbered = any(c.isdigit() for c in line)
        if line.endswith(("”", ";", ",")) or line.endswith(".") and (numbered or not line.lower().endswith(("ltd.", "co.", "corp.", "inc."))):
            continue
        # a heading with a number or a mark of its own; any other repeated line only where it breaks into the text
        own = _HEADING_MARK.search(line) and line[:1].isupper() and (numbered or line.isupper())
        if own or any(breaks_in(i) for i in places):
            headers |= set(places)
    for i in headers:
        if _AT_END.search(bare[i]):
            pages.add(i)
    return headers, pages


def noise_of(text: str, lexicon: Lexicon, row: list[str] | None = None) -> list[str]:
    """The kinds of noise that occur in a text, misreadings of doubtful forms left to their neighbours if the lexicon has none. row: its words."""
    out = []
    if next(divided(text, lexicon), None):
        out.append("hyphen_break")
    form = lexicon.true_form
    words = lexicon.words
    row = _WORD.findall(text.lower()) if row is None else row
    own = set(row)
    if any(form(w) for w in own if w not in words) or any(lexicon.short_form(w.lower()) for w in set(_ALONE.findall(text))):
        out.append("misread")
    elif lexicon.beside and not own.isdisjoint(lexicon.doubtful) and any(lexicon.meant(*x) for x in lexicon.pending(row)):
        out.append("misread")
    if "\n" in text or "\f" in text:
        headers, pages = furniture(split_lines(text))
        if headers:
            out.append("running_header")
        if pages:
            out.append("page_number")
    return out


def split_lines(text: str) -> list[str]:
    """Lines without their ends; the end of a page is a line of its own."""
    return text.replace("\r\n", "\n").replace("\f", "\n\f\n").split("\n")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("rec_id"), "text")
    ex = table(spark, sf_dir, "extraction_results").select(F.lit("extraction").alias("src"), F.col("extraction_id").alias("rec_id"), "text")
    return spread(docs, "rec_id").unionByName(spread(ex, "rec_id")).where("text <> ''")


def _lexicon(texts: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """The frequent forms and what stands beside the doubtful ones: their number is bound by SHARE, not by the size of the corpus."""
    rows = [tuple(r) for r in frequent_forms(texts).collect()]
    return rows, contexts(texts, rows)


_JUDGED = "src string, rec_id bigint, noise_kind string, forms array<string>, befores array<string>, afters array<string>, form string, beside string, n bigint"


def noise(texts: DataFrame) -> DataFrame:
    """texts(src, rec_id, text) -> a row (src, rec_id, noise_kind) for each kind in each record.

    Null, empty and blank texts have none; rows that repeat give repeated rows; whole texts
    are read; an empty table gives an empty result; extra columns are not looked at. One pass
    counts the words. A second one judges the records and counts what stands beside the doubtful
    forms; records whose only misreadings may be such forms wait for these counts.
    """
    rows = [tuple(r) for r in frequent_forms(texts).collect()]
    kinds = [pa.string(), pa.int64(), pa.string()] + [pa.list_(pa.string())] * 3 + [pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in _JUDGED.split(", ")]

    def run(batches):
        lexicon = Lexicon(rows)
        for batch in batches:
            out, n = [], Counter()
            for src, rec, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                row = _WORD.findall(text.lower())
                found = noise_of(text, lexicon, row)
                out += [(src, rec, kind, None, None, None, None, None, None) for kind in found]
                if lexicon.doubtful:
                    n.update(lexicon.around(row))
                    waits = lexicon.pending(row) if "misread" not in found else ()
                    if waits:
                        out.append((src, rec, "misread", *(list(c) for c in zip(*waits)), None, None, None))
            out += [(None, None, None, None, None, None, f, x, k) for (f, x), k in n.items()]
            cols = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    judged = texts.select("src", "rec_id", "text").mapInArrow(run, _JUDGED)
    sure = lambda d: d.where("n is null and forms is null").select("src", "rec_id", "noise_kind")
    if not doubtful_forms(rows):
        return sure(judged)
    judged = cut(judged)
    # at most (forms) x 2 x (frequent words)
    beside = [tuple(r) for r in judged.where("n is not null").groupBy("form", "beside").agg(F.sum("n").alias("n")).collect()]

    def decide(batches):
        lexicon = Lexicon(rows, beside)
        for batch in batches:
            waits = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))
            hit = pa.array([any(lexicon.meant(*x) for x in zip(*w)) for w in waits], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(hit) for i in range(3)], names=names[:3])

    decided = judged.where("forms is not null").mapInArrow(decide, "src string, rec_id bigint, noise_kind string")
    return sure(judged).unionByName(decided)


def repaired(texts: DataFrame) -> DataFrame:
    """texts(src, rec_id, text) -> (src, rec_id, text) of the records with noise, as continuous paragraphs.

    (src, rec_id) names a record; rows that repeat it are taken once.
    """
    lexicon_rows = _lexicon(texts)

    def only_noisy(batches):
        lexicon = Lexicon(*lexicon_rows)
        for batch in batches:
            yield batch.filter(pa.array([bool(t and noise_of(t, lexicon)) for t in batch.column(2).to_pylist()], pa.bool_()))

    def lines(batches):
        lexicon = Lexicon(*lexicon_rows)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for src, rec, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                marks = {a for a, _ in divided(text, lexicon)}
                marked = "".join("\ue000" if i in marks else c for i, c in enumerate(text)) if marks else text
                ls = split_lines(marked)
                headers, pages = furniture(ls)
                for i, line in enumerate(ls):
                    bare = line.strip()
                    if i in headers or i in pages or bare == "\f":
                        continue
                    hyphen = bare.endswith("\ue000")
                    out[0].append(src)
                    out[1].append(rec)
                    out[2].append(i)
                    out[3].append(bare.rstrip("\ue000"))
                    out[4].append(hyphen)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["src", "rec_id", "no", "line", "divided"])

    def mended(batches):
        lexicon = Lexicon(*lexicon_rows)
        like = lambda w, true: w if not true else true.upper() if w.isupper() and len(w) > 1 else true.capitalize() if w[:1].isupper() else true

        def mend(text):
            found = list(_WORD.finditer(text))
            low = [m.group().lower() for m in found]
            parts, at = [], 0
            for i, m in enumerate(found):
                true = lexicon.meant(low[i], low[i - 1] if i else "", low[i + 1] if i + 1 < len(low) else "")
                if true:
                    parts += [text[at : m.start()], like(m.group(), true)]
                    at = m.end()
            return "".join([*parts, text[at:]])

        for batch in batches:
            fixed = [_ALONE.sub(lambda m: like(m.group(), lexicon.short_form(m.group().lower())), mend(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fixed, pa.string())], names=["src", "rec_id", "text"])

    # only records with noise are shuffled
    one = texts.select("src", "rec_id", "text").mapInArrow(only_noisy, "src string, rec_id bigint, text string").dropDuplicates(["src", "rec_id"])
    flat = one.mapInArrow(lines, "src string, rec_id bigint, no int, line string, divided boolean")
    order = Window.partitionBy("src", "rec_id").orderBy("no")
    filled = flat.withColumn("gap", F.lag("line").over(order) == "").where("line <> ''")
    before = filled.withColumn("joins", F.coalesce(F.lag("divided").over(order), F.lit(False))).withColumn("prev", F.lag("line").over(order))
    # an empty line that the page's edge left inside a sentence ends no paragraph
    inside = F.col("joins") | (~F.coalesce(F.col("prev"), F.lit(".")).rlike(r"[.!?:;”\")\]]$") & F.col("line").rlike(r"^\p{Ll}"))
    glue = F.when(F.col("prev").isNull() | F.col("joins"), "").when(F.col("gap") & ~inside, "\n\n").otherwise(" ")
    parts = before.select("src", "rec_id", "no", F.concat(glue, F.col("line")).alias("part"))
    text = parts.groupBy("src", "rec_id").agg(F.sort_array(F.collect_list(F.struct("no", "part"))).alias("p"))
    return text.select("src", "rec_id", F.array_join(F.col("p.part"), "").alias("text")).mapInArrow(mended, "src string, rec_id bigint, text string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(_sources(spark, sf_dir))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_sources(spark, sf_dir))


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent forms by skeleton that decide what is a misread word."""
    return frequent_forms(_sources(spark, sf_dir))
