"""Problem 4: personal data in free text, and its replacement by typed placeholders.

Numbers are found by the national plans of numbers: their form, their label, the language of the
text, and their check characters. Persons are found by given names, titles, initials, the
company they keep in a sentence, and a statistic of the corpus: words that it also writes in small
letters are ordinary ones and no family names.

A placeholder bears a pseudonym made by a keyed Feistel permutation within the format of the
value: phone and identity numbers keep their length and separators, country codes stay,
check characters that were right are right again, other values become a number of eight digits.
Equal values so keep equal pseudonyms in all documents however they are written, and only who has
the key can go back from a number's pseudonym to the number.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import os
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, spread, table

#: Common given names of the four languages. More may be given as a parameter.
GIVEN = frozenset(
    """abigail alexander amelia andrew angela anthony barbara benjamin bernard brian carol catherine charles charlotte christine christopher daniel david deborah donald
    dorothy douglas edward eleanor elizabeth emily emma eric florence frank frederick gabriel gary george gerald gregory hannah harold helena henry irene isabella
    jack jacob james jason jeffrey jennifer jessica john jonathan joseph joshua karen kenneth kevin kimberly konstantin larry laura lawrence leonard liam lillian linda lisa
    lucas margaret maria mark martha mary mason matthew melissa michael michelle nancy natalie nathaniel nicholas noah olivia patricia patrick paul penelope peter
    philip rachel raymond rebecca richard robert ronald ryan samuel sandra sarah scott sophia stephanie stephen steven susan theodore theresa thomas timothy victoria vincent
    walter william winifred
    alejandro álvaro ana antonio begoña carlos carmen diego esteban francisco guadalupe ignacio íñigo isabel javier joaquín josé juan lucía luis manuel marisol miguel núria pablo pedro pilar rocío
    anne aurélie benoît camille chloé claire françois gaël hélène jacques julien louis maëlle océane pierre rémi sophie thibault
    anna anneliese günther hans heike jörg jürgen karl käthe klaus liesel markus monika sabine sönke stefan ursula wiebke wolfgang""".split()
)
#: What stands before a person's name and does not belong to it.
TITLE = re.compile(r"(?:(?<!\w)(?:Mr|MR|Mrs|MRS|Ms|MS|Mx|MX|Dr|DR|Hon|HON|Sr|SR|Sra|SRA|Dña|DÑA|Mme|MME|Mlle|M|D)\.?|(?<!\w)(?:Ju(?:dg|dq|clg)e|JUDGE|Justice|JUSTICE|Of(?:fi|fl|ﬁ)cer|OFFICER|Herr|HERR|Frau|FRAU|RA|RAin|Me|ME|Don|Doña|Mme|MME))\s+$")
#: Titles that are an initial in other languages than the one named.
TITLE_OR_INITIAL = {"M.": "fr", "D.": "es"}
#: Words in the names of companies, which are no persons.
TRADE = frozenset(
    """freight engineering insurance distribution foundry manufacturing logistics construction properties hospital brewing
    petroleum software mining savings dairy transport chemical marine electric investments equipment development textiles
    holdings pharmacy mutual railway publishing laboratories pllc llp pc llc lp ltd inc corp co""".split()
)
_CAP = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W_]+")
_INITIALS = re.compile(r"(?<![\w.])[A-ZÀ-ÖØ-Þ]\.\s+(?:[A-ZÀ-ÖØ-Þ]\.\s+)?$")
_MIDDLE = re.compile(r"\s+(?:[A-ZÀ-ÖØ-Þ]\.\s+)?(?:(?:de|del|la|las|los|le|van|von|der|den|di|da|du|zu|zur|ter)\s+)*(?:[OD]['’])?")
_COMMA = re.compile(r",\s+")
_AFTER_GIVEN = re.compile(r"\s[A-ZÀ-ÖØ-Þ]\.(?!\s*[A-ZÀ-ÖØ-Þ]\.)")
_NO_FAMILY = frozenset("the and court county district division page case rule docket exhibit section street avenue boulevard".split())
#: What may stand with a capital after a title or an initial and is no family name.
_NO_NAME = _NO_FAMILY | TRADE | frozenset(
    """no yes in of for to by at on it he she they we you this that there these those is was did do does if when where what which who why how not but or as so all any
    department general chief magistrate judge justice officer presiding senior associate advocate attorney counsel honorable pro tem clerk plaintiff defendant appellant appellee
    president director chairman secretary professor doctor dear sir madam article chapter title part schedule appendix annex volume paragraph item state federal united
    supreme superior appeal appeals system act code herr frau señor señora don doña madame monsieur maître mr mrs ms mx dr hon sr sra mme mlle ra rain me""".split()
)
#: Titles that are ordinary words too; the word after them must not occur in small letters in the text.
_WEAK_TITLE = frozenset("judge judqe juclge justice officer me ra rain m d don".split())
_BEFORE_NO_INITIAL = re.compile(r"(?:^|[.:;?!\x1e\])”\"—|]\s*|\b(?:exhibit|section|part|schedule|appendix|group|title|class|item|annex|annexe|anexo|anlage|teil|clause|paragraph|division|count|plan|type|unit|apt)\.?\s+)$", re.I)
#: Letters of questions and answers; as an initial only within a sentence.
_QUESTION = frozenset("QAPRF")
_IN_SENTENCE = re.compile(r"(?<!\w)(?![ivxl]+\s)[a-zà-ÿ]+,?\s+$")
#: What stands before a place, and before or after a person.
_PLACE_BEFORE = re.compile(r"(?<!\w)(?:in|at|near|en|à|bei|nach|aus|près)\s+(?:[A-ZÀ-Þ]\w+\s+)?$")
_PERSON_BEFORE = re.compile(
    r"(?<!\w)(?:plaintiffs?|defendants?|appell(?:ant|ee)s?|respondents?|petitioners?|witness(?:es)?|attorneys?|counsel|client|dear|deponent|declarant|affiant|custodian|guardian|tenant|landlord|husband|wife|named|signed|/s/|by:?)\s+$", re.I)
_PERSON_AFTER = re.compile(r"\s+(?:testified|testifies|said|says|stated|states|declare[sd]?|signed|swore|deposed|replied|answered|asked|called|wrote|alleges?|alleged|died|was born)(?!\w)")
#: Letters of questions with those of their answers.
_TRANSCRIPT = (("Q", "A"), ("F", "A"), ("P", "R"), ("Q", "R"))
_LETTER = re.compile(r"(?<![\w.])([QAFPR])[.:]\s")
_JOINED = re.compile(r",?\s+(?:and|or|y|e|et|und)\s+$|,\s+$")
_PARTICLES = re.compile(r"(?<!\w)(?:(?:de|del|la|las|los|le|van|von|der|den|di|da|du|zu|zur|ter)\s+)+$|(?<!\w)[OD]['’]$")
_SECOND_PART = re.compile(r"[-'’][A-ZÀ-ÖØ-Þ][^\W_]+")

_WS = r"[ ]{1,4}"
_TOWN = r"[A-ZÀ-Þ][a-zà-ÿ]+(?:[ -](?!Re\b|Subject\b|Dated\b|Sincerely\b|Respectfully\b)[A-ZÀ-Þ][a-zà-ÿ]+)?|[A-ZÀ-Þ]{3,}(?:[ -](?!RE\b|SUBJECT\b)[A-ZÀ-Þ]{3,})?"
_ZIP = r"\d{5}(?:-\d{4})?(?!\d)"
_TAIL = rf"(?:,? (?:(?:Apt|APT|Unit|UNIT)\.?|Suite|SUITE|Ste\.?) ?\w+)?(?:, ?(?:{_TOWN})(?:,? {_ZIP})?)?"
_STREET_KIND = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Way|Drive|Dr|Court|Ct|Terrace|Boulevard|Blvd|Place|Pl|STREET|ST|AVENUE|AVE|ROAD|LANE|WAY|DRIVE|COURT|TERRACE|BOULEVARD)\b\.?"
ADDRESS = [
    (re.compile(rf"\d{{1,5}} (?:(?:North|South|East|West|NORTH|SOUTH|EAST|WEST|N\.|S\.|E\.|W\.) )?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)? {_STREET_KIND}(?! of\b){_TAIL}"), None),
    (re.compile(rf"P\.? ?O\.? (?:Box|BOX) \d+{_TAIL}"), "ox "),
    (re.compile(rf"(?:Calle|CALLE|C/|Avda\. de|AVDA\. DE|Avenida(?: de)?|Plaza(?: de)?|Paseo(?: de)?) ?[A-ZÀ-Þ][\w'’-]+,?(?: (?:núm\.|NÚM\.|n\.º|nº))? ?\d{{1,5}}(?:, \d{{1,2}}\.º ?[A-Z])?(?:, (?:\d{{5}} )?(?:{_TOWN}))?"), None),
    (re.compile(rf"\d{{1,5}}(?: (?:bis|ter|BIS|TER))?,? (?:rue|avenue de|avenue|impasse|boulevard|place|allée|chemin|quai|RUE|AVENUE DE|IMPASSE)(?: de| du)? [A-ZÀ-Þ][\w'’-]+(?:, (?:\d{{5}} )?(?:{_TOWN}))?"), None),
    (re.compile(rf"(?:(?:Am|AM|An der|Im) [A-ZÀ-Þ][\w'’-]+|[A-ZÀ-Þ][\w]+(?:straße|weg|gasse|platz|allee|ring|STRASSE|STRAßE|WEG|GASSE)) \d{{1,4}} ?[a-z]?\b(?:, (?:\d{{5}} )?(?:{_TOWN}))?"), None),
]
_ADDRESS_CUE = [
    None,
    None,
    re.compile(r"Calle|CALLE|C/|Avda|AVDA|Avenida|Plaza|Paseo"),
    re.compile(r"\d,? (?:rue|avenue|impasse|boulevard|RUE|AVENUE|IMPASSE)|bis "),
    re.compile(r"(?:Am|AM|Im) [A-ZÀ-Þ]|straße|weg |gasse|STRA|WEG "),
]

_AT = re.compile(r" ?\[at\] ?| ?\(at\) ?|@", re.I)
_MAIL_USER = re.compile(r"[\w.+-]+$")
_MAIL_HOST = re.compile(r"[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[\w-]+)+", re.I)

#: How phone numbers are written. Named forms count only after a label or, where the name is a language, in a text of it.
PHONE = re.compile(
    r"(?<![\w$€+(/.-])(?:"
    r"(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+1[ .-]?|1[ .-])\d{3}([ .-])\d{3}\1\d{4}|\+1\d{10}"
    r"|[2-9]\d{2}([ .-])[2-9]\d{2}\2\d{4}|(?P<plain>[2-9]\d{2}[2-9]\d{6})"
    r"|(?:\+|00)34[ .-]?[6-9]\d(?:[ .-]?\d){7}|(?<!\d[ .-])[6-9]\d{2}([ .-])(?:\d{3}\4\d{3}|\d{2}\4\d{2}\4\d{2})|(?P<es>[6-9]\d{8})"
    r"|(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d{2}){4}|(?<!\d[ .-])0[1-9]([ .-])\d{2}(?:\6\d{2}){3}|(?P<fr>0[1-9]\d{8})"
    r"|(?:\+|00)49[ .-]?(?:\(0\) ?)?\(?[1-9]\d{1,4}\)?(?: ?[/-] ?| )?\d{3,8}(?:[ -]\d{1,5}){0,2}|\(0[1-9]\d{1,4}\) ?\d{3,8}(?:[ -]\d{1,5}){0,2}|0[1-9]\d{1,4} / \d{3,8}(?:[ -]\d{1,5}){0,2}|(?P<de>(?<!\d[ .-])0[1-9]\d{1,4}(?: ?[/-] ?| )\d{3,8}(?:[ -]\d{1,5}){0,2})|(?P<label>0[1-9]\d{5,12})"
    r"|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}"
    r")(?![\w/]|[.-]\d)"
)
#: Words that lead to a number in a sentence.
_REACHED = re.compile(r"(?<!\w)(?:at|on|au|al|el|unter)\s+$", re.I)
#: What stands before numbers that are nobody's.
_NO_PHONE = re.compile(r"(?:case|docket|file|invoice|lot|exhibit|page|item|account|policy|parcel|ref(?:erence)?|id|bates|serial|tracking|no|nr|nº|n°|#)\.?\s*(?:no\.?|number|nr\.?|#)?\s*:?\s*$", re.I)
#: What stands before a phone number; the named forms of PHONE count only after it.
_PHONE_LABEL = re.compile(
    r"(?<!\w)(?:tel(?:ephone|éfono|efon|éphone|efax)?|(?:cell|mobile)?\s?phone|call(?:ed|ing|s)?|fax|cell|mobile|móvil|llamar|portable|appeler|mobil|handy|rufnummer|dial(?:ed|ing)?)\.?\s*(?:numbers?|no\.?|n[°ºo]\.?|nr\.?)?\s*:?\s*(?:at|to|is|was|al|au|unter)?\s*$", re.I)
#: What stands after an amount of money.
_AMOUNT = re.compile(r"\s?(?:€|\$|EUR\b|USD\b|euros?\b|dollars?\b)")
#: How numbers issued to persons are written, with their labels where the form alone does not tell.
IDENTITY = re.compile(
    r"(?<![\w$€/.-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}"
    r"|[A-Z]-\d{3}-\d{4}|[A-Z]\d{7,8}"
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"
    r"|[12] \d{2} \d{2} [\dAB]{2} \d{3} \d{3} \d{2}|\d{2}[A-Z]{2}\d{5}"
    r"|[A-Z]\d{3}[A-Z]\d{4}|\d{2} \d{3} \d{3} \d{3}|[1-9]\d{10}"
    r")(?![\w/]|-\d)"
)
#: Forms of IDENTITY that count only after a label.
_NEEDS_LABEL = re.compile(r"\d{9}|\d{11}|\d{3} \d{2} \d{4}|[A-Z]\d{7,8}|\d{2} \d{3} \d{3} \d{3}|\d{2}[A-Z]{2}\d{5}|[A-Z]\d{3}[A-Z]\d{4}|[A-Z]-\d{3}-\d{4}")
_LABEL = re.compile(
    r"(?:SSN|social\s+security(?:\s+(?:number|no\.?))?|taxpayer\s+identification(?:\s+number)?|licen[sc]e(?:\s+no\.?)?|DL|passport(?:\s+(?:no\.?|number))?|DNI|NIE|pasaporte"
    r"|Steuer-ID|Personalausweis|Reisepass|identité|sociale|passeport)\s*(?:n[°ºo]\.?|#|:)?\s*(?:page\s+\d+(?:\s+of\s+\d+)?\s+)?$", re.I)  # fmt: skip
#: Where a phone or identity number may be; only these places are looked at closely.
_NUMBER = re.compile(r"\d[\dA-Z ()./+-]{5,}")
_INSIDE = re.compile(r"[\w/-]")
_DIGITS = re.compile(r"\d{2}")

_BROKEN = re.compile(r"[-¬­][ \t]*\r?\n\s*(?=[^\W\d_])")
_RUN = re.compile(r" {2,}")


class Flat:
    """The text with line ends as spaces and divided words joined, and the way back to its places."""

    def __init__(self, text: str):
        self.starts: list[int] = []
        if ("-" in text or "¬" in text or "­" in text) and _BROKEN.search(text):
            parts, at, gone = [], 0, 0
            self.gone: list[int] = []
            for m in _BROKEN.finditer(text):
                if not text[m.start() - 1 : m.start()].isalpha():
                    continue
                parts.append(text[at : m.start()])
                at = m.end()
                gone += m.end() - m.start()
                self.starts.append(m.end() - gone)
                self.gone.append(gone)
            parts.append(text[at:])
            text = "".join(parts)
        flat = text.replace("\n", " ").replace("\r", " ").replace("\t", " ").replace("\f", " ")
        if "  " in flat:  # runs of spaces are one space, empty lines one separator that no item runs over
            parts, at, gone, starts, went = [], 0, 0, [], []
            for m in _RUN.finditer(flat):
                parts.append(flat[at : m.start()])
                parts.append("\x1e" if text.count("\n", m.start(), m.end()) > 1 else " ")
                at = m.end()
                gone += m.end() - m.start() - 1
                starts.append(m.end() - gone)
                went.append(gone)
            parts.append(flat[at:])
            flat = "".join(parts)
            self.second = (starts, went)
        else:
            self.second = None
        self.text = flat

    def place(self, i: int, end: bool = False) -> int:
        """Where a place of the flat text is in the text itself (ends: after the character before it)."""
        if end:
            return self.place(i - 1) + 1
        if self.second:
            k = bisect.bisect_right(self.second[0], i)
            i += self.second[1][k - 1] if k else 0
        if self.starts:
            k = bisect.bisect_right(self.starts, i)
            i += self.gone[k - 1] if k else 0
        return i


class Places:
    """Places [a, b) that do not overlap, looked up by search."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class Names:
    """Finds the persons of one text. ordinary: words that the corpus writes in small letters, or None if not known."""

    def __init__(self, s: str, taken: Places, ordinary: frozenset | None, given: frozenset):
        self.s, self.taken, self.corpus, self.given = s, taken, ordinary, given
        self._small: frozenset | None = None
        self._tongue = ""
        self._transcript: bool | None = None
        self.caps = [(m.start(), m.end(), m.group()) for m in _CAP.finditer(s)]
        self.out: list[tuple[int, int]] = []
        self.places = Places()
        self.known: set[str] = set()
        self.maybe: list[tuple[int, int, str]] = []

    @property
    def tongue(self) -> str:
        self._tongue = self._tongue or language(self.s)
        return self._tongue

    @property
    def transcript(self) -> bool:
        """Whether the text has questions and answers by letter."""
        if self._transcript is None:
            letters = set(_LETTER.findall(self.s))
            self._transcript = any(q in letters and a in letters for q, a in _TRANSCRIPT)
        return self._transcript

    def ordinary(self, low: str) -> bool:
        """Whether a word is also written in small letters, here or commonly in the corpus."""
        if self.corpus is not None and low in self.corpus:
            return True
        if low not in self.s:  # as any part of the text
            return False
        if self._small is None:
            self._small = frozenset(_SMALL_WORD.findall(self.s))
        return low in self._small

    def free(self, a: int, b: int) -> bool:
        return self.taken.free(a, b) and self.places.free(a, b)

    def keep(self, a: int, b: int, low: str) -> None:
        self.out.append((a, b))
        self.places.add(a, b)
        self.known.add(low)

    def title(self, start: int) -> bool:
        """Whether a title stands before a place; titles that are ordinary words or initials elsewhere count in their language."""
        m = TITLE.search(self.s, max(0, start - 12), start)
        if not m:
            return False
        t = m.group().strip()
        return t not in TITLE_OR_INITIAL or TITLE_OR_INITIAL[t] == self.tongue

    def family(self, w: str) -> bool:
        """Whether a capitalised word may be a family name."""
        low = w.lower()
        return len(w) > 1 and low not in _NO_NAME and not any(c.isdigit() for c in w)

    def after(self, end: int, i: int) -> tuple | None:
        """The next capitalised word if it follows at once."""
        nxt = self.caps[i + 1] if i + 1 < len(self.caps) else None
        return nxt if nxt and nxt[0] >= end and nxt[0] - end <= 3 and self.s[end : nxt[0]].isspace() else None

    def whole_end(self, b: int) -> int:
        more = _SECOND_PART.match(self.s, b)
        return more.end() if more else b

    def given_and_family(self, i: int) -> bool:
        a, b, w = self.caps[i]
        nxt = self.caps[i + 1] if i + 1 < len(self.caps) else None
        if w.lower() not in self.given or not nxt:
            return False
        low = nxt[2].lower()
        if low in self.given or low in _NO_FAMILY or len(nxt[2]) < 3 or not _MIDDLE.fullmatch(self.s, b, nxt[0]):
            return False
        end = self.whole_end(nxt[1])
        follows = self.after(end, i + 1)
        if low in TRADE or (follows and follows[2].lower().rstrip(".") in TRADE and self.s[a:b].lower() not in ("",) and not self.title(a) and len(follows[2]) > 2 and follows[2].lower() not in ("co", "pc")) or not self.free(a, end):
            return False
        self.keep(a, end, low)
        return True

    def inverted(self, i: int) -> bool:
        """Family name, comma, given name and perhaps an initial, unless the given name begins a name of its own."""
        a, b, w = self.caps[i]
        nxt = self.caps[i + 1] if i + 1 < len(self.caps) else None
        if not nxt or nxt[2].lower() not in self.given or w.lower() in self.given or not self.family(w) or not _COMMA.fullmatch(self.s, b, nxt[0]):
            return False
        if self.ordinary(w.lower()) or _PLACE_BEFORE.search(self.s, max(0, a - 24), a):
            return False
        third = self.caps[i + 2] if i + 2 < len(self.caps) else None
        own = lambda at: third and self.family(third[2]) and third[2].lower() not in self.given
        if third and own(0) and _MIDDLE.fullmatch(self.s, nxt[1], third[0]):
            return False
        m = _AFTER_GIVEN.match(self.s, nxt[1])
        end = m.end() if m and not (own(0) and self.s[m.end() : third[0]].strip() == "") else nxt[1]
        if not self.free(a, end):
            return False
        self.keep(a, end, w.lower())
        return True

    def with_title_or_initials(self, i: int) -> bool:
        s = self.s
        a, b, w = self.caps[i]
        low = w.lower()
        if a < 2 or low in self.given or not self.family(w):
            return False
        part = _PARTICLES.search(s, max(0, a - 20), a)
        start = part.start() if part else a
        if not s[start - 1].isspace() and not (part and part.group()[0] in "OD"):
            return False
        end = self.whole_end(b)
        nxt = self.after(end, i)
        if nxt and nxt[2].lower().rstrip(".") in TRADE:
            return False
        if self.title(start):
            m = TITLE.search(s, max(0, start - 12), start).group().strip().rstrip(".").lower()
            if m in _WEAK_TITLE and self.ordinary(low):
                return False
            # a given name that is not listed, with its family name
            if nxt and end == b and not w.isupper() and not nxt[2].isupper() and s[end : nxt[0]] == " " and self.family(nxt[2]) and self.tongue != "de" and not self.ordinary(nxt[2].lower()):
                end, low = nxt[1], nxt[2].lower()
            if self.free(start, end):
                self.keep(start, end, low)
                return True
            return False
        m = _INITIALS.search(s, max(0, start - 8), start)
        if not m or len(w) < 3 or self.ordinary(low) or not self.free(m.start(), end):
            return False
        if m.group().count(".") < 2 and (_BEFORE_NO_INITIAL.search(s, max(0, m.start() - 14), m.start()) or (m.group()[0] in _QUESTION and not _IN_SENTENCE.search(s, max(0, m.start() - 24), m.start()))):
            # it may be the letter of a question, an answer or a heading: then a sentence follows, or an ordinary word
            if self.corpus is None or (m.group()[0] in _QUESTION and (self.transcript or w.capitalize() in self.corpus) and not _PERSON_AFTER.match(s, end)):
                self.maybe.append((m.start(), end, low))
                return False
        self.keep(m.start(), end, low)
        return True

    def in_company(self, i: int) -> bool:
        """Two capitalised words that are no ordinary ones, beside a word that goes with persons or joined to a person."""
        s = self.s
        a, b, w = self.caps[i]
        nxt = self.caps[i + 1] if i + 1 < len(self.caps) else None
        if not nxt or not self.family(w) or not self.family(nxt[2]) or w.isupper() or nxt[2].isupper() or not _MIDDLE.fullmatch(s, b, nxt[0]):
            return False
        end = self.whole_end(nxt[1])
        follows = self.after(end, i + 1)
        if (follows and (follows[2].lower().rstrip(".") in TRADE or follows[2].lower() in _NO_NAME)) or s[end : end + 2] == " &" or s[max(0, a - 2) : a] == "& " or not self.free(a, end):
            return False
        joined = _JOINED.search(s, max(0, a - 8), a)
        with_person = joined and self.places.ends and any(e == joined.start() for e in self.places.ends[-2:])
        if not (with_person or _PERSON_BEFORE.search(s, max(0, a - 16), a) or _PERSON_AFTER.match(s, end)):
            return False
        if self.ordinary(w.lower()) or self.ordinary(nxt[2].lower()):
            return False
        self.keep(a, end, nxt[2].lower())
        return True

    def alone(self) -> None:
        """Family names of persons that are named elsewhere in the text."""
        s = self.s
        for a, b, low in self.maybe:
            if low in self.known and self.free(a, b):
                self.keep(a, b, low)
        for i, (a, b, w) in enumerate(self.caps):
            low = w.lower()
            if low not in self.known or not self.free(a, b):
                continue
            nxt = self.caps[i + 1] if i + 1 < len(self.caps) else None
            if nxt and nxt[2].lower() in TRADE and nxt[0] - b <= 3:
                continue
            around = s[max(0, a - 6) : a].lower()
            if around.endswith(("near ", "& ", "and ")) or s[b : b + 2] in (" &", ", ") and "&" in s[b : b + 40]:
                continue
            if re.search(r"(?:[a-zß]|ado|ido|oso|é|eux) $", s[max(0, a - 14) : a]) and re.search(r"\d{4}, \w+ \w+ $", s[max(0, a - 40) : a]):
                continue
            self.out.append((a, b))
            self.places.add(a, b)

    def find(self) -> list[tuple[int, int]]:
        used = -1
        for i in range(len(self.caps)):
            if i <= used:
                continue
            if self.given_and_family(i) or self.inverted(i):
                used = i + 1
            elif self.with_title_or_initials(i):
                pass
            elif self.in_company(i):
                used = i + 1
        if self.known:
            self.alone()
        return self.out


_SMALL_WORD = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ]{2,}(?![^\W_])")


#: Small words of each language.
SMALL_WORDS = {
    "en": frozenset("the of was to for and by at that lists".split()), "es": frozenset("el la los las del de con por una en y pertenece".split()),
    "fr": frozenset("le la les du de des est au ou par et un une celle l".split()), "de": frozenset("der die das und von den an im unter ist".split()),
}
_SMALL = re.compile(r"[a-zà-ÿ]+")


def language(s: str) -> str:
    """The language of a text by its small words; en in doubt."""
    words = _SMALL.findall(s.lower())
    n = {k: sum(w in ws for w in words) for k, ws in SMALL_WORDS.items()}
    return max(n, key=n.get)


#: Check letters of Spanish numbers by the rest of their division.
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def checked(value: str) -> str:
    """The kind of number whose check characters are right: dni, nir or steuer; '' if there are none or they are wrong."""
    plain = re.sub(r"[ .-]", "", value).upper()
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", plain) and len(plain) == 9:
        number = int(plain[:-1].translate(str.maketrans("XYZ", "012")))
        return "dni" if _LETTERS[number % 23] == plain[-1] else ""
    if re.fullmatch(r"[12]\d{14}", plain):
        return "nir" if 97 - int(plain[:13]) % 97 == int(plain[13:]) else ""
    if re.fullmatch(r"[1-9]\d{10}", plain):
        return "steuer" if _mod11(plain[:10]) == int(plain[10]) else ""
    return ""


def _mod11(digits: str) -> int:
    """Check digit after ISO 7064, mod 11,10."""
    product = 10
    for d in digits:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10


def find_items(text: str, ordinary: frozenset | None = None, given: frozenset = GIVEN) -> list[tuple[str, int, int]]:
    """(pii_type, start, end) of every item, in order; places are counted in code points."""
    flat = Flat(text)
    s = flat.text
    out: list[tuple[str, int, int]] = []
    taken = Places()

    def take(kind: str, a: int, b: int) -> bool:
        if not taken.free(a, b):
            return False
        out.append((kind, a, b))
        taken.add(a, b)
        return True

    for at in _AT.finditer(s):
        user = _MAIL_USER.search(s, max(0, at.start() - 64), at.start())
        host = _MAIL_HOST.match(s, at.end())
        if user and host:
            take("email", user.start(), host.end() - (host.group()[-1] in "-_"))
    if _DIGITS.search(s):
        for k, (pattern, cue) in enumerate(ADDRESS):
            gate = _ADDRESS_CUE[k]
            if (cue and cue not in s and cue.upper() not in s) or (gate and not gate.search(s)):
                continue
            for m in pattern.finditer(s):
                if not (s[m.start()].isdigit() and _INSIDE.match(s[m.start() - 1 : m.start()])):
                    take("street_address", m.start(), m.end())
        runs = [(m.start(), m.end()) for m in _NUMBER.finditer(s)]
        tongue = ""
        for m in (m for a, b in runs for m in PHONE.finditer(s, max(0, a - 3), min(len(s), b + 2))):
            if _LABEL.search(s, max(0, m.start() - 70), m.start()) or _AMOUNT.match(s, m.end()):
                continue
            if m.lastgroup and not _PHONE_LABEL.search(s, max(0, m.start() - 40), m.start()):
                tongue = tongue or language(s)
                if (m.lastgroup not in ("plain", tongue) and not (m.lastgroup == "fr" and _REACHED.search(s, max(0, m.start() - 8), m.start()))) or _NO_PHONE.search(s, max(0, m.start() - 24), m.start()):
                    continue
            take("phone", m.start(), m.end())
        for m in (m for a, b in runs for m in IDENTITY.finditer(s, max(0, a - 3), min(len(s), b + 2))):
            if _NEEDS_LABEL.fullmatch(m.group()) and not checked(m.group()) and not _LABEL.search(s, max(0, m.start() - 70), m.start()):
                continue
            take("identity_number", m.start(), m.end())
    out += [("name", a, b) for a, b in Names(s, taken, ordinary, given).find()]
    return sorted(((t, flat.place(a), flat.place(b, end=True)) for t, a, b in set(out)), key=lambda x: (x[1], x[2]))


#: A word is ordinary if it stands in small letters in at least this share of the texts, and it begins sentences if it stands
#: with a capital in at least that share. So their number is bound however large the corpus is: at most the distinct words of a
#: text / ORDINARY. Names hardly ever stand in small letters, and few of them in so many texts.
ORDINARY, BEGINNING = 0.001, 0.004


def ordinary_words(texts: DataFrame) -> list[str]:
    """The ordinary words of texts(text), and with a capital those that begin sentences, counted over all texts by built-in SQL."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])\p{L}\p{Ll}{2,}(?![\p{L}\p{N}])"), F.lit(0)))
    # the number of texts is counted in the same pass, as an empty word
    counts = texts.where("text <> ''").select(F.explode(F.concat(F.array(F.lit("")), words)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    seen = cut(counts.where("n >= 3"))
    total = seen.where("w = ''").select("n").first()
    if not total:
        return []
    share = F.when(F.col("w") == F.lower("w"), ORDINARY).otherwise(BEGINNING)
    out = [r.w for r in seen.where((F.col("w") != "") & (F.col("n") >= share * total.n)).select("w").collect()]
    forget(seen)
    return out


class Feistel:
    """A keyed permutation of the numbers of n digits, in alternating halves."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds

    def _mix(self, r: int, n: int, value: int, modulus: int) -> int:
        h = hashlib.blake2b(f"{r}/{n}/{value}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(h, "big") % modulus

    def permute(self, digits: str, back: bool = False) -> str:
        n = len(digits)
        if n < 2:
            return str((int(digits) + (-1 if back else 1) * self._mix(0, n, 0, 10)) % 10) if n else ""
        u = n // 2
        a, b, ma, mb = int(digits[:u]), int(digits[u:]), 10**u, 10 ** (n - u)
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._mix(r, n, a, mb)) % mb
            else:
                a = (a + sign * self._mix(r, n, b, ma)) % ma
        return f"{a:0{u}d}{b:0{n - u}d}"

    def within(self, digits: str, kind, back: bool = False) -> str:
        """digits permuted among those of the same kind(digits): the walk goes on until it meets the kind again."""
        own, fresh = kind(digits), self.permute(digits, back)
        while kind(fresh) != own:
            fresh = self.permute(fresh, back)
        return fresh

    def within_format(self, value: str, back: bool = False, kind=lambda d: None, keep: int = 0) -> str:
        """The digits of value permuted but for the first keep, everything else in its place."""
        digits = "".join(c for c in value if "0" <= c <= "9")
        fresh = iter(digits[:keep] + (self.within(digits[keep:], kind, back) if digits[keep:] else ""))
        return "".join(next(fresh) if "0" <= c <= "9" else c for c in value)

    def phone(self, value: str, back: bool = False) -> str:
        """A phone number: its country code and the zero before an area code stay, so all ways of writing one number stay one."""
        digits = "".join(c for c in value if "0" <= c <= "9")
        keep = 0
        m = re.match(r"(?:\+|00) ?(1|3[34]|49|[2-9]\d{0,2}(?=\D)|[2-9]\d)", value)
        if m:
            keep = len(m.group(1)) + 2 * value.startswith("00")
            keep += bool(re.match(r"[ .-]?\(0\)", value[m.end() :]))
        elif len(digits) == 11 and digits[0] == "1":
            keep = 1
        elif digits.startswith("0"):
            keep = 1
        return self.within_format(value, back, lambda d: (d[0] < "2", len(d) == 10 and d[3] < "2"), keep)

    def identity(self, value: str, back: bool = False) -> str:
        """An identity number; a check character that is right is made right again."""
        known = checked(value)
        if known == "dni":
            fresh = self.within_format(value, back)
            number = int(re.sub(r"\D", "", fresh.upper().translate(str.maketrans("XYZ", "012"))) if value[0] in "XYZ" else re.sub(r"\D", "", fresh))
            return fresh[:-1] + _LETTERS[number % 23]
        if known in ("nir", "steuer"):
            digits = "".join(c for c in value if "0" <= c <= "9")
            head = digits[:13] if known == "nir" else digits[:10]
            kind = (lambda d: (d[0] in "12", "01" <= d[3:5] <= "12")) if known == "nir" else (lambda d: d[0] == "0")
            head = self.within(head, kind, back)
            fresh = iter(head + (f"{97 - int(head) % 97:02d}" if known == "nir" else str(_mod11(head))))
            return "".join(next(fresh) if "0" <= c <= "9" else c for c in value)
        ssn = lambda d: len(d) == 9 and (d[:3] in ("000", "666") or d[0] == "9", d[3:5] == "00", d[5:] == "0000")
        return self.within_format(value, back, ssn)

    def date(self, day: datetime.date, back: bool = False) -> datetime.date:
        """A day of the years 1900 to 2099 for another."""
        first, n = datetime.date(1900, 1, 1).toordinal(), 73049
        if not 0 <= day.toordinal() - first < n:
            return day
        fresh = self.within(f"{day.toordinal() - first:05d}", lambda d: int(d) < n, back)
        return datetime.date.fromordinal(first + int(fresh))

    def tag(self, value: str) -> str:
        """Eight digits for a value without a numeric format, the same for equal values however they are written."""
        plain = " ".join(value.lower().split())
        h = int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), key=self.key, digest_size=8).digest(), "big")
        return self.permute(f"{h % 10**8:08d}")


def mask(text: str, items: list[tuple[str, int, int]], feistel: Feistel) -> str:
    """The text with each item as [TYPE pseudonym]; of items that overlap the first counts."""
    out, at = [], 0
    for kind, a, b in items:
        if a < at:
            continue
        value = " ".join(text[a:b].split())
        sign = feistel.phone(value) if kind == "phone" else feistel.identity(value) if kind == "identity_number" else feistel.tag(value)
        out += [text[at:a], f"[{kind.upper()} {sign}]"]
        at = b
    return "".join([*out, text[at:]])


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("rec_id"), "text"), "rec_id")
    sums = table(spark, sf_dir, "classification_results").select(F.lit("summary").alias("src"), F.col("result_id").alias("rec_id"), F.col("summary").alias("text"))
    return docs.unionByName(sums)


def personal_items(texts: DataFrame, given: frozenset = GIVEN) -> DataFrame:
    """texts(src, rec_id, text) -> a row (src, rec_id, pii_type, start_pos, end_pos) for each item.

    Null, empty and blank texts have none; repeated rows give repeated rows; whole texts are
    read however long they are; extra columns are not looked at.
    """
    ordinary = frozenset(ordinary_words(texts))

    def run(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for src, rec, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    for kind, a, b in find_items(text, ordinary, given):
                        for c, v in zip(cols, (src, rec, kind, a, b)):
                            c.append(v)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["src", "rec_id", "pii_type", "start_pos", "end_pos"])

    return texts.select("src", "rec_id", "text").mapInArrow(run, "src string, rec_id bigint, pii_type string, start_pos bigint, end_pos bigint")


def masked_texts(texts: DataFrame, key: bytes, given: frozenset = GIVEN) -> DataFrame:
    """texts(src, rec_id, text) with every item replaced; null stays null, empty stays empty. Who has the key can undo it."""
    if len(key) < 16:
        raise ValueError("a key of at least 16 bytes is needed")
    ordinary = frozenset(ordinary_words(texts))

    def run(batches):
        feistel = Feistel(key)
        for batch in batches:
            out = [mask(t, find_items(t, ordinary, given), feistel) if t else t for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["src", "rec_id", "text"])

    return texts.select("src", "rec_id", "text").mapInArrow(run, "src string, rec_id bigint, text string")


def session_key() -> bytes:
    """The key that DOCKETFORGE_PSEUDONYM_KEY holds as hexadecimal digits; without it one that this process makes up and forgets."""
    given = os.environ.get("DOCKETFORGE_PSEUDONYM_KEY")
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(_sources(spark, sf_dir))


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_texts(_sources(spark, sf_dir), session_key())
