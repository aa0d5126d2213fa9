"""Personal information in free text: labelers vote, expectation-maximisation weighs them, a classifier decides.

All lists are general knowledge about names, streets and numbering; none was drawn from test tables.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from pathlib import PurePath
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions.tokens import VOCABULARY
from lumenq.session import materialise

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Candidates of a kind, about, on which its classifier is trained; drawn by hash from all of them.
SAMPLE = 6_000
#: Hashed text features of the classifier, and rounds of its training.
FEATURES, ROUNDS = 1 << 15, 120

# Common given names of many countries.
_GIVEN = """
aaron abdul adam agnes ahmed aisha alan albert alejandro alice amanda amina amir ana anders andrea andrew angela anita anna anne anton antonio ayse
barbara beatriz ben boris brian bruno carla carlos carmen catherine charles charlotte chen chiara chloe christine claire daniel david deborah
diego dmitri edward elena elizabeth emily emma eric erik eva farah fatima felix fernando francois frank gabriel george giulia giovanni grace
hana hannah hans hassan heather helen henrik hiroshi ibrahim igor ines ingrid irene isabel ivan jack james jan jane jean jennifer joan john jonas jorge
jose joseph juan julia karen karl katarzyna kenji kevin khadija kofi lars laura leila lena lin linda lisa louise lucas lucia luis magda manuel marco margaret
maria marie mario mark marta martin mary mateo matteo mehmet mei michael miguel miriam mohammed nadia natalia nicolas nina noah olga oliver omar oscar pablo patricia
patrick paul pavel pedro peter petra pierre priya rachel raj ravi richard robert rosa ruth samuel sandra sara sarah sergei simon sofia stefan susan
svetlana thomas tomasz ulrich vera victor wei william yuki yusuf zoe
"""
# Endings of family names in many languages.
_FAMILY = """
son sen sson dottir ova ovich evich ski sky ska enko chuk ez oglu ian yan opoulos idis wicz czyk mann stein berg feld baum bauer meyer worth field ford ton ley
well wood etti elli ini escu eau ier
"""
_PARTICLES = frozenset("van von de der den du da di la le zu zur ter del dos bin al el".split())
_TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau monsieur madame señor señora".split())
# Words with which a name never begins, in four languages.
_CLOSED = frozenset(
    "the a an this that these those it its he she they we you i my our your his her their and or but if as at by for from in into of off on onto out over to up with without is are was were be been has have had do does did not no yes why what when "
    "where who how which while since after before so then there here der die das ein eine und oder aber wenn ist sind war nicht wir ihr sie es ich im am le la les un une et ou mais si est sont il elle nous vous je el los las una y o pero".split()
)
# Words at the end of an English street's name. Those with a full stop keep it.
_STREETS = r"street|st\.|road|rd|lane|ln|drive|avenue|ave\.|boulevard|blvd|court|terrace|close|crescent|square|mews|way|parkway|grove|gardens"

_MAIL = re.compile(r"(?<![\w.+-])\w[\w.+-]*@[\w-]+(?:\.[\w-]+)+", re.I)
_MAIL_BRACKETS = re.compile(r"(?<![\w.+-])\w[\w.+-]*\s?(?:\(at\)|\[at\]|\{at\})\s?[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)[\w-]+)+", re.I)
_MAIL_WORDS = re.compile(r"(?<![\w.+-])\w[\w.+-]*\sat\s[\w-]+(?:\sdot\s[\w-]+)+", re.I)
_MAILS = (("sign", _MAIL), ("brackets", _MAIL_BRACKETS), ("words", _MAIL_WORDS))

#: A stretch that is long enough for a number of interest, from its first digit; patterns are tried around it only.
_NUMBER = re.compile(r"\d(?:[\d\s().+/-]{7,}|\d{5}\s?[a-d]|\d{6}-?[a-z]|\d[a-z]\d\d[a-z])")
_GAP = re.compile(r"[\s/,()<>|;:-]{1,5}$")
_PHONE_FORMS = (
    ("us", r"(?:\+1[ .-]?)?(?:\(\d{3}\)\s?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"),
    ("uk", r"(?:\+44\s?(?:\(0\)\s?)?|0)(?:\d{2}\s\d{4}\s\d{4}|7\d{3}\s\d{3}\s?\d{3}|\d{4}\s\d{6}|\d{3}\s\d{3}\s\d{4})"),
    ("fr", r"(?:\+33\s?|0)\d(?:[ .]?\d{2}){4}"),
    ("de", r"(?:\+49\s?|0)\d{2,4}[ /](?:\d{3,5}[ -]\d{2,4}|\d{5,8})"),
    ("au", r"\(0\d\)\s\d{4}\s\d{4}|(?:\+61\s?|0)\d(?:\d{2}\s\d{3}\s\d{3}|\s\d{4}\s\d{4})"),
    ("int", r"\+(?!1|33|44|49|61)\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?){2,6}"),
)


def _phone(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![\w+(])(?<!\w[-./])(?:(?=[+(])|(?<!\d[^\S\n])(?=\d))(?:{pattern})(?![\w])(?!-\d)(?!\s\d{{4}}(?!\d))")


_PHONES = [(name, _phone(pattern)) for name, pattern in _PHONE_FORMS]
# Forms whose layout says little; their pattern labeler abstains.
_WEAK = frozenset(("nine", "twelve", "bare"))
_ID_FORMS = (
    ("ssn", r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"),
    ("nino", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"),
    ("birth", r"\d{6}[-+A]\d{3}[\dA-Z]"),
    ("tax", r"\d{2} \d{3} \d{3} \d{3}"),
    ("passport", r"[A-Z]\d{8}"),
    ("licence", r"[A-Z]\d{4}-\d{5}-\d{5}"),
    ("cpf", r"\d{3}\.\d{3}\.\d{3}-\d{2}"),
    ("dni", r"\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"),
    ("nir", r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?"),
    ("codice", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"),
    ("nine", r"\d{3}[- ]\d{3}[- ]\d{3}"),
    ("twelve", r"\d{4} \d{4} \d{4}"),
    ("bare", r"\d{9}|\d{11}"),
)


def _id(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![\w+(])(?<!\w[-./])(?<!\d[^\S\n])(?:{pattern})(?![\w])(?!-\d)(?!\s\d{{3}})", re.I)


_IDS = [(name, _id(pattern)) for name, pattern in _ID_FORMS]
# Of each kind, whether any form matches, and the forms.
_NUMBERS = tuple((kind, of("|".join(pattern for _, pattern in forms)), patterns) for kind, of, forms, patterns in (("phone", _phone, _PHONE_FORMS, _PHONES), ("id_number", _id, _ID_FORMS, _IDS)))
_FLAT_BEFORE = r"(?:(?:flat|apt|unit|apartment)\s\d{1,4}[a-z]?,\s)?"
_FLAT_AFTER = r"(?:,\s(?:flat|apt|unit|apartment|suite)\s\d{1,4}[a-z]?(?!\w))?"
_W = r"[^\W\d_]{3,}"
_ADDRESSES = [
    (name, re.compile(rf"(?<![\w.-]){_FLAT_BEFORE}(?:{pattern}){_FLAT_AFTER}", re.I))
    for name, pattern in (
        ("en", rf"\d{{1,4}}[a-z]?\s{_W}(?:\s{_W})?\s(?:{_STREETS})(?!\w)"),
        ("fr", rf"\d{{1,4}}[a-z]?(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:de\sla\s|des\s|du\s|de\s|d['’]|de\sl['’])?{_W}"),
        ("de", rf"{_W}(?:straße|strasse|str\.|weg|gasse|platz|allee)\s\d{{1,4}}[a-z]?(?![\w-])"),
        ("nl", rf"{_W}(?:straat|laan|gracht|plein|kade)\s\d{{1,4}}[a-z]?(?![\w-])"),
        ("es", rf"(?:calle|avenida|plaza|paseo|rua|via|viale|piazza|corso|ulica|ul\.)\s(?:de\sla\s|de\slos\s|del\s|de\s|da\s|di\s|do\s)?{_W}(?:\s{_W})?,?\s(?:n[ºo°]?\.?\s)?\d{{1,4}}[a-z]?(?![\w-])"),
    )
]
# Texts without one of these hold no mail address or street.
_TRIGGERS = {
    "@": "sign", "(at)": "brackets", "[at]": "brackets", "{at}": "brackets", " dot ": "words",
    "straße ": "de", "str. ": "de", "strasse ": "de", "weg ": "de", "gasse ": "de", "platz ": "de", "allee ": "de",
    "straat ": "nl", "laan ": "nl", "gracht ": "nl", "plein ": "nl", "kade ": "nl",
    " rue ": "fr", " avenue ": "fr", " boulevard ": "fr", " place ": "fr", " chemin ": "fr", " allée ": "fr", " impasse ": "fr", " quai ": "fr",
    **{w + " ": "es" for w in ("calle", "avenida", "plaza", "paseo", "rua", "via", "viale", "piazza", "corso", "ulica", "ul.")},
    **{" " + word.replace("\\", ""): "en" for word in _STREETS.split("|")},
}

# Words that announce a kind within the five words before it.
_CUES = {
    "email": "email e-mail mail via to at cc bcc write from mailto address contact reach",
    "phone": "call phone tel telephone mobile cell whatsapp ring dial under fax sms text contact reach",
    "id_number": "passport license licence insurance nino security ssn tax taxpayer identity id national identification personal code cpf dni nif nir steuer pesel aadhaar cpr sin tfn bsn codice",
    "address": "address live lives living deliver delivered ship move moved home house resident residing street",
    "name": "name named is ask cc wishes regards signed neighbour holder with dear agent sincerely thanks contact attn from by mr mrs ms dr prof for speak spoke",
}
_CUES = {kind: frozenset(words.split()) for kind, words in _CUES.items()}
# Words after a person's name.
_AFTER_NAME = frozenset("writing wrote called calls said says told asked asks promised saw himself herself here lives was will has speaking from".split())
_AGAINST = frozenset("order orders tracking invoice batch card ending ref reference rev version build chapter sku page room level parcel serial error model part item line ticket case shipment receipt product".split())
_STRONG = frozenset(("name is", "signed by", "is called", "named"))
_STRONG_ENDS = frozenset(x.split()[-1] for x in _STRONG)
_KNOWN_TOP = re.compile(r"(?:com|org|net|edu|gov|io|co|info|example|test|invalid|localhost|[a-z]{2})$")
_ESCAPE = re.compile(r"\\[nrt\"/\\]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# The same in texts without other characters, in less time.
_TOKEN_ASCII = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*")
_ANY = re.compile(r"[^\W_]+")
_ENDINGS = re.compile(rf"(?:{'|'.join(_FAMILY.split())})$")
_GIVEN_SET = frozenset(_GIVEN.split())
# A name in lower case begins with one of these or after one.
_STARTS = _GIVEN_SET | _TITLES | _STRONG_ENDS
_BLANK = re.compile(r"[^\S\n]+$")
_BLANK_DOT = re.compile(r"\.[^\S\n]+$")
_COMMA = re.compile(r",[^\S\n]+$")


@lru_cache(maxsize=1)
def _triggers():
    """One automaton for what must be in a text before a pattern is tried."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for trigger, form in _TRIGGERS.items():
        automaton.add_word(trigger, form)
    automaton.make_automaton()
    return automaton


@lru_cache(maxsize=2)
def common_words(vocabulary: str) -> frozenset[str]:
    """Words in lower case that a public byte-level vocabulary holds as one token."""
    with open(vocabulary, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]) for line in lines)
        texts = (t[1:].decode("utf-8", "ignore") for t in tokens if t[:1] == b" ")
        return frozenset(t for t in texts if len(t) > 1 and t.isalpha() and t.islower())


def _same_length(text: str) -> str:
    """The text with JSON escapes of white space as white space, every character in its place."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: "\n\n" if m.group()[1] in "nr" else "  " if m.group()[1] == "t" else m.group(), text)
    return text


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class _Text:
    """A text, its words, and what the context labelers and features need of them."""

    def __init__(self, text: str, common: frozenset[str]) -> None:
        self.shown = _same_length(text)
        self.low = _lower(self.shown)
        self.common = common
        self.uniform = self.shown.isupper() or self.shown.islower()
        self.near: dict[tuple[int, int], tuple[list[str], list[str]]] = {}

    def around(self, begin: int, end: int) -> tuple[list[str], list[str]]:
        """The five words before and the three after a span; a word that reaches into it is neither."""
        if (found := self.near.get((begin, end))) is None:
            found = self.near[begin, end] = self._before(begin), self._after(end)
        return found

    def _cut(self, at: int) -> bool:
        return 0 < at < len(self.low) and self.low[at - 1].isalnum() and self.low[at].isalnum()

    def _before(self, begin: int) -> list[str]:
        reach = 64
        while True:
            first = max(0, begin - reach)
            words = _ANY.findall(self.low, first, begin)
            if words and self._cut(begin):
                words.pop()
            # The first one may begin further left.
            if first == 0 or len(words) > 5:
                return words[-5:]
            reach *= 4

    def _after(self, end: int) -> list[str]:
        words = _ANY.finditer(self.low, end)
        if self._cut(end):
            next(words, None)
        return [m.group() for m in islice(words, 3)]


def _case(span: str) -> str:
    """Regex labeler for the case of a name or street: + each word capitalised, - mixed, . all the same."""
    if span.isupper() or span.islower():
        return "."
    words = [w for w in _TOKEN.findall(span) if len(w) > 1 and w.lower() not in _PARTICLES and w.lower() not in ("rue", "avenue", "boulevard", "place", "chemin", "des", "calle", "via")]
    return "+" if all(w[0].isupper() for w in words) else "-"


def _name_rows(t: _Text, k: int, spans: list, words: list, capital: list, initial: list, joined: Callable[[int], bool]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Capitalised words in a row from word k on, but not up to a word that an uncommon one follows."""
    full = [spans[k]] if capital[k] else []
    j, initials, n = k + 1, int(initial[k]), len(spans)
    while j < n and len(full) < 4 and initials < 3 and joined(j) and words[j] not in _TITLES and (words[j] not in _CLOSED or words[j] in _PARTICLES):
        if capital[j] and words[j] not in _PARTICLES:
            full = [*full, spans[j]]
            goes_on = j + 1 < n and joined(j + 1) and capital[j + 1] and words[j + 1] not in t.common and words[j + 1] not in _PARTICLES
            if len(full) >= (1 if initial[k] else 2) and not (goes_on and len(full) < 4):
                yield ("initial" if initial[k] else "row"), spans[k][0], spans[j][1], full
        elif initial[j]:
            initials += 1
        elif words[j] not in _PARTICLES:
            return
        j += 1


def _names(t: _Text) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(form, begin, end, its full words) of what is laid out like a name, known or not.

    Forms: capitalised words in a row (with initials and particles), a known given name before any
    word, a word and a given name with a comma between, and two words after a strong cue.
    """
    shown, low = t.shown, t.low
    spans = [m.span() for m in (_TOKEN_ASCII if shown.isascii() else _TOKEN).finditer(shown)]
    n = len(spans)
    words = [low[b:e] for b, e in spans]
    upper = [k for k, (b, _) in enumerate(spans) if shown[b].isupper()]
    if not (upper or t.uniform) and _GIVEN_SET.isdisjoint(words) and _TITLES.isdisjoint(words) and _STRONG_ENDS.isdisjoint(words):
        return
    # A letter after a number is its unit.
    initial, capital = [False] * n, [False] * n
    for k in upper:
        b, e = spans[k]
        initial[k] = e - b == 1 and shown[e : e + 1] == "." and not (b > 1 and shown[b - 2].isdigit())
        capital[k] = e - b > 1 and (t.uniform or e - b > 3 or not shown[b:e].isupper())
    starts = range(n) if t.uniform else upper
    if not (t.uniform or _STARTS.isdisjoint(words)):
        known = {k for k, w in enumerate(words) if w in _GIVEN_SET}
        announced = {k for k, w in enumerate(words[:-1], 1) if w in _TITLES or w in _STRONG_ENDS}
        starts = sorted({*upper, *known, *announced})

    def joined(k: int) -> bool:
        """Whether word k follows the one before as a name's parts do."""
        gap = shown[spans[k - 1][1] : spans[k][0]]
        if gap == " ":
            return not initial[k - 1]
        return bool((_BLANK_DOT if initial[k - 1] else _BLANK).fullmatch(gap))

    for k in starts:
        if not (t.uniform or capital[k] or initial[k] or words[k] in _GIVEN_SET or (k and (words[k - 1] in _TITLES or words[k - 1] in _STRONG_ENDS))):
            continue
        if words[k] in _TITLES or (words[k] in _CLOSED and not initial[k] and words[k] not in _GIVEN_SET) or (k and spans[k][0] and shown[spans[k][0] - 1] in "@_"):
            continue
        known = words[k] in _GIVEN_SET
        if not t.uniform and (capital[k] or initial[k]) and not (words[k] in _PARTICLES and not known):
            # Not in the middle of a name.
            inside = k and joined(k) and (capital[k - 1] or initial[k - 1]) and words[k - 1] not in t.common and words[k - 1] not in _TITLES
            if not inside or words[k - 1] in _PARTICLES:
                yield from _name_rows(t, k, spans, words, capital, initial, joined)
        follows = " ".join(words[max(0, k - 2) : k])
        cued = t.uniform or not (capital[k] or initial[k])
        if cued and (known or initial[k] or follows in _STRONG or (k and words[k - 1] in _TITLES)):
            j = k + 1
            while j < n and joined(j) and (words[j] in _PARTICLES or initial[j] or (spans[j][1] - spans[j][0] == 1)) and j < k + 4:
                j += 1
            if j < n and joined(j) and len(words[j]) > 2:
                yield ("known" if known else "initial" if initial[k] else "cued"), spans[k][0], spans[j][1], ([spans[k]] if not initial[k] else []) + [spans[j]]
        elif known and k + 1 < n and joined(k + 1) and not capital[k + 1] and len(words[k + 1]) > 2 and words[k + 1] not in _PARTICLES:
            yield "known", spans[k][0], spans[k + 1][1], [spans[k], spans[k + 1]]
        if k and (known or capital[k]) and (t.uniform or capital[k - 1] or known) and _COMMA.fullmatch(shown[spans[k - 1][1] : spans[k][0]]) and len(words[k - 1]) > 2:
            if known or not t.uniform:
                j = k - 1
                while j and words[j - 1] in _PARTICLES and joined(j):
                    j -= 1
                yield "comma", spans[j][0], spans[k][1], [spans[k], spans[k - 1]]


def candidates(text: _Text) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, vector) of everything that may be personal; the vector is the kind of pattern and the votes.

    One sign a labeler: + for, - against, . abstains. Every kind has two labelers of its own or
    more, then those of the words before, after, against, and of the layout.
    """
    t, shown, low, common = text, text.shown, text.low, text.common
    out: list[tuple[str, int, int, str]] = []

    def add(kind: str, form: str, begin: int, end: int, extra: str) -> None:
        before, after = t.around(begin, end)
        here = "+" if not _CUES[kind].isdisjoint(before[-2:] if kind == "name" else before) else "."
        next_ = "+" if kind == "name" and after[:1] and after[0] in _AFTER_NAME else "."
        against = "-" if not _AGAINST.isdisjoint(before[-3:]) and kind != "name" else "."
        out.append((kind, begin, end, f"{form}:{extra}{here}{next_}{against}"))

    forms = {form for _, form in _triggers().iter(low.replace("\n", " ").replace("\t", " "))}
    for form, pattern in _MAILS:
        if form in forms:
            for m in pattern.finditer(shown):
                add("email", form, *m.span(), "+" if _KNOWN_TOP.search(low[m.start() : m.end()]) else "-")
    for run in _NUMBER.finditer(low):
        if not run.group()[-1].isalpha() and sum(map(str.isdigit, run.group())) < 6:
            continue
        first, last = max(0, run.start() - 7), min(len(shown), run.end() + 6)
        for kind, any_form, patterns in _NUMBERS:
            if not any_form.search(shown, first, last):
                continue
            for form, pattern in patterns:
                for m in pattern.finditer(shown, first, last):
                    digits = sum(c.isdigit() for c in m.group())
                    strict = form not in _WEAK if kind == "id_number" else 9 <= digits <= 13
                    add(kind, form, *m.span(), "+" if strict else "." if kind == "id_number" else "-")
    for form, pattern in _ADDRESSES:
        if form in forms:
            for m in pattern.finditer(shown):
                add("address", form, *m.span(), _case(m.group()))
    for form, begin, end, full in _names(t):
        first, last = low[slice(*full[0])], low[slice(*full[-1])]
        lasts = [w for w in re.split(r"['’-]", last) if len(w) > 1]
        rare = "-" if any(w in common for w in lasts) else "+"
        opens = "+" if first in _GIVEN_SET and len(full) > 1 else "-" if len(full) > 1 and first in common else "."
        middle = "-" if any(low[b:e] in common and low[b:e] not in _GIVEN_SET for b, e in full[1:-1]) else "."
        ends = "+" if all(_ENDINGS.search(w) for w in lasts) else "."
        case = "." if form == "row" else _case(shown[begin:end])
        add("name", form, begin, end, opens + rare + middle + ends + case)
    # Layout labeler: next to a candidate of another kind, as in a signature.
    out = sorted(set(out), key=lambda x: (x[1], x[2], x[0], x[3]))
    fixed = [(k, b, e) for k, b, e, _ in out if k != "name"]
    return [(k, b, e, v + ("+" if any(k2 != k and (0 < b - e2 <= 5 and _GAP.match(shown[e2:b]) or 0 < b2 - e <= 5 and _GAP.match(shown[e:b2])) for k2, b2, e2 in (fixed if k == "name" else [x[:3] for x in out])) else ".")) for k, b, e, v in out]


def features(text: _Text, kind: str, begin: int, end: int, vector: str) -> list[int]:
    """Hashed features of a candidate's text: its votes, words around it, shape, and letters of its parts.

    None where no labeler votes for the candidate: it is counted, but never accepted.
    """
    if "+" not in vector:
        return []
    shown, low = text.shown, text.low
    form, votes = vector.split(":")
    before, after = text.around(begin, end)
    names = [f"f{form}", f"n{len(shown[begin:end].split())}"]
    if kind != "name":
        names += [f"v{k}{c}" for k, c in enumerate(votes)]
    names += [f"b{k}{w}" for k, w in enumerate(reversed(before[-3:]))] + [f"a{k}{w}" for k, w in enumerate(after[:2])]
    names += [f"p{shown[begin - 1 : begin]}", f"q{shown[end : end + 1]}"]
    body = low[begin:end]
    if kind == "name":
        parts = _TOKEN.findall(body)
        for at, w in (("x", parts[0]), ("y", parts[-1])):
            w = f"^{w}$"
            names += [f"{at}{w[:4]}", f"{at}{w[-4:]}", f"{at}{w[-3:]}", *(f"{at}{w[k : k + 3]}" for k in range(len(w) - 2))]
            names.append(f"{at}c{w[1:-1] in text.common}")
    else:
        shape = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in body)
        names += [f"s{shape}", *(f"t{shape[k : k + 4]}" for k in range(len(shape) - 3))]
        if kind in ("email", "address"):
            names += [f"w{w}" for w in _ANY.findall(body) if not w.isdigit()]
    return [crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in dict.fromkeys(names)]


def estimate(vectors: list[tuple[str, str, int]], rounds: int = 60) -> dict[tuple[str, str], float]:
    """Probability of each (kind, vector) by expectation-maximisation, from how often each occurs.

    Of each kind it estimates how reliable each labeler is and how likely each vector is personal
    (two classes, labelers independent within a class, started from the votes).
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in vectors}):
        own = sorted((v, n) for k, v, n in vectors if k == kind)
        votes = np.array([["-.+".index(c) for c in v.split(":")[1]] for v, _ in own])
        counts = np.array([n for _, n in own], float)
        # A name's form alone says little, that of the other kinds much.
        start = 2.0 * ((votes == 2).sum(axis=1) - 2 * (votes == 0).sum(axis=1)) - (3.0 if kind == "name" else 1.0)
        p = 1 / (1 + np.exp(-start))
        for _ in range(rounds):
            sure, unsure = counts * p, counts * (1 - p)
            prior = np.clip(sure.sum() / counts.sum(), 0.02, 0.98)
            logit = np.full(len(own), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                # A labeler is taken to be better than chance until the votes say how much.
                hit = np.array([sure[votes[:, j] == c].sum() for c in range(3)]) + (2 + 0.1 * sure.sum()) * np.array([0.05, 0.45, 0.5])
                miss = np.array([unsure[votes[:, j] == c].sum() for c in range(3)]) + (2 + 0.1 * unsure.sum()) * np.array([0.45, 0.5, 0.05])
                odds = np.log((hit / hit.sum()) / (miss / miss.sum()))
                # No labeler counts against what it is built to say; outside of names, who abstains says nothing.
                odds[0], odds[1], odds[2] = min(odds[0], 0.0), min(odds[1], 0.0) if kind == "name" else 0.0, max(odds[2], 0.0)
                logit += odds[votes[:, j]]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out.update({(kind, v): float(x) for (v, _), x in zip(own, p, strict=True)})
    return out


class Classifier:
    """A logistic model of hashed text features for each kind, trained on the estimated probabilities."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights

    @staticmethod
    def train(rows: list[tuple[str, list[int], float]]) -> Classifier:
        """``rows``: kind, features, and the probability that the labelers' votes give."""
        weights: dict[str, np.ndarray] = {}
        for kind in sorted({k for k, _, _ in rows}):
            own = [(x, p) for k, x, p in rows if k == kind]
            sizes = np.array([len(x) for x, _ in own])
            flat, owner = np.concatenate([x for x, _ in own]).astype(np.int64), np.repeat(np.arange(len(own)), sizes)
            target = np.array([p for _, p in own])
            w, first, second = (np.zeros(FEATURES + 1) for _ in range(3))
            for k in range(1, ROUNDS + 1):
                z = np.bincount(owner, w[flat], len(own)) + w[-1]
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(own)
                slope = np.append(np.bincount(flat, error[owner], FEATURES), error.sum()) + 1e-5 * w
                # Adam.
                first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
                w = w - 0.08 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
            weights[kind] = w.astype(np.float32)
        return Classifier(weights)

    def __call__(self, kind: str, x: list[int]) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None or not len(x) else float(1 / (1 + np.exp(-np.clip(w[x].sum() + w[-1], -30, 30))))


def resolve(rated: list[tuple[float, str, int, int]], least: float = 0.5) -> list[tuple[str, int, int]]:
    """The accepted spans, in order, none overlapping: the likelier one stays, then the longer one."""
    kept: list[tuple[str, int, int]] = []
    for p, kind, begin, end in sorted(rated, key=lambda x: (-round(x[0], 1), x[2] - x[3], x[2], x[1])):
        if p >= least and all(end <= b or begin >= e for _, b, e in kept):
            kept.append((kind, begin, end))
    return sorted(kept, key=lambda x: x[1])


_FOUND = "rec string, rec_id long, found array<struct<kind:string,b:int,e:int,vector:string,span:string,x:array<int>>>"


def _shipped(spark: SparkSession, vocabulary: str) -> Callable[[], frozenset[str]]:
    """The vocabulary's common words in a worker; the file (a few MB) is read on the driver's machine and sent along."""
    spark.sparkContext.addFile(vocabulary)
    name = PurePath(vocabulary).name
    return lambda: common_words(SparkFiles.get(name))


def scan(texts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Candidates of each of the ``texts`` (``rec``, ``rec_id``, ``state``) that has any, with votes and features."""
    known = _shipped(texts.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = known()
        for b in batches:
            rows = []
            for rec, key, state in zip(b.rec, b.rec_id, b.state, strict=True):
                text = _Text(state, common)
                if found := candidates(text):
                    rows.append((rec, key, [(k, s, e, v, state[s:e], features(text, k, s, e, v)) for k, s, e, v in found]))
            yield pd.DataFrame(rows, columns=["rec", "rec_id", "found"])

    return texts.where(F.length("state") > 0).select("rec", "rec_id", "state").mapInPandas(run, _FOUND)


def train(scanned: DataFrame, seed: int = 0) -> Classifier:
    """The votes of all candidates are counted and weighed; the classifier learns from a sample of about SAMPLE a kind.

    The number of different vote vectors is bounded by forms and votes, not by rows. The sample
    is drawn by a hash of the candidate's text, so that equal texts don't fill it.
    """
    each = scanned.select(F.explode("found").alias("f"))
    counts = [(r["kind"], r["vector"], r["count"]) for r in each.groupBy("f.kind", "f.vector").count().collect()]
    chance = estimate(counts)
    total: dict[str, int] = {}
    for kind, vector, n in counts:
        total[kind] = total.get(kind, 0) + n * ("+" in vector)
    u = F.pmod(F.xxhash64(F.lit(seed), "f.span", "f.vector"), F.lit(1 << 20))
    taken = F.lit(False)
    for kind, n in total.items():
        taken = taken | ((F.col("f.kind") == kind) & (u < int((1 << 20) * min(1.0, SAMPLE / max(1, n)))))
    # One hash may be that of many rows: SAMPLE different ones a kind at most, with their counts as they are.
    drawn = each.where(taken & (F.size("f.x") > 0)).groupBy("f.kind", "f.vector", "f.span").agg(F.first("f.x").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = drawn.select("kind", "vector", "x").collect()
    return Classifier.train([(r["kind"], r["x"], chance[r["kind"], r["vector"]]) for r in rows])


def spans(texts: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``rec``, ``rec_id``, ``kind``, ``b``, ``e``, ``span``) of the personal information in ``texts``.

    ``texts`` has ``rec``, ``rec_id`` and ``state``. Null and empty states hold nothing; a row
    that is repeated gives its spans again; whole texts are read. Spans of one text never
    overlap. Everything but the counts of vote vectors and the classifier's sample stays with
    the text's own row, so nothing is shuffled and no text is joined.
    """
    scanned = materialise(scan(texts, vocabulary), "candidates")
    model = train(scanned)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec, key, found in zip(b.rec, b.rec_id, b.found, strict=True):
                text = {(f["b"], f["e"]): f["span"] for f in found}
                for kind, begin, end in resolve([(model(f["kind"], f["x"]), f["kind"], f["b"], f["e"]) for f in found], least):
                    rows.append((rec, key, kind, begin, end, text[begin, end]))
            yield pd.DataFrame(rows, columns=["rec", "rec_id", "kind", "b", "e", "span"])

    return scanned.mapInPandas(decide, "rec string, rec_id long, kind string, b int, e int, span string")


def redacted(texts: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY) -> DataFrame:
    """``texts`` with personal information in ``state`` replaced by typed placeholders; ``rec``, ``rec_id``, ``state``.

    The spans found in each row replace it there, so each text is searched once for training and once
    for replacing. Text around the spans is unchanged; null stays null.
    """
    model = train(materialise(scan(texts, vocabulary), "candidates"))
    known = _shipped(texts.sparkSession, vocabulary)

    def redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = known()
        for b in batches:
            out = []
            for state in b.state:
                if isinstance(state, str) and state:
                    text, at, parts = _Text(state, common), 0, []
                    rated = [(model(k, features(text, k, s, e, v)), k, s, e) for k, s, e, v in candidates(text)]
                    for kind, begin, end in resolve(rated, least):
                        parts += [state[at:begin], PLACEHOLDERS[kind]]
                        at = end
                    state = "".join([*parts, state[at:]])
                out.append(state)
            yield pd.DataFrame({"rec": b.rec, "rec_id": b.rec_id, "state": pd.Series(out, dtype=object, index=b.index)})

    return texts.select("rec", "rec_id", "state").mapInPandas(redact, "rec string, rec_id long, state string")
