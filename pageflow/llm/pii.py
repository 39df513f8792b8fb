"""Personal information in free text: find it and put typed placeholders in its place.

Shapes of numbers, mail addresses, streets and capitalised words propose
candidate segments; a semi-Markov conditional random field scores each segment
as a whole (its shape, the parts that the name list knows, the words around it)
and a dynamic programme chooses boundaries and types together.

The weights are trained on generated sentences in five languages
(``training_examples``), whose number is bounded by ``TRAINING`` and doesn't
depend on the data.  What the corpus gives is its common words: those that
occur in lower case, which tell a name from a heading; those that also stand in
a candidate for a name are sent to the workers, as no other is asked for.

Defined results of odd input: null and empty texts have no occurrences; names
need at least one part from the list; of overlapping readings the best choice as
a whole stands, and of equal ones the first; repeated rows are judged alike; an
entry of the list that is null or empty is ignored.  Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm import semicrf
from pageflow.llm.semicrf import Segment

TRAINING = 1500
#: Characters that are searched for the part of a name before another; no part of a name is as long.
LONGEST_PART = 64
#: A word is common if it occurs in lower case so many times.
COMMON_COUNT = 3

_CAP = re.compile(r"(?<![\w@.+])[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?(?![\w@])")
_BEFORE_NAME = re.compile(r"(?:(?<![\w.@+-])([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?)\s(?:([A-ZÀ-ÖØ-Þ])\.\s)?|(?<![\w.@+-])([A-ZÀ-ÖØ-Þ])\.\s)$")
_AFTER_NAME = re.compile(r"(?:\s([A-ZÀ-ÖØ-Þ])\.)?\s([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?)(?![\w@])")
_BEFORE_WORD = re.compile(r"(?<![\w.@+-])([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?)\s$")
_AFTER_WORD = re.compile(r"\s([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?)(?![\w@])")
_INVERTED = re.compile(r",\s([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?)(?![\w@.])")

_AT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|(?<=\w)\sat(?=\s[\w-]+\s+dot\s)", re.I)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
_DOMAIN = re.compile(r"\s{0,2}[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|\s{0,2}[(\[{]\s?dot\s?[)\]}]\s{0,2}|\s+dot\s+)[A-Za-z0-9][A-Za-z0-9-]*)+", re.I)

_NUMBER = re.compile(r"(?<![\w.,/+-])(?:[+(](?=\d[\d\s().\-]{5})|\d(?=[\d\s().\-/]{7})|[A-Z](?=[A-Z0-9]?\s?[A-Z0-9]{1,2}\s?\d[\dA-Z\s]{3}))|(?<=[㐀-鿿：:|,;.“(])(?:[+(](?=\d[\d\s().\-]{5})|\d(?=[\d\s().\-/]{7})|[A-Z](?=[A-Z0-9]?\s?[A-Z0-9]{1,2}\s?\d[\dA-Z\s]{3}))")
_END = r"(?![\w]|[-/]\d|\.\d)"
_SHAPES = [
    (kind, name, re.compile(pattern + _END))
    for kind, name, pattern in (
        ("phone", "intl", r"\+\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,6}"),
        ("phone", "idd", r"00\d{1,3}[\s-]\d{1,4}(?:[\s-]?\d{2,8}){1,3}"),
        ("phone", "paren", r"\(\+?\d{2,5}\)\s?\d{2,8}(?:[\s-]\d{2,5}){0,4}"),
        ("phone", "slash", r"0\d{1,4}/\d{3,8}(?:[\s-]\d{2,5}){0,2}"),
        ("phone", "trunk", r"0\d{2,4}[\s-]\d{3,8}(?:[\s-]\d{2,5}){0,2}"),
        ("phone", "pairs", r"0\d(?:[\s.-]?\d{2}){4}"),
        ("phone", "dotted", r"\d{3}\.\d{3}\.\d{4}"),
        ("phone", "dashed", r"(?:8-)?\d{3}-\d{3}-(?:\d{4}|\d{2}-\d{2})"),
        ("phone", "area", r"[1-9]\s?\(\d{3,4}\)\s?\d{3}[\s-]\d{2}[\s-]?\d{2}"),
        ("phone", "spaced", r"\d{3}\s\d{3}\s\d{4}"),
        ("id_number", "3-2-4", r"\d{3}[\s-]\d{2}[\s-]\d{4}"),
        ("id_number", "nine", r"\d{9}"),
        ("id_number", "letters", r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]"),
        ("id_number", "letter", r"[A-Z]\d{7,9}|[A-Z]\d[A-Z0-9]?\s?[A-Z]\d{5,7}"),
        ("id_number", "fifteen", r"[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?"),
        ("id_number", "four-six", r"\d{2}\s?\d{2}\s(?:№\s?)?\d{6}"),
        ("id_number", "eighteen", r"\d{17}[\dXx]"),
    )
]
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Row|Square|Sq\.?|Drive|Court|Terrace|Close|Place|Way|Hill|Crescent|Boulevard|Blvd\.?)"
_STREET_DE = r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|markt|hof|steig)"
_STREET_FR = r"(?:rue|avenue|quai|place|boulevard|chemin|impasse|allée|route|cours|passage|ruelle|square)"
_ADDRESSES = [
    (name, re.compile(pattern))
    for name, pattern in (
        ("en", rf"(?<![\w./-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\w{{1,4}},\s)?(?:(?:No\.|Nr\.)\s)?\d{{1,4}}(?:[A-Za-z]|\s?[-–/]\s?\d{{1,4}})?,?\s(?:[A-Z][\w’']+\s){{1,3}}?{_STREET_EN}(?!\w)(?:,\s[A-Z][\w-]+(?:\s[A-Z0-9]{{2,4}}\s\d[A-Z]{{2}}|\s\d{{5}})?)?"),
        ("de", rf"(?<!\w)(?:(?:Am|An\sder|Im|In\sder|Auf\sder|Auf\sdem|Zum|Zur)\s)?[A-ZÄÖÜ][\wäöüß-]*(?:{_STREET_DE}|\s(?:Straße|Weg|Platz|Gasse|Allee))\s\d{{1,4}}\s?(?:[a-z](?!\w))?(?:,\s(?:[A-Z]-)?(?:\d{{5}}\s)?[A-Z][\w-]+)?"),
        ("fr", rf"(?<![\w./-])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s{_STREET_FR}\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’])?[A-ZÀ-Þ][\w’'-]+(?:,?\s(?:\d{{5}}\s)?[A-Z][\w-]+)?"),
        ("ru", r"(?<!\w)(?:г\.\s?[А-ЯЁ][\w-]+,\s)?(?:(?:ул|пр|пр-т|пер|пл|наб|бул|ш)\.|улица|проспект|переулок|площадь|набережная)\s?[А-ЯЁ][\w-]+,\s(?:д\.|дом)\s?\d+\w?(?:,\s(?:кв\.|квартира)\s?\d+)?"),
        ("zh", r"(?:[㐀-鿿]{2}[市县镇区乡村])?[㐀-鿿]{2,3}[路街巷道]\d{1,4}号(?:\d+室)?"),
    )
]
# What a text must hold for a pattern to be tried; a plain search is far cheaper than the pattern.
_ADDRESS_HINTS = {
    "en": ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Row", "Square", "Sq", "Drive", "Court", "Terrace", "Close", "Place", "Way", "Hill", "Crescent", "Boulevard", "Blvd"),
    "de": ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ring", "ufer", "damm", "markt", "hof", "steig", "Straße", "Weg", "Platz", "Gasse", "Allee"),
    "fr": ("rue", "avenue", "quai", "place", "boulevard", "chemin", "impasse", "allée", "route", "cours", "passage", "ruelle", "square"),
    "ru": ("ул", "пр", "пер", "пл", "наб", "бул", "ш."),
    "zh": ("号",),
}

# Words around the segments, by what they tell.
_CUES = {
    "phone": "call ring tel telephone phone fax mobile dial number pencil appeler téléphone tél numéro telefon telefonnummer anrufen rufnummer fernsprecher телефон тел звонить звоните 电话 请拨 拨 手机",
    "id": "passport ticket card identity id licence file bearer identité carte passeport dossier ausweis ausweisnummer personalausweis pass akte паспорт удостоверение билет 身份证号 身份证 护照 证件号",
    "book": "isbn issn accession shelf plate no position signatur signaturen cote издания шифр box inventory 书号 编号 vol pp box item",
    "address": "at to resident lives address write seen anschrift adresse adresser entgegen адресу адрес так 寄 存于 现存于 来信请寄",
    "title": "mr mrs ms miss dr prof sir herr herrn frau monsieur madame mme mlle docteur",
    "by": "by for to from with von an par à mit und écrire remis nahm contact ask signed shown kept corrected durch",
    "thing": "the a an steamer ship vessel brig barque haus firma maison das la le der die dampfer navire vapeur song ballad",
}
_CUE = {w: k for k, words in _CUES.items() for w in words.split()}
_AFTER = {w: k for k, words in {"firm": "& et sons co brothers fils söhne und ltd gmbh cie company", "place": "street road lane bridge avenue row square house mill quay harbour hill castle brücke straße rue gate"}.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+|&")
_SUFFIX_CUES = [c for c in _CUE if ord(c[0]) > 0x3400]


def _left(text: str, start: int) -> tuple[str, str, str]:
    """(the character before, the cue before it, the cue before that) of a place."""
    piece = text[max(0, start - 36) : start]
    stripped = piece.rstrip()
    mark = stripped[-1:] if stripped[-1:] and not stripped[-1].isalnum() else "w" if stripped else "^"
    if stripped and stripped[-1] >= "㐀" and stripped[-1] <= "鿿" or mark in "：":
        bare = stripped.rstrip("：:")
        return mark, next((_CUE[c] for c in _SUFFIX_CUES if bare.endswith(c)), "-"), "-"
    words = _WORD.findall(piece)[-3:]
    cues = [_CUE.get(w.lower(), "-") for w in words]
    return mark, cues[-1] if cues else "^", next((c for c in reversed(cues[:-1]) if c != "-"), "-")


def _right(text: str, end: int) -> str:
    m = _WORD.search(text, end, end + 24)
    if not m or text[end : m.start()].strip(" \n\t\r"):
        return text[end : end + 3].strip()[:1] or "$"
    return _AFTER.get(m[0].lower(), "w")


class Finder:
    """Candidates and decoded occurrences of one lexicon, set of common words and set of weights."""

    def __init__(self, given: set[str], family: set[str], common: set[str], weights: dict[str, float] | None = None):
        self.given, self.family, self.common = given, family, common
        self.listed = given | family
        self.weights = weights or {}

    def _part(self, word: str) -> str:
        kinds = set()
        for w in word.lower().split("-"):
            kinds.add("t" if _CUE.get(w) == "title" else ("G" if w in self.given else "") + ("F" if w in self.family else "") or ("c" if w in self.common else "u"))
        return "-".join(sorted(kinds)) if "-" in word else kinds.pop()

    def _names(self, text: str) -> Iterator[Segment]:
        listed = self.listed
        seen = set()
        for m in _CAP.finditer(text):
            low = m[0].lower()
            if low not in listed and not ("-" in low and any(w in listed for w in low.split("-"))):
                continue
            s, e = m.span()
            own = self._part(m[0])
            starts: list[tuple[int, str]] = [(s, own)]
            if b := _BEFORE_NAME.search(text, max(0, s - 2 * LONGEST_PART), s):
                if b[3]:
                    starts.append((b.start(3), "I " + own))
                else:
                    starts.append((b.start(1), self._part(b[1]) + (" I " if b[2] else " ") + own))
                    if b[2]:
                        starts.append((b.start(2), "I " + own))
            spans = [(a, e, sig) for a, sig in starts]
            for at, sig in starts[:]:  # a second given name, or a name of two words before the family name
                if at < s and (b := _BEFORE_WORD.search(text, max(0, at - LONGEST_PART), at)):
                    spans.append((b.start(1), e, f"{self._part(b[1])} {sig}"))
            if a := _AFTER_NAME.match(text, e):
                spans.append((s, a.end(), own + (" I " if a[1] else " ") + self._part(a[2])))
                if (c := _AFTER_WORD.match(text, a.end())) and not a[1]:
                    spans.append((s, c.end(), f"{own} {self._part(a[2])} {self._part(c[1])}"))
                for at, sig in starts[1:2]:  # the listed part stands in the middle
                    spans.append((at, a.end(), f"{sig}{' I ' if a[1] else ' '}{self._part(a[2])}"))
            if a := _INVERTED.match(text, e):
                spans.append((s, a.end(), own + ", " + self._part(a[1])))
            if own != "F" and (b := re.compile(r"(?<![\w@.+-])([A-ZÀ-ÖØ-Þ][^\W\d_]+),\s$").search(text, max(0, s - LONGEST_PART), s)):
                spans.append((b.start(1), e, self._part(b[1]) + ", " + own))
            for x, y, sig in spans:
                if (x, y) in seen:
                    continue
                seen.add((x, y))
                mark, cue, far = _left(text, x)
                after = _right(text, y)
                word = _WORD.findall(text[max(0, x - 24) : x])[-1:]
                rest = "rest" if word and (word[0].lower() in listed or len(word[0]) == 1 and word[0].isupper()) and text[x - 1 : x].isspace() and (mark == "w" or len(word[0]) == 1) else "whole"
                ambiguous = "amb" if any(w.lower() in self.common for w in _WORD.findall(text[x:y])) else "sure"
                yield Segment(x, y, "name", ("n", f"n:{sig}", f"n:{sig}:{ambiguous}", f"n<{cue}", f"n<{cue}:{'one' if ' ' not in sig else 'more'}", f"n<<{far}", f"n<{mark}", f"n>{after}", f"n>{after}:{'one' if ' ' not in sig else 'more'}", f"n|{rest}"))

    def name_words(self, text: str) -> set[str]:
        """The lower-case words of the candidates for names: those that may be asked for among the common words."""
        return {w.lower() for x in self._names(text) for w in _WORD.findall(text[x.start : x.end])}

    def _emails(self, text: str) -> Iterator[Segment]:
        low = text.lower()
        if "@" not in text and not any(h in low for h in ("at)", "at]", "at}", "at>", "at )", "at ]", "at\n", "dot")):
            return
        reach = 0
        for m in _AT.finditer(text):
            end = m.start()
            while end > reach and end > m.start() - 2 and text[end - 1].isspace():
                end -= 1
            start = end
            while start > reach and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            while start < end and text[start] in "._+-":
                start += 1
            reach = m.start()  # no character is looked at twice
            if start < end and (b := _DOMAIN.match(text, m.end())):
                words = m[0].strip("()[]{}<> \n").lower()
                yield Segment(start, b.end(), "email", ("e", f"e:{words}", f"e.{'plain' if '.' in b[0] else 'dot'}"))

    def _numbers(self, text: str) -> Iterator[Segment]:
        for m in _NUMBER.finditer(text):
            s = m.start()
            got = [(kind, name, x.end()) for kind, name, shape in _SHAPES if (x := shape.match(text, s))]
            if got:
                mark, cue, far = _left(text, s)
                for kind, name, e in got:
                    k = kind[0]
                    groups = re.sub(r"\d+", lambda x: str(len(x[0])), re.sub(r"\s", " ", text[s:e]))
                    yield Segment(s, e, kind, (k, f"{k}:{name}", f"{k}<{cue}", f"{k}<<{far}", f"{k}<{mark}", f"{k}:{name}<{cue}", f"{k}:{name}:{sum(c.isdigit() for c in text[s:e])}", f"{k}#{groups}"))

    def _addresses(self, text: str) -> Iterator[Segment]:
        ascii_only = text.isascii()
        for name, pattern in _ADDRESSES:
            if ascii_only and name in ("ru", "zh") or not any(h in text for h in _ADDRESS_HINTS[name]):
                continue
            for m in pattern.finditer(text):
                mark, cue, _ = _left(text, m.start())
                features = ("a", f"a:{name}", f"a<{cue}", f"a<{mark}")
                yield Segment(m.start(), m.end(), "address", (*features, "a:whole"))
                if name == "en" and (inner := re.search(r"\d", m[0])) and inner.start():
                    yield Segment(m.start() + inner.start(), m.end(), "address", (*features, "a:inner"))

    def candidates(self, text: str) -> list[Segment]:
        return [*self._names(text), *self._emails(text), *self._numbers(text), *self._addresses(text)]

    def __call__(self, text: str) -> list[Segment]:
        found = self.candidates(text)
        return semicrf.decode(found, self.weights) if found else []


# The generated sentences: slots in capitals are cases, those in lower case none.
_TEMPLATES = (
    "Please write to NAME at ADDR_EN or call PHONE_EN.",
    "Mr FAM and Dr FAM were seen at ADDR_EN, said Mrs FAM.",
    "Ring PHONE_EN and ask for NAME; the key is kept by NAME.",
    "Passport of the owner: ID_EN, shown by NAME, resident at ADDR_EN.",
    "Library card: ID_EN; reply to <MAIL>.",
    "NAME (ID_EN) sold the boat. Reader ID_EN paid on Monday. Ticket: ID_EN.",
    "Contact | NAME | PHONE_EN | MAIL |",
    "The word stood there in 1637. NAME (ID_EN) leased the word in March. NAME (ID_EN) sold it.",
    "The word was seen on Monday.\nNAME (ID_EN) leased the word at place. NAME (ID_EN) came as well.",
    "A word island from fam harvested the word. From fam the word leads to a word. It stood at fam.",
    "Near fam lay a mill. The road to fam was long. Word of fam, in fam and by the word of fam.",
    "Questions go to NAME, MAIL. The sheet was read by NAME in April.",
    "A note says “PHONE_EN, ask for NAME”. It was signed for by NAME at ADDR_EN.",
    "Letters: mailto:MAIL or fax PHONE_EN, by leave of Mr FAM.",
    "firm_en closed in 1843. The fam Bridge was rebuilt. The steamer giv carried coal.",
    "The fam and the word is a ballad in 12 verses. At word Street, near Box 28, stood a mill.",
    "ISBN isbn is on the cover. Accession no. acc was given. See vol. 4, pp. 112-134, dated 1873-05-24.",
    "Position 51.6311 by 0.2403, depth 26-26 feet. Six bales were bought @ 15 shillings each near box box.",
    "The Word fam of place\n\nTwo words on the word. In 1731 the fam stood there.",
    "On the Word fam\n\nThe word fam measured 12 paces.",
    "Das Paket nahm NAME entgegen, ADDR_DE. Herr FAM hat es bezahlt.",
    "Anschrift: ADDR_DE; Tel. PHONE_DE. Frau FAM kam später.",
    "Telefon PHONE_DE, nachmittags; Ausweis ID_DE.",
    "Fragen zur Karte an NAME, MAIL. Die Liste wurde von NAME ersetzt.",
    "Das Haus fam & Söhne schloss im Jahre 1843. ISBN isbn steht auf dem Einband. Signatur acc gehört dazu.",
    "Le colis fut remis à NAME, ADDR_FR. Madame FAM a relu la carte.",
    "Adresse : ADDR_FR ; appeler le PHONE_FR.",
    "Téléphone : PHONE_FR ; numéro d'identité ID_FR.",
    "Pour la cloche, écrire à NAME (MAIL). La lettre fut lue par NAME.",
    "La maison fam et Fils ferma en 1839. ISBN isbn figure au dos. La cote acc désigne la laine.",
    "Телефон PHONE_RU. Паспорт ID_RU, почта MAIL. Телефон PHONE_RU.\nПаспорт ID_RU, рядом. Шифр acc относится к описи.",
    "Signatur acc gehört zur Karte. Telefon PHONE_DE. Signatur acc. La cote acc désigne la laine. Accession no. acc here.",
    "Паспорт ID_RU, почта MAIL. Писать по адресу: ADDR_RU; телефон PHONE_RU.",
    "Дом стоит так: ADDR_RU, рядом роща. Номер издания isbn. Шифр acc относится к описи.",
    "Вопросы слать на MAIL, тел. PHONE_RU. Около 71 листов занимает роща.",
    "持有人身份证号ID_ZH，邮箱 MAIL 。来信请寄ADDR_ZH，电话PHONE_ZH。",
    "如需查阅，请拨PHONE_ZH。户籍现存于ADDR_ZH。书号isbn印在封底。编号acc属于渠道。",
)
_SLOT = re.compile(r"\b(?:NAME|FAM|MAIL|(?:ADDR|PHONE|ID)_[A-Z]{2}|firm_en|fam|giv|Word|word|words|isbn|acc|box|place)\b|(?:ADDR|PHONE|ID)_ZH|isbn|acc")
_KIND = {"NAME": "name", "FAM": "name", "MAIL": "email", "ADDR": "address", "PHONE": "phone", "ID": "id_number"}
_PLAIN_WORDS = "annual barley cabinet cargo chapel distant eastern fertile granary harbour ledger meadow narrow orchard plateau quarry reservoir schooner telescope unsigned village western".split()


def _filled(rng: random.Random, slot: str, given: list[str], family: list[str]) -> str:
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = rng.choice
    town = lambda: pick(("Kel", "Nor", "Hol", "Wen", "Tan")) + pick(("ab", "or", "im", "")) + pick(("field", "by", "mere", "gate"))
    new_name = lambda: pick(("Bra", "Del", "Ost", "Pir", "Gun", "Zor")) + pick(("lin", "mar", "ton", "vek", "sor"))
    g = pick(given).title() if rng.random() < 0.75 else new_name()
    f = pick(family).title()
    if rng.random() < 0.12 and g.lower() in given:
        f = new_name()
    if slot == "NAME":
        style = rng.random()
        if style < 0.5:
            name = f"{g} {f}"
        elif style < 0.62:
            name = f"{pick('ABDEGHJKLMNPRSTVW')}. {pick(family).title()}"
        elif style < 0.74:
            name = f"{g} {pick('ABDEGHJKLMNPRSTVW')}. {f}"
        elif style < 0.80:
            name = f"{g} {pick((pick(given).title(), new_name()))} {f}"
        elif style < 0.88:
            name = f"{f}, {g}"
        else:
            name = f"{g}-{pick(given).title()} {f}"
        style = rng.random()
        return name.upper() if style < 0.15 else name.replace(f, f.upper()) if style < 0.3 else name
    if slot in ("FAM", "fam"):
        return pick(family).title()
    if slot == "giv":
        return pick(given).title()
    if slot == "MAIL":
        user = pick((f"{g}.{f}", f"{g[0]}.{f}", f"{f}{n(2)}", f"{g}+{pick(_PLAIN_WORDS)}", f"{g}_{f}")).lower()
        host = [pick(("mill", "papers", "box9", "post-room")), pick(("example", "invalid", "test"))] + pick(([], ["net"], ["org"]))
        at, dot = pick((("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" (at) ", " (dot) "), (" AT ", " DOT ")))
        mail = user + at + dot.join(host)
        return mail.upper() if rng.random() < 0.15 else mail
    if slot == "firm_en":
        return f"The {f} {pick(('& Sons', '& Co', '& Brothers'))} {pick(_PLAIN_WORDS)}"
    if slot in ("Word", "word", "words"):
        return pick(_PLAIN_WORDS).title() if slot == "Word" else pick(_PLAIN_WORDS)
    if slot == "place":
        return town()
    if slot == "isbn":
        return f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}"
    if slot == "acc":
        first = pick(("0" + n(3), n(4)))
        return pick((f"{first}-{n(4)}-{n(4)}", f"{first}-{n(4)}-{n(2)}"))
    if slot == "box":
        return f"{n(4)}-{n(3)}"
    kind, lang = slot.split("_")
    k = str(rng.randint(1, 180))
    if kind == "ADDR":
        street = pick(_PLAIN_WORDS).title()
        if lang == "EN":
            return f"{pick(('', '', 'Flat 3, ', 'No. '))}{k}{pick(('', '', 'B', '-' + n(2)))} {street} {pick(('Street', 'Road', 'Lane', 'Row', 'Avenue', 'Rd.', 'St.'))}{pick(('', ', ' + town(), ', ' + town() + f' {pick("BKLNS")}{n(1)} {n(1)}{pick("ABXZ")}{pick("ABXZ")}', ', ' + town() + ' ' + n(5)))}"
        if lang == "DE":
            return f"{pick((street + 'straße', street + 'weg', 'Am ' + street + 'platz'))} {k}{pick(('', 'a'))}, {pick(('', n(5) + ' ', 'D-' + n(5) + ' '))}{town()}"
        if lang == "FR":
            return f"{k}{pick(('', ' bis'))}, {pick(('rue des', 'quai des', 'avenue du'))} {street}, {pick(('', n(5) + ' '))}{town()}"
        if lang == "RU":
            return f"ул. {pick(('Берёзовая', 'Озёрная', 'Полевая', 'Школьная'))}, д. {k}{pick(('', ', кв. ' + n(2)))}"
        return f"{pick('北南东西')}{pick('山江湖桥')}{pick('市县镇区')}{pick('青白金大')}{pick('松竹石云')}{pick('路街巷')}{k}号"
    d = lambda k: rng.choice("123456789") + n(k - 1)
    if kind == "PHONE":
        return {
            "EN": pick((f"+44 {d(2)} {d(4)} {n(4)}", f"0{d(2)} {d(4)} {n(4)}", f"(0{d(2)}){n(8)}", f"(0{d(4)}) {n(6)}", f"0{d(4)}-{n(3)} {n(3)}", f"+1 ({d(3)}) {n(3)}-{n(4)}", f"({d(3)}) {n(3)}-{n(4)}", f"{d(3)}.{n(3)}.{n(4)}", f"001 {d(3)} {n(3)} {n(4)}", f"+1-{d(3)}-{n(3)}-{n(4)}", f"{d(3)}-{n(3)}-{n(4)}")),
            "DE": pick((f"+49 {d(2)} {n(5)} {n(3)}", f"(0{d(2)}) {n(5)} {n(3)}", f"0{d(2)}/{n(5)}-{n(3)}", f"0049 {d(2)} {n(8)}")),
            "FR": pick((f"+33 {d(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{d(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{d(1)}.{n(2)}.{n(2)}.{n(2)}.{n(2)}", f"0{d(1)}{n(2)} {n(6)}")),
            "RU": pick((f"+7 ({n(3)}) {n(3)}-{n(2)}-{n(2)}", f"8-{n(3)}-{n(3)}-{n(2)}-{n(2)}", f"8 ({n(3)}) {n(3)}-{n(2)}-{n(2)}")),
            "ZH": pick((f"+86 {d(2)} {n(4)} {n(4)}", f"(0{d(2)}) {n(4)}-{n(4)}", f"0{d(2)}-{n(8)}")),
        }[lang]
    big = lambda: rng.choice("ABCDEFGHKLMNPRSTWXYZ")
    return {
        "EN": pick((f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", n(9), f"{big()}{big()}{n(6)}{big()}", f"{big()}{big()} {n(2)} {n(2)} {n(2)} {big()}")),
        "DE": pick((f"{big()}{n(1)}{big()}{n(6)}", f"{big()}{n(1)} {big()}{n(6)}", f"{big()}{n(8)}")),
        "FR": pick((f"{pick('12')} {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}", f"{pick('12')}{n(12)}{n(2)}")),
        "RU": pick((f"{n(4)} {n(6)}", f"0{n(3)} {n(6)}", f"{n(2)} {n(2)} {n(6)}", f"0{n(1)} {n(2)} {n(6)}")),
        "ZH": f"{d(6)}{pick(('19', '20'))}{n(2)}{n(7)}{pick('0123456789X')}",
    }[lang]


def training_examples(finder: Finder, count: int = TRAINING, seed: int = 11) -> list[tuple[list[Segment], set[tuple[int, int, str]]]]:
    """Lattices of generated sentences with their true segments."""
    rng = random.Random(seed)
    given, family = sorted(finder.given) or ["ansel"], sorted(finder.family) or ["ostrand"]
    out = []
    for i in range(count):
        text, cases = "", []
        template = _TEMPLATES[i % len(_TEMPLATES)]
        at = 0
        for m in _SLOT.finditer(template):
            text += template[at : m.start()]
            value = _filled(rng, m[0], given, family)
            if kind := _KIND.get(m[0].split("_")[0]):
                cases.append((len(text), len(text) + len(value), kind))
            text += value
            at = m.end()
        text += template[at:]
        if rng.random() < 0.3:
            text = re.sub(" ", lambda m: "\n" if rng.random() < 0.1 else " ", text)
        segments = finder.candidates(text)
        gold = set()
        for s, e, kind in cases:
            fit = [x for x in segments if x.kind == kind and x.start == s and x.end <= e + 14]
            if fit:
                x = min(fit, key=lambda x: (abs(x.end - e), -x.end))
                gold.add((x.start, x.end, kind))
        out.append((segments, gold))
    return out


@lru_cache(maxsize=4)
def trained(given: frozenset[str], family: frozenset[str]) -> dict[str, float]:
    """The weights for a name list; always the same for the same list."""
    common = {w for f in family for w in [f] if w in _ALSO_WORDS} | set(_PLAIN_WORDS) | set("the on two under in from near at of by to road letters contact questions ring ticket card mill boat market bridge".split())
    return semicrf.train(training_examples(Finder(set(given), set(family), common)))


_ALSO_WORDS = frozenset("clay fisher garden marsh mason miller steele weaver baker brook carter cook field forest hill king lane mill page reed stone wood young".split())


_LOWER = re.compile(r"(?<![\w@.+-])[a-zà-öø-ÿ]{3,}(?![\w@]|[.+-]\w|\s?[\[(@]|\s[Aa][Tt]\s)")


def _lower_words(text: str | None) -> list[str]:
    return _LOWER.findall(text) if text else []


def _parts(df: DataFrame) -> DataFrame:
    """The list's parts; the table is a fixed list of a few hundred entries."""
    return df.select(F.lower(F.trim("name_part")).alias("part"), F.lower("part_kind").alias("kind")).filter("part <> ''").distinct()


def common_words(documents: DataFrame, lexicon: Finder, text_col: str) -> DataFrame:
    """(word): the words that occur in lower case often enough and in a candidate for a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            asked: set[str] = set()
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(_lower_words(text))
                    asked |= lexicon.name_words(text)
            if words := [*counts, *(asked - counts.keys())]:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64()), pa.array([w in asked for w in words], pa.bool_())], names=["word", "n", "asked"])

    counts = documents.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint, asked boolean")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")).filter((F.col("n") >= COMMON_COUNT) & F.col("asked")).select("word")


def finder(documents: DataFrame, names: DataFrame, text_col: str = "text") -> Finder:
    rows = _parts(names).collect()
    given, family = ({r.part for r in rows if r.kind == k} for k in ("given", "family"))
    common = common_words(documents, Finder(given, family, set()), text_col).collect()
    return Finder(given, family, {r.word for r in common}, trained(frozenset(given), frozenset(family)))


def occurrences(documents: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_char, end_char, kind) of every occurrence."""
    sent = documents.sparkSession.sparkContext.broadcast(finder(documents, names, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, s.start, s.end, s.kind) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for s in sent.value(t)]
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], names=["id", "start_char", "end_char", "kind"])

    return documents.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, start_char bigint, end_char bigint, kind string")


PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}


def redacted(documents: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, redacted, n_found): every text with typed placeholders in place of the occurrences."""
    sent = documents.sparkSession.sparkContext.broadcast(finder(documents, names, text_col))

    def one(text: str | None) -> tuple[str | None, int]:
        if not text:
            return text, 0
        out, at = [], 0
        found = sent.value(text)
        for s in found:
            out += [text[at : s.start], PLACEHOLDERS[s.kind]]
            at = s.end
        return "".join([*out, text[at:]]), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["id", "redacted", "n_found"])

    return documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id bigint, redacted string, n_found int")
