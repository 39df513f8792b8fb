"""Noise in text from scanned pages: find it, and repair it into continuous paragraphs.

*Headers and page numbers.*  Each line is reduced to its letters with digits
masked; a line whose letters are those of the file's running title is a header,
a line that holds nothing but a page number is one.

*Broken words.*  A word that ends in a hyphen (or a mark used as one) before a
line end goes on in the next line that is neither header nor page number; one
broken by a hyphen and a space is joined where the corpus knows the whole word
or doesn't know the halves.

*Misread characters.*  The words of all distinct values are counted for each language and
grouped by a skeleton in which confusable glyphs are equal (characters are
reduced to their strokes).  A form is misread if a far more frequent word with
its skeleton, supported in the same language, becomes it by known misreadings,
each taken in both directions.
Names and codes are not repaired.

Defined results of odd input: null and empty values have no noise; without a
title no line is a header; ties between frequent forms go to the more frequent,
then to the alphabetically first; repeated rows are judged alike.  Extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.lookalike import CYRILLIC_AS_LATIN, GREEK_AS_CYRILLIC, GREEK_AS_LATIN
from pageflow.llm.textlang import language
from pageflow.llm.truncation import heading_like
from pageflow.session import checkpointed

#: A word must occur so often to be a repair, and so many times as often as the form it repairs.
SUPPORT, TIMES = 5, 8
#: A word with at least this share of capitals inside sentences is a name.
NAME_SHARE = 0.6
#: So many known words, by frequency, are sent to the workers, so that only the others are shuffled and joined.  A bound, not a filter of results.
KNOWN_WORDS = 50_000

# What a recogniser writes for what, in order of frequency.
MISREADINGS = [
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("i", "!"), ("n", "ri"), ("l", "1"), ("i", "1"), ("d", "cl"), ("o", "0"),
    ("s", "5"), ("u", "ii"), ("m", "rn"), ("g", "9"), ("h", "b"), ("b", "6"), ("w", "vv"), ("in", "m"), ("y", "v"), ("li", "h"),
    ("о", "0"), ("и", "н"), ("й", "и"), ("л", "д"), ("з", "3"), ("б", "6"), ("ш", "щ"), ("п", "н"), ("н", "и"),
]
# Skeletons are equal whichever of two forms was read for the other, so a misreading counts in both directions.
_RULES = list(dict.fromkeys(rule for a, b in MISREADINGS for rule in ((a, b), (b, a))))
# Each glyph as its strokes; forms that are misread for each other get one skeleton.
_STROKES = str.maketrans(
    {"l": "i", "1": "i", "!": "i", "|": "i", "r": "i", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "m": "iii", "d": "ei", "c": "e", "f": "t", "w": "vv", "y": "v", "0": "o", "5": "s", "9": "g", "о": "o", "н": "и", "й": "и", "п": "и", "л": "д", "3": "з", "б": "ii", "щ": "ш"}
)
_MARK = "-\u00AC=\u2010\u2011\u00AD\u2E17"
_WORD = re.compile(r"(?<![^\W_])[!|]?[^\W_]+(?:[!|][^\W_]+)*(?:[!|](?=[^\W_]))?")
_MID_CAPITAL = re.compile(r"(?<=[^\W_] )[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W_]+")
_ENDS_BROKEN = re.compile(rf"(?<![^\W\d_])([^\W\d_]+)[{_MARK}][ \t\r]*$")
_BEGINS = re.compile(r"\s*([^\W\d_]+)")
_INLINE = re.compile(rf"(?<![^\W_])([^\W\d_]+)[{_MARK}][ \t]+([^\W\d_]+)")
_SPACED = re.compile(rf"[{_MARK}][ \t]+[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_HALVES = frozenset("and or to und oder bis noch sowie et ou ni à и или ни до".split())
# Small Roman numerals to 999; "di" and "dix" are words, "cm" a unit, and numerals with m at their head are years.
_ROMAN = r"(?-i:(?=[ivxl]|[cd][ivxlcdm])(?!(?:di|dix|cm)\Z)(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
# A number of four digits may be a year, unless a page word, a total or marks stand with it.
_PAGE_NO = re.compile(r"(?:(?:pp?|s|с|стр|page|seite)\.?\s*)?(?:\d{1,3}(?:\s*/\s*\d{1,4})?)|(?:pp?\.?|[sс]\.|стр\.?|page|seite)\s*\d{4}(?:\s*/\s*\d{1,4})?|\d{4}\s+/\s+\d{4}|[\[(—–-]+\s*\d{1,4}\s*[\])—–-]+|第\s*\d{1,4}\s*页|" + _ROMAN, re.I)
_INVISIBLE = {ord(c): None for c in "\u00AD\u034F\u200B\u200C\u200D\u200E\u200F\u2060\u2061\u2062\u2063\u2064\uFEFF"}
_SPACES = {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_TO_LATIN = {ord(x[0]): x[1] for x in (CYRILLIC_AS_LATIN + " " + GREEK_AS_LATIN).split()}
_TO_CYRILLIC = {ord(x[1]): x[0] for x in reversed(CYRILLIC_AS_LATIN.split())} | {ord(x[0]): x[1] for x in GREEK_AS_CYRILLIC.split()}
_PLAIN = re.compile(r"[\x00-\xff—–‘’“”«»…№Ѐ-ӿ㐀-鿿，。、；：（）]*")
_LATIN_CYRILLIC = re.compile(r"[a-zA-ZÀ-ÿͰ-Ͽ][Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ][a-zA-ZÀ-ÿͰ-Ͽ]")
_STOPS = ("", ".", "!", "?", "。", "！", "？", ">", "|", "`", "$")
_MIXED = re.compile(r"[^\W\d_]+")


def _one_script(m: re.Match) -> str:
    word = m[0]
    if word.isascii():
        return word
    cyrillic = sum("Ѐ" <= c <= "ӿ" and ord(c) not in _TO_LATIN for c in word)
    latin = sum(c < "ɐ" and ord(c) not in _TO_CYRILLIC for c in word)
    greek = sum("Ͱ" <= c <= "Ͽ" for c in word)
    if greek == len(word):
        return word
    return word.translate(_TO_CYRILLIC if cyrillic > latin else _TO_LATIN if latin > cyrillic or greek else {})


@lru_cache(maxsize=1)
def plain(text: str) -> str:
    """The text in one form of characters, as far as words and titles are compared."""
    if text.isascii():
        return text
    if not _PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFC", text.translate(_INVISIBLE).translate(_SPACES))
        text = "".join(chr(ord(c) - 0xFEE0) if "０" <= c <= "ｚ" and c.isalnum() else c for c in text)
    elif "\xa0" in text or "\xad" in text:
        text = text.replace("\xa0", " ")
    return _MIXED.sub(_one_script, text) if _LATIN_CYRILLIC.search(text) else text


@lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """The strokes of a lower-case word; confusable forms have the same."""
    return word.translate(_STROKES)


def misread_as(word: str, form: str) -> bool:
    """Whether *form* comes from *word* by one or more of the known misreadings and nothing else."""
    reached = {(0, 0)}
    frontier = [(0, 0)]
    while frontier:
        i, j = frontier.pop()
        if i == len(word) and j == len(form):
            return word != form
        steps = [(i + 1, j + 1)] if i < len(word) and j < len(form) and word[i] == form[j] else []
        steps += [(i + len(a), j + len(b)) for a, b in _RULES if word.startswith(a, i) and form.startswith(b, j)]
        for s in steps:
            if s not in reached:
                reached.add(s)
                frontier.append(s)
    return False


def title_key(line: str) -> str:
    """A line's letters by their skeleton; digits, spaces and marks are masked."""
    return _NO_LETTER.sub("", line).lower().translate(_STROKES)


def line_kinds(lines: Sequence[str], title: str | None) -> list[str]:
    """"header", "page_no" or "" for each line of a value in plain form."""
    key = title_key(plain(title)) if title else ""
    size = sum(map(str.isalpha, title)) if title else 0
    out = []
    for line in lines:
        s = line.strip()
        kind = ""
        if s and len(s) <= 24 and _PAGE_NO.fullmatch(s):
            kind = "page_no"
        elif size and s and size <= len(s) <= 5 * size + 24 and s[0] != "#":
            bare = re.sub(r"\{\{[^{}]*\}\}|</?[a-z][^<>]*>", "", s, flags=re.I) if "{" in s or "<" in s else s
            if not bare.endswith((".", ",", ";")) and title_key(bare) == key:
                kind = "header"
        out.append(kind)
    return out


def broken_words(lines: Sequence[str], kinds: Sequence[str]) -> list[tuple[int, int, str]]:
    """(line of the first half, line of the second, whole word) of the words broken at line ends."""
    out = []
    after = [0] * len(lines)  # the next line of running text
    j = len(lines)
    for i in reversed(range(len(lines))):
        after[i] = j
        if not kinds[i] and lines[i].strip():
            j = i
    for i, line in enumerate(lines):
        s = line.rstrip()
        if not s or s[-1] not in _MARK or after[i] == len(lines) or not (m := _ENDS_BROKEN.search(s)):
            continue
        b = _BEGINS.match(lines[after[i]])
        if b and b[1][0].islower() and not (s[-1] == "-" and b[1] in _HALVES) and not re.search("[㐀-鿿]", m[1]):
            out.append((i, after[i], m[1] + b[1]))
    return out


def running_text(lines: Sequence[str], kinds: Sequence[str], broken: Sequence[tuple[int, int, str]]) -> str:
    """The value without headers and page numbers, its broken words joined."""
    kept = ["" if k else line for line, k in zip(lines, kinds, strict=True)]
    for i, j, _ in broken:
        m = _ENDS_BROKEN.search(kept[i].rstrip())
        b = _BEGINS.match(kept[j])
        kept[i] = kept[i][: m.start(1)] + m[1] + b[1]
        kept[j] = kept[j][b.end(1) :]
    text = "\n".join(kept)
    return _INLINE.sub(lambda m: m[0] if m[2].lower() in _HALVES else m[1] + m[2], text) if _SPACED.search(text) else text


def _words(text: str) -> list[str]:
    words = _WORD.findall(text)
    return words[:-1] if text[-1:].isalpha() else words  # a cut word is no misread one


def _analysed(text: str, title: str | None) -> tuple[str, list[str], list[str], list[tuple[int, int, str]]]:
    lines = plain(text).split("\n")
    kinds = line_kinds(lines, title)
    broken = broken_words(lines, kinds)
    return running_text(lines, kinds, broken), lines, kinds, broken


def with_titles(df: DataFrame, files: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, title, fields): Spark chooses the join by the measured size of the file list."""
    titles = files.groupBy(F.col("file_id").alias("_file")).agg(F.min("title").alias("_title"))
    return df.join(titles, F.col("file_id") == F.col("_file"), "left").select(F.col(id_col).cast("bigint").alias("id"), F.col("_title").alias("title"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields)])


def word_counts(values: DataFrame, n_fields: int) -> DataFrame:
    """(lang, word, n, mid): lower-case words of all distinct values, and how often each has a capital inside a sentence.

    A text is counted once, however many rows and fields carry it: a form that
    is read wrongly in one text with many copies is no frequent word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, Counter[str]] = defaultdict(Counter)
            mid: dict[str, Counter[str]] = defaultdict(Counter)
            for text in batch.column(0).to_pylist():
                flat = plain(text)
                flat = re.sub(rf"[{_MARK}]\s*\n\s*", "", flat) if "\n" in flat else flat
                words = _words(flat.lower())
                lang = language(words)
                total[lang].update(words)
                mid[lang].update(_MID_CAPITAL.findall(flat))
            for lang, counts in total.items():
                capitals: Counter[str] = Counter()
                for w, n in mid[lang].items():
                    capitals[w.lower()] += n
                words = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([capitals[w] for w in words], pa.int64())], names=["lang", "word", "n", "mid"])

    texts = values.select(F.explode(F.array(*[f"t{i}" for i in range(n_fields)])).alias("t")).filter("t <> ''").distinct()
    return texts.mapInArrow(run, "lang string, word string, n bigint, mid bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("mid").alias("mid"))


def misread_forms(counts: DataFrame) -> DataFrame:
    """(lang, word, repair): the forms that are misread, each with the frequent form of its skeleton that explains it."""

    def add_skeleton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([skeleton(w) for w in batch.column(1).to_pylist()], pa.string())], names=["lang", "word", "n", "mid", "skeleton"])

    forms = counts.filter(F.length("word") > 2).select("lang", "word", "n", "mid").mapInArrow(add_skeleton, "lang string, word string, n bigint, mid bigint, skeleton string")
    named = F.col("mid") >= NAME_SHARE * F.col("n")
    abroad = counts.filter(named & F.col("lang").isin("en", "fr") & (F.col("n") >= SUPPORT)).select("word", F.lit(True).alias("abroad")).distinct()
    good = forms.filter((F.col("n") >= SUPPORT) & F.col("word").rlike(r"^[^\d!|]+$") & ((F.col("lang") == "de") | ~named)).join(abroad, "word", "left").filter(F.col("abroad").isNull())
    good = good.select("lang", "skeleton", F.col("word").alias("repair"), F.col("n").alias("support"))
    odd = F.col("word").rlike(r"[\d!|]")
    pairs = forms.join(good, ["lang", "skeleton"]).filter((F.col("word") != F.col("repair")) & (F.col("support") >= F.when(odd, F.col("n")).otherwise(F.col("n") * TIMES)))

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, r = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield batch.filter(pa.array([misread_as(b, a) for a, b in zip(w, r, strict=True)], pa.bool_()))

    best = pairs.select("lang", "word", "repair", "support").mapInArrow(explained, "lang string, word string, repair string, support bigint")
    return best.groupBy("lang", "word").agg(F.min(F.struct((-F.col("support")).alias("s"), "repair")).alias("b")).select("lang", "word", F.col("b.repair").alias("repair"))


def _known(counts: DataFrame, forms: DataFrame) -> tuple[frozenset[tuple[str, str]], DataFrame]:
    """The most frequent known words as (lang, word), and the known words beyond them."""
    known = counts.join(forms.select("lang", "word"), ["lang", "word"], "left_anti").filter(F.col("n") >= SUPPORT)
    top = known.orderBy(F.desc("n"), "lang", "word").limit(KNOWN_WORDS).select("lang", "word", "n").collect()
    after = F.lit(False)
    if len(top) == KNOWN_WORDS:
        last = max(top, key=lambda r: (-r.n, r.lang.encode(), r.word.encode()))
        after = (F.col("n") < last.n) | ((F.col("n") == last.n) & ((F.col("lang") > last.lang) | ((F.col("lang") == last.lang) & (F.col("word") > last.word))))
    return frozenset((r.lang, r.word) for r in top), known.filter(after).select("lang", "word")


class PageNoise:
    """The noise of a table of pages, and its repair."""

    def __init__(self, df: DataFrame, files: DataFrame, id_col: str, fields: Sequence[str]):
        self.fields = list(fields)
        self.values = with_titles(df, files, id_col, fields)
        counts = df.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields)])
        self.counts = checkpointed(word_counts(counts, len(fields)))
        self.forms = checkpointed(misread_forms(self.counts))
        top, self.rarer = _known(self.counts, self.forms)
        self.known = df.sparkSession.sparkContext.broadcast(top)

    def events(self) -> DataFrame:
        """(id, field, kind, lang, word, at): kinds found by line, and the words that may be misread (kind ``word``).

        An inline break that the words at hand don't settle is a number ``at``
        with its whole word and those halves that may be unknown.
        """
        fields, sent = self.fields, self.known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, set[str]] = defaultdict(set)
            for lang, word in sent.value:
                known[lang].add(word)
            for batch in batches:
                out: list[tuple] = []
                ids, titles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for k, field in enumerate(fields):
                    for i, title, text in zip(ids, titles, batch.column(2 + k).to_pylist(), strict=True):
                        if not text:
                            continue
                        flat, lines, kinds, broken = _analysed(text, title)
                        words = _words(flat.lower())
                        lang = language(words)
                        own = known[lang]
                        out += [(i, field, x, None, None, None) for x in {*kinds} - {""}]
                        inline = {(m[1].lower(), m[2].lower()) for line in lines if _SPACED.search(line) for m in _INLINE.finditer(line) if m[2].lower() not in _HALVES and (m[2][0].islower() or m[1].isupper())}
                        if broken or any(a + b in own for a, b in inline):
                            out.append((i, field, "hyphen", None, None, None))
                        else:
                            for n, (a, b) in enumerate(sorted(inline)):
                                out.append((i, field, "whole", lang, a + b, n))
                                out += [(i, field, "half", lang, x, n) for x in {a, b} - own]
                        out += [(i, field, "word", lang, w, None) for w in {*words} - own if len(w) > 2]
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *[pa.array(x, pa.string()) for x in c[1:5]], pa.array(c[5], pa.int32())], names=["id", "field", "kind", "lang", "word", "at"])

        return self.values.mapInArrow(run, "id bigint, field string, kind string, lang string, word string, at int")

    def found(self) -> DataFrame:
        """(id, field, kind) with the kinds hyphen, misread, header and page_no."""
        judged = self.forms.select("lang", "word", "repair").unionByName(self.rarer.withColumn("repair", F.lit(None).cast("string"))).withColumn("judged", F.lit(True))
        events = self.events().join(judged, ["lang", "word"], "left").filter((F.col("kind") != "word") | F.col("repair").isNotNull())
        # A rarer word is known if it is judged and no misread form.
        known = F.col("judged").isNotNull() & F.col("repair").isNull()
        kind = F.when(F.col("kind") == "word", "misread").when(F.col("kind").isin("half", "whole"), "hyphen").otherwise(F.col("kind"))
        kinds = events.groupBy("id", "field", kind.alias("kind"), "at").agg(F.bool_or((F.col("kind") == "whole") & known).alias("joined"), F.bool_or((F.col("kind") == "half") & ~known).alias("odd"))
        return kinds.filter(F.col("at").isNull() | F.col("joined") | F.col("odd")).select("id", "field", "kind").distinct()

    def repaired(self) -> DataFrame:
        """(id, field, repaired): continuous paragraphs without headers and page numbers, broken and misread words made good.

        Lines are rows; SQL windows give each line its paragraph: a new one
        begins after a blank line and around lines with a structure of their own.
        """
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for k, field in enumerate(fields):
                    for i, title, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2 + k).to_pylist(), strict=True):
                        if text is None:
                            continue
                        lines = text.split("\n")
                        kinds = line_kinds([plain(x) for x in lines], title)
                        flat = running_text(lines, kinds, broken_words(lines, kinds)).split("\n")
                        out += [(i, field, n, line, heading_like(line.strip()) and (n == 0 or flat[n - 1].strip()[-1:] in _STOPS)) for n, (line, kind) in enumerate(zip(flat, kinds, strict=False)) if not kind]
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()), pa.array(c[4], pa.bool_())], names=["id", "field", "n", "line", "head"])

        lines = self.values.mapInArrow(run, "id bigint, field string, n int, line string, head boolean")
        order = Window.partitionBy("id", "field").orderBy("n")
        own = F.col("line").rlike(r"^\s*(?:[#>|$`*+\\<{=]|- |\d+[.)] |[-*_]{3,}\s*$)|[|`>]\s*$")
        blank = F.trim("line") == ""
        fence = (F.sum(F.col("line").rlike(r"^\s*(?:```|\$\$)").cast("int")).over(order) % 2) == 1
        marked = lines.withColumns({"blank": blank, "own": own | fence | F.col("head")})
        begins = (F.col("blank") | F.col("own") | F.coalesce(F.lag("blank").over(order) | F.lag("own").over(order), F.lit(True))).cast("int")
        numbered = marked.withColumn("para", F.sum(begins).over(order))
        paras = numbered.groupBy("id", "field", "para").agg(F.min("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: F.trim(x["line"])), " ").alias("joined"), F.min("line").alias("line"), F.max("own").alias("own"))
        kept = paras.withColumn("p", F.when(F.col("own"), F.col("line")).otherwise(F.trim(F.regexp_replace("joined", r"\s+", " "))))
        texts = kept.groupBy("id", "field").agg(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), "\n"), r"\n{3,}", "\n\n").alias("t"))
        fixes = self.events().filter("kind = 'word'").join(self.forms, ["lang", "word"]).groupBy("id", "field").agg(F.collect_set(F.struct("word", "repair")).alias("fixes"))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_apply_fixes(t, {x["word"]: x["repair"] for x in f}) if f else t for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "field", "repaired"])

        return texts.join(fixes, ["id", "field"], "left").select("id", "field", "t", "fixes").mapInArrow(apply, "id bigint, field string, repaired string")


def _apply_fixes(text: str, fixes: dict[str, str]) -> str:
    def fix(m: re.Match) -> str:
        good = fixes.get(plain(m[0]).lower())
        if good is None:
            return m[0]
        return good.upper() if m[0].isupper() and len(m[0]) > 1 else good[0].upper() + good[1:] if m[0][0].isupper() else good

    return _WORD.sub(fix, text)
