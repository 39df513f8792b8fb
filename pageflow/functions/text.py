"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and patterns that decide results.
DOTS = r"\.．·•∙‧⋅・･"
DOT_LEADER_KEEP, DOT_EXPLOSION = 24, 300
PSEUDOTEXT_MIN_CHARS, PSEUDOTEXT_MIN_COORDS, PSEUDOTEXT_MIN_HASHES, PSEUDOTEXT_MAX_RATIO = 160, 6, 6, 0.58
ARTIFACT_MIN_TOKENS, ARTIFACT_COORDS, ARTIFACT_HASHES = 8, 4, 3
ARTIFACT_TOP_SHARE, ARTIFACT_DISTINCT_SHARE = (18, 100), (38, 100)
SUSPICIOUS_PHRASES = ("The New York Times", "January 1, 2020")
PANGRAM = r"(?i)^\s*the\s+quick\s+brown\s+fox\s+jumps\s+over\s+the\s+lazy\s+dog\.?\s*$"
RADICALS = r"[\u2e80-\u2fff\u31c0-\u31ef\uf900-\ufaff]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LATEX_RESIDUE = r"\\(?:frac|dfrac|tfrac|sqrt|text|textregistered|mathrm|mathbf|mathit|mathsf|operatorname|times|cdot|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega|leq|geq|neq|left|right)\b|[\^_]\s*\{"
TOKEN = r"[^ \t\n\x0B\f\r]+"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty; null if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The pattern replacements one after the other, as one nested expression."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, ends trimmed; line ends stay."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "))


def strip_control_chars(c: Column) -> Column:
    return replace_all(c, [(r"\r\n?", "\n"), (r"[\x00-\x08\x0b-\x1f\x7f\ufffd\ufeff]", "")])


def shorten_dot_leaders(c: Column) -> Column:
    """Leaders of more than 24 dots, spaced or plain, as 24 dots."""
    more = DOT_LEADER_KEEP + 1
    spaced = f"(?:[ \\t\\r\\n]*[{DOTS}][ \\t\\r\\n]*){{{more},}}"
    return replace_all(c, [(spaced, " ".join(["."] * DOT_LEADER_KEEP)), (f"[{DOTS}]{{{more},}}", "." * DOT_LEADER_KEEP)])


def has_dot_explosion(c: Column) -> Column:
    return or_empty(c).rlike(f"(?:[ \\t\\r\\n]*[{DOTS}][ \\t\\r\\n]*){{{DOT_EXPLOSION},}}")


def ngrams(key: Column, size: int = 16) -> Column:
    """The distinct runs of *size* characters; none where the text is shorter."""
    places = F.sequence(F.lit(1), F.length(key) - size + 1)
    return F.when(F.length(key) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(key, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def is_page_number_like(c: Column) -> Column:
    return F.trim(or_empty(c)).rlike(r"^(?:\[?\d{1,4}\]?|[ivxlcdmIVXLCDM]{1,8})$")


def is_numeric_page_marker(c: Column) -> Column:
    return F.trim(or_empty(c)).rlike(r"^(?:\d{1,4}|\[\s*\d{1,4}\s*\])$")


def is_font_test_text(c: Column) -> Column:
    return or_empty(c).rlike(PANGRAM)


def has_radicals(c: Column) -> Column:
    return or_empty(c).rlike(RADICALS)


def has_control_chars(c: Column) -> Column:
    return or_empty(c).rlike(CONTROLS)


def has_latex_residue(c: Column) -> Column:
    return or_empty(c).rlike(LATEX_RESIDUE)


def has_suspicious_phrase(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [or_empty(c).contains(p) for p in SUSPICIOUS_PHRASES])


def tokens(c: Column) -> Column:
    """Lower-case tokens between ASCII white space."""
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(TOKEN), 0)


def coordinate_tokens(token_array: Column) -> Column:
    return F.size(F.filter(token_array, lambda t: t.rlike(r"^[xy]\s*=?-?\d+(?:\.\d+)?$")))


def hash_tokens(token_array: Column) -> Column:
    return F.size(F.filter(token_array, lambda t: t == "###"))


def top_token_count(token_array: Column) -> Column:
    """How often the most frequent token occurs: the longest run of the sorted tokens, in one fold."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(t == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(token_array), zero, step, lambda acc: acc["best"])


def is_token_artifact(n: Column, coords: Column, hashes: Column, top: Column, distinct: Column) -> Column:
    """Whether tokens repeat as generated debris does; shares are compared as whole numbers."""
    crowded = (top * ARTIFACT_TOP_SHARE[1] >= n * ARTIFACT_TOP_SHARE[0]) | (distinct * ARTIFACT_DISTINCT_SHARE[1] <= n * ARTIFACT_DISTINCT_SHARE[0])
    return (n >= ARTIFACT_MIN_TOKENS) & ((coords >= ARTIFACT_COORDS) | (hashes >= ARTIFACT_HASHES) | crowded)


def format_seconds(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s of a number of seconds, rounded."""
    s = F.greatest(F.lit(0), F.round(seconds).cast("bigint"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def strip_heading_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\s{0,3}#{1,6}(?:\s+|$)", "")


def unwrap_citations(c: Column) -> Column:
    """Superscript citations, and scripts in braces, without their marks: one pattern for the three ways to write them."""
    cite = r"\[[0-9][0-9,;，、\-– ]{0,80}\]"
    return F.regexp_replace(c, rf"(?:\\textsuperscript\s*\{{|\^\s*[{{(])\s*({cite})\s*[)}}]|[\^_]\s*\{{\s*([^{{}}\n]{{1,60}})\s*\}}", "$1$2")


def fix_symbol_confusables(c: Column) -> Column:
    """The neuter sign before the Chinese word for function is a capital psi."""
    return F.regexp_replace(c, "\u26b2(?=\\s*\u51fd\u6570)", "\u03a8")


def line_class(c: Column) -> Column:
    """The Markdown class of a line: rule, code, heading1 to heading6, footnote, quote, list, table, blank or normal."""
    t = F.trim(or_empty(c))
    out = F.when(t == "", "blank").when(t.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$"), "rule").when(t.rlike("^```"), "code")
    for k in range(1, 7):
        out = out.when(t.rlike(rf"^#{{{k}}}(?:\s|$)"), f"heading{k}")
    return out.when(t.rlike(r"^\[\^[^\]]+\]:"), "footnote").when(t.rlike(r"^>"), "quote").when(t.rlike(r"^(?:[-*+•]|\d+[.)])\s"), "list").when(t.rlike(r"^\|.*\|$"), "table").otherwise("normal")
