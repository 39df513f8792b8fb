"""Inline markup of a text, read in two scans.

The first scan takes what is complete in one place: links, note marks, formulas
in delimiters, line breaks and styling elements.  The second takes what opens and
closes, inline elements and runs of marks alike: every opener waits for its other
half, and both are replaced together; a half that stays alone is text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

# Elements by what they mean, marks with the longest content they may have, and bounds of formulas.
BOLD, ITALIC, CODE, MARKED, STRUCK, SCRIPT = ("strong", "b"), ("em", "i"), ("code",), ("mark", "u"), ("del", "s"), ("sup", "sub")
STYLING = ("span", "small", "font")
MARKS = {"***": 0, "___": 0, "**": 0, "__": 0, "~~": 0, "==": 0, "*": 0, "_": 0, "~": 60, "^": 60}
MATH_SIGNS = frozenset("=+-*/^_{}\\<>≤≥≈≠∈∉∂√∞∑∏∫")
MATH_CHARS, MATH_PLAIN_CHARS, NOTE_CHARS = 220, 80, 24
AS_MARKDOWN = dict.fromkeys(BOLD, "**") | dict.fromkeys(ITALIC, "*") | dict.fromkeys(CODE, "`") | dict.fromkeys(MARKED, "==") | dict.fromkeys(STRUCK, "~~") | dict.fromkeys(SCRIPT, "")
AS_NOTHING = dict.fromkeys(AS_MARKDOWN, "")

_PLACE = re.compile(
    r"(?P<link>!?\[(?P<label>[^\]]*)\]\([^)]*\))"
    rf"|\[\^(?P<note>[^\]\n]{{1,{NOTE_CHARS}}})\]"
    r"|\\\((?P<round>.*?)\\\)|\\\[(?P<square>.*?)\\\]"
    r"|(?<!\\)\$\$(?P<display>[^$\n]+?)(?<!\\)\$\$|(?<!\\)\$(?P<dollar>[^$\n]+?)(?<!\\)\$"
    r"|(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)\b[^<>]*>)",
    re.S,
)
_HALF = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|```[A-Za-z0-9_-]*\n?|`|\*{1,3}|_{1,3}|~~?|==|\^|\n")


def is_likely_math(text: str | None) -> bool:
    """Whether the inside of a pair of dollars reads as mathematics."""
    body = (text or "").strip()
    if not body or len(body) > MATH_CHARS or re.search(r"\s\s", body):
        return False
    if not MATH_SIGNS.isdisjoint(body):
        return True
    letters = [c for c in body if c.isascii() and c.isalpha() or "Α" <= c <= "ω"]
    return bool(letters) and len(body) <= MATH_PLAIN_CHARS and all(c in letters or c.isascii() and (c.isdigit() or c in "().,;: ") for c in body)


def _places(text: str, math: Callable[[str, str], str], links: bool) -> str:
    def one(m: re.Match) -> str:
        if m["tag"]:
            name = m["name"].lower()
            return " " if name == "br" else "" if name in STYLING else m[0]
        if m["note"] is not None:
            return m["note"] if links else m[0]
        if m["link"]:
            return _places(m["label"], math, links) if links and (m["label"] or m[0][0] == "!") else m[0]
        body = next(g for g in (m["round"], m["square"], m["display"], m["dollar"]) if g is not None)
        return math(body, m[0]) if body else m[0]

    return _PLACE.sub(one, text)


def _halves(text: str, elements: Mapping[str, str], marks: bool) -> str:
    """The text with paired elements replaced by their marks and, if asked, paired marks dropped."""
    out: list[str] = []
    waiting: dict[str, list[tuple[int, int]]] = {}
    at = 0
    for m in _HALF.finditer(text):
        out += [text[at : m.start()], m[0]]
        at = m.end()
        token, here = m[0], len(out) - 1
        if token == "\n":
            if marks:
                for mark in MARKS:
                    waiting.pop(mark, None)
        elif m[1]:
            name = m[1].lower()
            if name not in elements:
                continue
            if token[1] != "/":
                waiting.setdefault(name, []).append((here, m.end()))
            elif waiting.get(name):
                out[waiting[name].pop()[0]] = out[here] = elements[name]
        elif marks:
            key = "```" if token.startswith("```") else token
            (i, end), bound = (waiting.pop(key) or [(0, 0)])[0] if key in waiting else (-1, 0), MARKS.get(key, 0)
            if i < 0 or m.start() == end and key in MARKS or bound and m.start() - end > bound:
                waiting[key] = [(here, m.end())]
            else:
                out[i] = ""
                out[here] = "" if key != "```" else token[3:].strip("\n") if token.strip("`\n") else ""
    if marks and "```" in waiting:  # an opener of a fence that never closes goes where it stands alone
        i = waiting["```"][0][0]
        if not "".join(out[:i]).rpartition("\n")[2].strip() and out[i].endswith("\n"):
            out[i] = ""
    return "".join([*out, text[at:]])


def strip_html(text: str | None) -> str | None:
    """Line breaks as spaces; inline elements unwrapped; styling elements dropped."""
    return text and _halves(_places(text, lambda body, raw: raw, False), AS_NOTHING, False)


def html_as_markdown(text: str | None) -> str | None:
    """Inline elements and formula delimiters in their Markdown form."""
    if not text:
        return text
    placed = _places(text, lambda body, raw: f"${body}$", False)
    return re.sub(rf"\[\^([^\]\n]{{1,{NOTE_CHARS}}})\]", r"\1", _halves(placed, AS_MARKDOWN, False))


def strip_markdown(text: str | None) -> str | None:
    """Text without inline Markdown and HTML: links, images, code, emphasis, strikes, marks and math-like dollars."""
    if not text:
        return text

    def math(body: str, raw: str) -> str:
        return body.strip() if "\n" not in body and is_likely_math(body) else raw if raw.startswith("$") and not raw.startswith("$$") else f"${body}$"

    return _halves(_places(text, math, True), AS_NOTHING, True)
