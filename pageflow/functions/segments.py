"""Text in runs: by inline style, and by script."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Inline marks and the style of what they enclose, the longest first.
_STYLES = (("***", "bold_italic"), ("___", "bold_italic"), ("**", "bold"), ("__", "bold"), ("~~", "strike"), ("==", "mark"), ("``", "code"), ("`", "code"), ("$", "math"), ("*", "italic"), ("_", "italic"))
_MARK = re.compile("|".join(re.escape(m) for m, _ in _STYLES))
_STYLE = dict(_STYLES)
SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("style", T.StringType())]))


def inline_segments(text: str | None) -> list[tuple[str, str]]:
    """(text, style) of a line's runs; a mark without its pair is text, nested marks give their inner style."""
    if not text:
        return []
    out: list[tuple[str, str]] = []

    def add(piece: str, style: str) -> None:
        if piece:
            if out and out[-1][1] == style:
                piece = out.pop()[0] + piece
            out.append((piece, style))

    at = 0
    while at < len(text):
        m = _MARK.search(text, at)
        if not m:
            break
        end = text.find(m[0], m.end())
        inner = text[m.end() : end] if end > m.end() else ""
        if not inner or inner != inner.strip() or "\n" in inner:
            add(text[at : m.end()], "normal")
            at = m.end()
            continue
        add(text[at : m.start()], "normal")
        if _STYLE[m[0]] in ("code", "math"):
            add(inner, _STYLE[m[0]])
        else:
            for piece, style in inline_segments(inner):
                add(piece, _STYLE[m[0]] if style == "normal" else style)
        at = end + len(m[0])
    add(text[at:], "normal")
    return out


@F.pandas_udf(SEGMENTS)
def segments(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`inline_segments` over batches."""
    for s in lines:
        yield s.map(lambda t: [{"text": a, "style": b} for a, b in inline_segments(t)])


def script_runs(text: Column) -> Column:
    """A text's runs of one script, in order: Han with its punctuation, Cyrillic, Greek, Latin with everything common, other."""
    han, cyrillic, greek, latin = r"[⺀-鿿豈-﫿＀-￯]+", r"[Ѐ-ԯ]+", r"[Ͱ-Ͽἀ-῿]+", r"[\u0000-ɏḀ-ỿ -⁯]+"
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?:{han}|{cyrillic}|{greek}|{latin}|[^\\u2e80-\\u9fff\\uf900-\\ufaff\\uff00-\\uffef\\u0370-\\u052f\\u1f00-\\u1fff\\u0000-\\u024f\\u1e00-\\u1eff\\u2000-\\u206f]+)"), 0)
    return F.transform(runs, lambda r: F.struct(r.alias("text"), F.when(r.rlike(han), "han").when(r.rlike(cyrillic), "cyrillic").when(r.rlike(greek), "greek").when(r.rlike(latin), "latin").otherwise("other").alias("script")))


def uncovered_chars(text: Column, covered: str) -> Column:
    """The sorted distinct characters outside a class of covered ones, given as the inside of a regular expression's brackets."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{covered}]"), 0)))


def safe_text(text: Column, covered: str) -> Column:
    """A text with a white square for every character that isn't covered."""
    return F.regexp_replace(text, f"[^{covered}]", "□")
