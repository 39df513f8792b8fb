"""Very long and degenerate texts: every function's time stays in proportion to the text."""

from __future__ import annotations

import time

import pytest

from pageflow.llm import markup, pagenoise, pii, repetition, spans, tokens, truncation

TEXTS = {
    "letters": "a" * 60_000,
    "han": "甲" * 60_000 + "-\n",
    "han and mark": "甲乙" * 30_000 + "1",
    "words": "word " * 20_000,
    "marks": "-" * 60_000,
    "digits": "1234567 " * 8_000,
    "capitals": "Abc " * 15_000,
    "line ends": "\n" * 60_000,
    "ats": "a@b " * 15_000,
    "brackets": "<" * 20_000 + "[" * 20_000 + "{{" * 10_000,
    "zero width": "​" * 60_000,
}


def finder():
    given, family = frozenset(["ansel"]), frozenset(["ostrand"])
    return pii.Finder(set(given), set(family), set(), pii.trained(given, family))


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_in_proportion(name):
    text = TEXTS[name]
    judge = markup.Judge(markup.model())
    find = finder()
    for f in (lambda t: pagenoise._analysed(t, "A title"), truncation.end_state, repetition.value_statistics, judge.clean, find, lambda t: spans.anchors(t, 100, 101)):
        began = time.perf_counter()
        f(text)
        assert time.perf_counter() - began < 4, (name, f)


def test_token_pieces_cover_the_text():
    for text in ("", "x" * 250_000, "word " * 60_000, "line\n" * 60_000):
        pieces = list(tokens._pieces(text))
        assert "".join(pieces) == text and all(len(p) <= tokens.PIECE for p in pieces)
