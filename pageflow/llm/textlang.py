"""Words and languages of texts, for operators that need them per value."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Han characters are words of their own.
HAN = "㐀-䶿一-鿿豈-﫿"
WORDS = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
IS_HAN = re.compile(f"[{HAN}]")
_STOPS = {
    "en": frozenset("the of and was that with from which were is by for in to as at had been on".split()),
    "de": frozenset("der die das und wurde nicht ein eine von mit für im war den nach ist zu auf auch".split()),
    "fr": frozenset("la le les des et une un fut est dans que pour du par sur avec en aux qui".split()),
}


def language(words: Iterable[str], default: str = "en") -> str:
    """The likely language of lower-case words: by script, else by function words."""
    distinct = set(words)
    best, score = default, 0
    for lang, stops in _STOPS.items():
        if (n := len(distinct & stops)) > score:
            best, score = lang, n
    if score < 3:
        text = "".join(distinct)
        if len(IS_HAN.findall(text)) * 2 > len(distinct):
            return "zh"
        if sum("Ѐ" <= c <= "ӿ" for c in text) * 2 > len(text):
            return "ru"
    return best
