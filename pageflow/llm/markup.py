"""Markup residue in text documents: which markup a value holds, and its clean text.

A value is read as a forest of nodes: everything that looks like a tag, an
entity, a heading mark, an emphasis, a link, a template, a table, a command or a
formula, nested by containment; tags that open and close each other are the
elements around the nodes between them.  When a forest is complete, each node
gets its features: its own form, attribute tokens, the size and the kinds of its
subtree, its density, its depth, the form above it, its siblings of the same form
and the text around it.  Boosted trees score the classes none, html, markdown,
wiki and latex.

Decoding is joint: for each node and each state that its ancestors may leave it
in (free, in code, in a formula) the best score of its whole subtree is known from
below, so a descendant counts in the choice of its ancestors and none contradicts
them: nothing inside code is markup, and nothing inside a formula is anything but
LaTeX.

The trees are trained on generated texts (``training_nodes``): their number is
bounded by ``TRAINING`` and doesn't depend on the data.

Defined results of odd input: null and empty values have no markup; unclosed
openers are nodes of their own; a lone line that begins with a star is a
footnote and no list; repeated rows are judged alike.  Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.boosting import Boosted, fit

CLASSES = ("none", "html", "markdown", "wiki", "latex")
#: Number of generated training texts of each form.
TRAINING = 30
# Names of HTML elements.
_TAGS = frozenset(
    "a abbr article aside b blockquote body br caption center cite code col colgroup dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub sup svg table tbody td tfoot th thead title tr tt u ul var".split()
)
_FORMS = (
    ("fence", r"^[ \t]*```[^\n]*\n.*?(?:^[ \t]*```|\Z)"),
    ("display", r"\$\$.*?\$\$|\\\[.*?\\\]|\\begin\{[^{}\n]*\}.*?(?:\\end\{[^{}\n]*\}|\Z)"),
    ("template", r"\{\{[^{}]*\}\}"),
    ("wikitable", r"^\{\|.*?(?:^\|\}|\Z)"),
    ("wikilink", r"\[\[[^\[\]]*\]\]"),
    ("link", r"!?\[[^\[\]\n]*\]\((?:[^()\n]|\n(?!\s*\n)|\([^()\n]*\))*\)"),
    ("bracket", r"\[[^\[\]\n]+\]"),
    ("wikihead", r"^[ \t]*={1,6}[^=\n]+={1,6}[ \t]*$"),
    ("quotes", r"'{2,5}[^'\n]+'{2,5}"),
    ("strong", r"\*\*[^*\n]+\*\*|__[^_\n]+__"),
    ("emphasis", r"(?<![\w*])\*[^*\n]+\*(?![\w*])|(?<![\w_])_[^_\n]+_(?![\w_])"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->"),
    ("entity", r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"),
    ("angle", r"<[^<>\n]*>"),
    ("tablerow", r"^[ \t]*\|[^\n]*\|[ \t]*$"),
    ("heading", r"^[ \t]{0,3}#{1,6}(?!#)[ \t]*\S[^\n]*$"),
    ("quote", r"^[ \t]{0,3}>[ \t][^\n]*$"),
    ("bullet", r"^[ \t]*[*+-][ \t]+[^\n]*$"),
    ("formula", r"\$[^$\n]+\$"),
    ("command", r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("code", r"`[^`\n]+`"),
    ("hash", r"#+"),
)
_FORM_INDEX = {name: i for i, (name, _) in enumerate(_FORMS)}
_CONTAINERS = frozenset(("fence", "display", "template", "wikitable", "wikilink", "wikihead", "quotes", "strong", "emphasis", "tablerow", "heading", "quote", "bullet", "formula", "code", "command", "link"))
_SCAN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _FORMS), re.M | re.S)
_ANY = re.compile(r"[<&$\\#*`|{\[_]|''|^[ \t]*(?:[=>+]|- )", re.M)
_OPENERS = {c: i for i, c in enumerate("<&$\\#*`|{['_>-=+")}
_MARKS = re.compile(r"[<>&$\\#*`|{}\[\]=_^~]")


@dataclass
class Node:
    """A piece of a value that may be markup: its form, place, subtree and features."""

    form: str
    start: int
    end: int
    features: tuple[int, ...] = ()
    children: list[Node] = field(default_factory=list)
    size: int = 0  # nodes below
    tags: int = 0
    commands: int = 0


# Elements without content, and attributes of elements.
_VOID = frozenset("area base br col hr img input link meta source track wbr".split())
_ATTRIBUTE = re.compile(r"\s([A-Za-z-]+)\s*=")
_ATTRIBUTES = frozenset("align alt border cellpadding class colspan content height href id lang name rel rowspan scope src style target title type valign width".split())
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")


def _own_features(text: str, node: Node) -> tuple[int, ...]:
    """What a node is by its own text and the text around it."""
    form, start, end = node.form, node.start, node.end
    raw = text[start:end]
    body = raw.strip()
    first = body[:1]
    run = len(body) - len(body.lstrip(first)) if first else 0
    inner = body.strip("<>&;$*`|{}[]='_# \t")
    name = m[2].lower() if (m := _NAME.match(body)) else ""
    before = text[start - 1] if start else "\n"
    line_start = text.rfind("\n", 0, start) + 1
    alone = not text[line_start:start].strip()
    above = text[max(0, line_start - 80) : line_start].rstrip()
    unfinished = alone and bool(above) and line_start > 0 and text[line_start - 2 : line_start - 1] != "\n" and (above[-1].isalnum() or above[-1] in ",;(<>=")
    after = body[run:].lstrip()
    entity = form == "entity" and html.unescape(body) != body
    path = form == "command" and (before in ":\\" or before.isalnum() or before == "_") and start >= 2
    digits = sum(c.isdigit() for c in inner)
    given = [x.lower() for x in _ATTRIBUTE.findall(raw)] if form == "tag" else []
    return (
        _FORM_INDEX[form],
        _OPENERS.get(first, 20),
        min(run, 4),
        int(name in _TAGS),
        min(len(given), 3),
        min(sum(x in _ATTRIBUTES for x in given), 2),
        int("\\" in raw and bool(re.search(r"\\[A-Za-z]", raw))),
        int(after[:1].isdigit()),
        int(body[run : run + 1].isspace()),
        int(alone),
        int(unfinished),
        min(len(inner.split()), 4),
        min(4, 5 * digits // (len(inner) + 1)),
        min(4, 8 * len(_MARKS.findall(raw)) // (len(raw) + 1)),
        int(before.isalnum()),
        int(path),
        int(entity),
        int(bool(re.search(r"[\^_=]|\\", inner))) if form == "formula" else 0,
        int("\n" in raw.strip()),
        int("<" in text[max(0, start - 100) : start]),
        int(alone and above[-1:].isdigit()),
    )


def _elements(text: str, siblings: Sequence[Node]) -> tuple[list[int], list[int]]:
    """For each sibling: 0 for no tag, 1 for one without its other half, 2 for an empty element, 3 for a paired one; and the number of elements around it."""
    state, steps = [0] * len(siblings), [0] * (len(siblings) + 1)
    if not any(n.form == "tag" for n in siblings):
        return state, steps[:-1]
    open_tags: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()
    for i, node in enumerate(siblings):
        if node.form != "tag" or not (m := _NAME.match(text, node.start)):
            continue
        state[i] = 1
        name = m[2].lower()
        if name in _VOID or text[node.end - 2] == "/":
            state[i] = 2
        elif not m[1]:
            open_tags.append((name, i))
            waiting[name] += 1
        elif waiting[name]:
            while True:
                other, j = open_tags.pop()
                waiting[other] -= 1
                if other == name:
                    break
            state[i] = state[j] = 3
            steps[j + 1] += 1
            steps[i] -= 1
    return state, list(accumulate(steps[:-1]))


def _near(text: str, a: Node, b: Node) -> bool:
    """Whether two siblings of one form follow each other as the items of a list or the rows of a table do."""
    return not (gap := text[a.end : b.start]).strip() or not _BLANK_LINE.search(gap)


def _complete(text: str, siblings: list[Node], depth: int, above: str) -> None:
    """The features of siblings whose subtrees are complete."""
    same = Counter(n.form for n in siblings)
    state, around = _elements(text, siblings)
    last: dict[str, Node] = {}
    near = [0] * len(siblings)
    at: dict[str, int] = {}
    for i, node in enumerate(siblings):
        if node.form in last and _near(text, last[node.form], node):
            near[i] += 1
            near[at[node.form]] += 1
        last[node.form], at[node.form] = node, i
    for i, node in enumerate(siblings):
        for child in node.children:
            node.size += 1 + child.size
            node.tags += child.tags + (child.form == "tag")
            node.commands += child.commands + (child.form in ("command", "formula", "display"))
        subtree = (min(node.size, 3), min(node.tags, 2), min(node.commands, 2), min(4, 40 * node.size // (node.end - node.start)))
        node.features = (*_own_features(text, node), *subtree, min(depth, 3), min(around[i], 3), _FORM_INDEX.get(above, len(_FORMS)), min(same[node.form], 3), near[i], state[i])


def parse(text: str) -> list[Node]:
    """The forest of a value's nodes; the inside of a container is read again, and features are made from the leaves up."""
    roots: list[Node] = []
    todo = [(roots, 0, len(text), 0, "")]
    read: list[tuple[list[Node], int, str]] = []
    while todo:
        siblings, low, high, depth, above = todo.pop()
        read.append((siblings, depth, above))
        at = low
        while m := _SCAN.search(text, at, high):
            form, start, end = m.lastgroup, m.start(), m.end()
            if start == end:
                at = end + 1
                continue
            node = Node(form, start, end)
            siblings.append(node)
            if form in _CONTAINERS and end - start > 2:
                inside = start + 1
                while inside < end and text[inside] == text[start]:
                    inside += 1
                todo.append((node.children, inside, end, depth + 1, form))
            at = end
    for siblings, depth, above in reversed(read):
        if siblings:
            _complete(text, siblings, depth, above)
    return roots


def decode(roots: Sequence[Node], scores: dict[tuple[int, ...], np.ndarray]) -> dict[int, int]:
    """The class of every node (by its identity): the labelling of each tree with the best sum of scores among those without contradictions."""
    order, stack = [], list(roots)
    while stack:
        order.append(node := stack.pop())
        stack.extend(node.children)
    best: dict[int, tuple[tuple[int, float], ...]] = {}
    for node in reversed(order):  # children before their parents
        # The sum of the best choices below, for each state this node may leave its children in.
        below = [sum(best[id(c)][s][1] for c in node.children) for s in range(3)] if node.children else (0.0, 0.0, 0.0)
        own = scores[node.features].tolist()
        best[id(node)] = tuple(max(((k, own[k] + below[_after(node.form, k, s)]) for k in _ALLOWED[s]), key=lambda x: x[1]) for s in range(3))
    labels: dict[int, int] = {}
    todo = [(node, 0) for node in roots]
    while todo:
        node, s = todo.pop()
        label = labels[id(node)] = best[id(node)][s][0]
        inside = _after(node.form, label, s)
        todo += [(child, inside) for child in node.children]
    return labels


# The states that ancestors leave a node in, and the classes it may have there: free, in code, in a formula.
_ALLOWED = ((0, 1, 2, 3, 4), (0,), (0, 4))
_IN_CODE, _IN_FORMULA = 1, 2


def _after(form: str, label: int, state: int) -> int:
    """The state that a node of this form and class leaves its children in."""
    if label and form in ("fence", "code"):
        return _IN_CODE
    if label and form in ("display", "formula", "command"):
        return max(state, _IN_FORMULA)
    return state


_SYLLABLES = ("ba ce di fo gu la me ni po ru sa te vi zo an er il on ur es".split(), "ба ве ги до ку ла ме ни по ру са те ви зо ан ер ил он ур ес".split())
_HAN_WORDS = "桥船井田塔纸书灯盐石"


def _words(rng: random.Random, k: int) -> str:
    """*k* invented words: Latin, at times Cyrillic or Han."""
    kind = rng.random()
    if kind < 0.1:
        return "".join(rng.choice(_HAN_WORDS) for _ in range(2 * k))
    syllables = _SYLLABLES[kind < 0.2]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))


def _generated(rng: random.Random) -> Iterator[tuple[str, int, str]]:
    """(text, class, form) of a training text, the node marked by \\x00 on both sides."""
    w = lambda k=1: _words(rng, k)
    n = lambda a=1, b=99: str(rng.randint(a, b))
    stop = lambda: rng.choice(("。", ".", ".", ""))
    line = lambda: rng.choice((f"{n(1600, 1999)}{rng.choice(('年，', ' '))}{w(3)}.", f"{w(5)}{stop()}", f"{n()}. {w()}, {n()}.", f"{w().title()} {w(3)}, {w(4)}."))
    tag = rng.choice(sorted(_TAGS - _VOID))
    attribute = lambda: " ".join(f'{rng.choice(sorted(_ATTRIBUTES))}="{w()}"' for _ in range(rng.randint(1, 2)))
    formula = rng.choice((r"\frac{x_{%s}}{y^{%s}}" % (n(), n()), r"\int_0^{%s} f(t)\,dt" % n(), r"E = \alpha \cdot r^{-%s}" % n(), r"\sum_{i=1}^{%s} z_i \leq %s" % (n(), n()), r"a^2 + b_1 = c"))
    env = rng.choice(("aligned", "equation", "align*", "matrix", "cases"))
    cls = {c: i for i, c in enumerate(CLASSES)}
    H, M, K, L, N = (cls[c] for c in ("html", "markdown", "wiki", "latex", "none"))
    yield f"\x00<{tag}>\x00{w(3)}</{tag}>", H, "tag"
    yield f"<{tag}>{w(3)}\x00</{tag}>\x00", H, "tag"
    yield f"{w(2)} \x00</{tag}>\x00 {w()}", H, "tag"
    yield f"{w()}\x00<{tag} {attribute()}>\x00{w(2)}", H, "tag"
    yield f"<div {attribute()}>{w(3)} \x00<{tag} {attribute()}>\x00{w()}</{tag}></div>", H, "tag"
    yield f"<table><tr><td>{w()}</td>\x00<td>\x00{n()}</td></tr></table>", H, "tag"
    yield f"\x00<{rng.choice(('br', 'hr', 'img src=a'))}/>\x00{w(2)}", H, "tag"
    yield f"{w()}\x00&{rng.choice(('nbsp', 'amp', 'mdash', 'lt', 'gt', 'quot', 'eacute', '#160', '#x2014'))};\x00{w()}", H, "entity"
    yield f"<p>{w()} \x00&{rng.choice(('amp', 'nbsp', 'lt', 'quot', '#8211'))};\x00 <b>{w()}</b></p>", H, "entity"
    yield f"<td>{w()} \x00${formula}$\x00</td><td>{n()}</td>", L, "formula"
    yield f"<b>{w()}</b> \x00**{w()}**\x00 : {w()}", M, "strong"
    yield f"<b>{w()}</b> \x00'''{w()}'''\x00 {w()}", K, "quotes"
    yield f"<b>{w()}</b>\n\x00## {w(3)}\x00\n", M, "heading"
    yield f"<p>{w(3)}</p>\n\n\x00{'#' * rng.randint(1, 6)} {w(3)}\x00\n", M, "heading"
    # A list has items; a line by itself that begins with a star is a footnote.
    bullet = rng.choice("*-+")
    items = [f"{bullet} {line()}" for _ in range(rng.randint(1, 4))]
    gap = rng.choice(("\n", "\n", "\n\n"))
    yield f"{w(3)}{rng.choice('.:')}\n\x00{bullet} {line()}\x00{gap}{gap.join(items)}", M, "bullet"
    yield f"{gap.join(items)}{gap}\x00{bullet} {line()}\x00\n\n{w(4)}.", M, "bullet"
    yield f"\x00{bullet} {w(3)}\x00\n{bullet} {w(2)}", M, "bullet"
    for mark in "**-":
        yield f"{w(4)}{stop()}{rng.choice((chr(10), chr(10) * 2))}\x00{mark} {line()}\x00", N, "bullet"
        yield f"\x00{mark} {line()}\x00\n\n{w(5)}.", N, "bullet"
        yield f"{w(5)}.\n\n\x00{mark} {line()}\x00\n\n{w(5)}.", N, "bullet"
    yield f"{w(4)}.\n\n\x00{bullet} {w(2)} **{w()}** {rng.choice((w(), ''))}\x00", M, "bullet"
    yield f"\x00{bullet} *{w()}* {w(3)}\x00\n\n{w(4)}.", M, "bullet"
    yield f"{w(4)}.\n\n\x00* {w(2)} <{tag}>{w()}</{tag}> {rng.choice(('&amp; ', '', w()))}{w(2)}\x00", N, "bullet"
    yield f"\x00* {w(4)} &amp; {w(2)}\x00\n\n{w(3)}.", N, "bullet"
    yield f"<p>\x00* {line()}\x00\n\n{w(4)}</p>", N, "bullet"
    yield f"<b>{w()}</b>.\n\n\x00* {line()}\x00", N, "bullet"
    yield f"{w(3)} wrote {n()}\n\x00* {n()} * {n()} {w(3)}.\x00", N, "bullet"
    yield f"{w(3)} wrote {n()} * {n()}\n\x00* {n()} {w(3)}.\x00", N, "bullet"
    yield f"{w(3)}.\n\x00- {n()} -\x00\n{w(2)}", N, "bullet"
    yield f"{w()}{rng.choice('。.')}\n\x00> {line()}\x00", M, "quote"
    yield f"{w(4)}{stop()}\n\n\x00> {line()}\x00", M, "quote"
    yield f"{w(3).title()}\n\x00> {w(5).capitalize()}{rng.choice((' < ' + n(), ' ' + n(), ''))} {w(3)}.\x00\n{w(4)}.", M, "quote"
    yield f"{'#' * rng.randint(1, 4)} {w(3)}\n\x00> {line()}\x00", M, "quote"
    yield f"x={n()} {w()} ### {w()}={n()} {w()}\n\x00> {w(5).capitalize()}.\x00", M, "quote"
    yield f"\x00> {line()}\x00", M, "quote"
    yield f"{w(2)} < {n()} and {w()}\n\x00> {n()}, {w(rng.randint(1, 5))}\x00", N, "quote"
    yield f"{w(2)} < {n()} {w()}\n\x00> {n()} {w(rng.randint(1, 5))}\x00", N, "quote"
    yield f"{w(2)} < {n()} \x00\\textbf{{{w()}}}\x00 {w()}", L, "command"
    yield f"{w(3)} \x00&{rng.choice(('c', 'co', 'cetera', 'x'))};\x00 {w()}", N, "entity"
    yield f"\x00{'#' * rng.randint(1, 6)} {w(3)}\x00\n\n{w(4)}.", M, "heading"
    yield f"{w(4)}.\n\n\x00{'#' * rng.randint(1, 6)} {rng.choice((w(2), n(1600, 1999)))}\x00\n{w(4)}.", M, "heading"
    yield f"{w(3)} no.\n\x00#{n()}. {w(4)}\x00", N, "heading"
    yield f"{w(3)} no. \x00#\x00{n()}. {w(2)}", N, "hash"
    yield f"x={n()}.{n()} y={n()}.{n()} \x00###\x00 x={n()}", N, "hash"
    yield f"{w(2)}. \x00**{w()}**\x00 : {w()}", M, "strong"
    yield f"{w(2)}. \x00*{w()}*\x00.", M, "emphasis"
    yield f"{w(2)} {n()} \x00* {n()} *\x00 {n()} {w()}", N, "emphasis"
    yield f"{w()} {n()} * {n()} * {n()} {w(4)}. {w(2)} {n()} \x00* {n()} *\x00 {n()} {w()}", N, "emphasis"
    yield f"{w()} \x00[{w()}]({rng.choice(('leaf', 'page', 'http://a.b/'))}{n()}.md)\x00.", M, "link"
    yield f"{w()} \x00[{rng.choice(('illegible', 'sic', 'неясно', n(), w()))}]\x00.", N, "bracket"
    yield f"{w(2)}.\n\n\x00```\n{w()}_{n()} = {n()}\n```\x00\n", M, "fence"
    yield f"{w(2)}.\n\n\x00```\n<{tag}>{w()}</{tag}> # {w()}\n* {w()} &amp; \\{w()}{{x}}\n```\x00\n", M, "fence"
    yield f"{w(2)} \x00`{w()}`\x00 {w()}", M, "code"
    yield f"{w(2)} \x00`<{tag}>`\x00 {w()}", M, "code"
    yield f"{w(2)}.\n\x00| {w()} | {w()} |\x00\n|---|---:|\n| {w()} | {n()} |", M, "tablerow"
    yield f"{w(2)}\n| {w()} |\n\x00|---|{rng.choice(('---', ':--', '---:'))}|\x00\n| {n()} |", M, "tablerow"
    yield f"\x00{'=' * (k := rng.randint(2, 4))} {w(3)} {'=' * k}\x00\n{w(4)}", K, "wikihead"
    yield f"{w(2)}. \x00'''{w()}'''\x00 : {w()}", K, "quotes"
    yield f"{w(2)} \x00''{w()}''\x00.", K, "quotes"
    yield f"{w(2)} \x00[[{rng.choice(('File:%s.png|thumb|%s' % (n(), w()), w(2) + '|' + w(), w()))}]]\x00", K, "wikilink"
    yield f"{w(2)} \x00{{{{{rng.choice(('note', 'cite', 'ref'))}|{w()}|{n()}}}}}\x00", K, "template"
    yield f"{w(2)}.\n\x00{{| class={w()}\n|-\n| {w()} || {n()}\n|}}\x00", K, "wikitable"
    yield f"{w(2)}.\n\x00{{| class={w()}\n|-\n| <b>{w()}</b> || ''{w()}''\n\x00", K, "wikitable"
    yield f"{w(2)} \x00${formula}$\x00.", L, "formula"
    yield f"{w(2)} \x00${n()} {w(2)} $\x00{n()} {w()}", N, "formula"
    yield f"{w(2)} \x00${n()}-$\x00{n()} {w()}", N, "formula"
    yield f"{w(2)}\n\x00$${rng.choice((' ', ''))}{formula}$$\x00", L, "display"
    yield f"\x00\\[{formula}\\]\x00", L, "display"
    yield f"{w()}\n\x00\\begin{{{env}}}\n{formula}\n\\end{{{env}}}\x00", L, "display"
    yield f"{w(2)}. \x00\\{rng.choice(('textbf', 'cite', 'section', 'emph', 'ref', 'footnote'))}{{{w()}}}\x00 {w()}", L, "command"
    yield f"\x00\\{rng.choice(('section', 'subsection*', 'chapter'))}{{{w(3)}}}\x00\n{w(4)}", L, "command"
    yield f"{w()} \x00\\{rng.choice(('frac', 'sqrt'))}{{{n()}}}{{{n()}}}\x00 {w()}", L, "command"
    path = rng.choice(("scans", "box", "data"))
    yield f"{w(2)} C:\x00\\{path}\x00\\leaf_{n()} {w()}", N, "command"
    yield f"{w(2)} D:\\{path}{n()}\x00\\leaf\x00_{n()}_b {w()}", N, "command"
    yield f"{w(2)} \x00< {n()} {w(3)} >\x00 {n()}, {w()}", N, "angle"
    yield f"{w(2)} \x00<{n()} {w(2)}>\x00 {w(2)}", N, "angle"
    word = rng.choice(("lacuna", "gap", "lost", "unclear", "torn"))
    yield f"{w(2)} \x00<{word} {w()}>\x00 {w()}", N, "tag"
    yield f"{w(2)} \x00<{word}>\x00 {w()}", N, "tag"


def _joined(rng: random.Random) -> Iterator[list[tuple[str, int, str]]]:
    """The training texts of one round, a third each by themselves, between plain paragraphs, and several in one value."""
    forms = list(_generated(rng))
    rng.shuffle(forms)
    while forms:
        yield [_wrapped(rng, *forms.pop()) for _ in range(min(len(forms), rng.choice((1, 1, 2, 3))))]


_INLINE = frozenset("tag entity angle bracket link quotes strong emphasis code formula command wikilink template".split())


def _wrapped(rng: random.Random, text: str, label: int, form: str) -> tuple[str, int, str]:
    """A text of inline markup as it is, or within lines, cells and elements of other markup."""
    if form not in _INLINE or "\n" in text or rng.random() < 0.6:
        return text, label, form
    for _ in range(rng.choice((1, 1, 2, 3))):
        text = rng.choice(("> {}", "* {}", "# {}", "| {} |", "{{|\n|-\n| {}\n", "<td>{}</td>", "<div>{}")).format(text)
    return text, label, form


def _labelled(rng: random.Random, group: list[tuple[str, int, str]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """The features and classes of the marked nodes of one value, and of the nodes inside code and formulas."""
    plain = lambda: f"{_words(rng, 6).capitalize()}."
    parts = [plain()] if rng.random() < 0.4 else []
    for text, _, _ in group:
        parts += [text, plain()]
    if rng.random() < 0.4:
        parts.pop()
    marked = "\n\n".join(parts)
    places = [i - k for k, i in enumerate(i for i, c in enumerate(marked) if c == "\x00")]
    wanted = [(places[2 * j], places[2 * j + 1] if 2 * j + 1 < len(places) else len(marked), label, form) for j, (_, label, form) in enumerate(group)]
    stack = parse(marked.replace("\x00", ""))
    while stack:
        node = stack.pop()
        stack += node.children
        for start, end, label, form in wanted:
            if node.form == form and abs(node.start - start) <= 1 and node.end >= end - 1:
                yield node.features, label
                below = list(node.children) if form in ("fence", "code", "display", "formula") and label else []
                while below:
                    inner = below.pop()
                    below += inner.children
                    yield inner.features, CLASSES.index("latex") if form in ("display", "formula") and inner.form == "command" else 0


def training_nodes(per_form: int = TRAINING, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the nodes of generated texts."""
    rng = random.Random(seed)
    rows = [row for _ in range(per_form) for group in _joined(rng) for row in _labelled(rng, group)]
    return np.array([x for x, _ in rows]), np.array([y for _, y in rows])


@cache
def model() -> Boosted:
    """The trained trees; trained once in a process, always alike."""
    return fit(*training_nodes(), len(CLASSES))


class Judge:
    """Labels of values, with the scores of node features kept; the distinct features are few."""

    def __init__(self, boosted: Boosted):
        self.boosted, self.scores = boosted, {}

    def __call__(self, text: str) -> tuple[list[Node], dict[int, int]]:
        if not _ANY.search(text):
            return [], {}
        roots = parse(text)
        new, stack = set(), list(roots)
        while stack:
            node = stack.pop()
            if node.features not in self.scores:
                new.add(node.features)
            stack.extend(node.children)
        if new:
            keys = sorted(new)
            self.scores.update(zip(keys, self.boosted.scores(np.array(keys)), strict=True))
        return roots, decode(roots, self.scores)

    def kinds(self, text: str) -> set[str]:
        return {CLASSES[k] for k in self(text)[1].values()} - {"none"}

    def clean(self, text: str) -> str:
        roots, labels = self(text)
        if not any(labels.values()):
            return text
        # Rendering goes down as far as the nodes are nested; calls within Python need no C stack.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(labels) + 1000))
        out, at = [], 0
        for node in roots:
            out += [text[at : node.start], self._render(text, node, labels)]
            at = node.end
        joined = "".join([*out, text[at:]])
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", joined)).strip()

    def _inside(self, text: str, node: Node, labels: dict[int, int], start: int, end: int) -> str:
        out, at = [], start
        for child in node.children:
            if child.start >= at and child.end <= end:
                out += [text[at : child.start], self._render(text, child, labels)]
                at = child.end
        return "".join([*out, text[at:end]])

    def _render(self, text: str, node: Node, labels: dict[int, int]) -> str:
        raw = text[node.start : node.end]
        kind = CLASSES[labels.get(id(node), 0)]
        if kind == "none":
            return self._inside(text, node, labels, node.start, node.end)
        form = node.form
        if form == "tag":
            return _render_tag(raw)
        if form == "entity":
            return html.unescape(raw).replace("\xa0", " ")
        if form == "fence":
            return "[code]\n" + re.sub(r"^[ \t]*```[^\n]*\n|\n?[ \t]*```\s*$", "", raw) + "\n[/code]"
        if form == "code":
            return raw.strip("`")
        if form in ("display", "formula"):
            return "[formula] " + re.sub(r"^(?:\$\$?|\\\[)\s*|\s*(?:\$\$?|\\\])$", "", raw).strip() + " [/formula]"
        if form == "command":
            name, args = re.match(r"\\([A-Za-z]+)", raw)[1], re.findall(r"\{([^{}\n]*)\}", raw)
            if name in ("section", "subsection", "subsubsection", "chapter", "title", "part", "paragraph"):
                return "[heading] " + " ".join(args)
            return {"cite": "", "ref": "", "label": "", "textbf": " ".join(args)}.get(name, " ".join(args) or raw)
        if form == "template":
            return " ".join(raw.strip("{}").split("|")[1:2])
        if form == "wikilink":
            return raw.strip("[]").rpartition("|")[2]
        if form == "link":
            return re.match(r"!?\[([^\[\]]*)\]", raw)[1]
        if form == "wikitable":
            rows = [re.sub(r"\s*(?:\|\||!!)\s*", "\t", r.strip()[1:].strip()) for r in raw.split("\n") if r.strip()[:1] in ("|", "!") and not r.strip().startswith(("|-", "|}"))]
            return "\n".join(rows)
        if form == "tablerow":
            cells = [c.strip() for c in raw.strip().strip("|").split("|")]
            return "" if all(re.fullmatch(r":?-+:?", c) for c in cells) else "\t".join(cells)
        if form in ("heading", "wikihead"):
            return "[heading] " + re.sub(r"^\s*[#=]+\s*|\s*[#=]+\s*$", "", self._inside(text, node, labels, node.start, node.end))
        if form == "bullet":
            return "• " + re.sub(r"^\s*[*+-]\s+", "", self._inside(text, node, labels, node.start, node.end))
        if form == "quote":
            return re.sub(r"^\s*>\s?", "", self._inside(text, node, labels, node.start, node.end))
        return re.sub(r"^(?:\*\*?|__?|'{2,5})|(?:\*\*?|__?|'{2,5})$", "", self._inside(text, node, labels, node.start, node.end))


def _render_tag(raw: str) -> str:
    m = re.match(r"<(/?)([A-Za-z][A-Za-z0-9]*)", raw)
    if not m:
        return ""
    closing, name = bool(m[1]), m[2].lower()
    if re.fullmatch(r"h[1-6]", name):
        return "\n" if closing else "\n[heading] "
    if name in ("td", "th"):
        return "\t" if closing else ""
    if name in ("tr", "br", "p", "div", "table", "blockquote"):
        return "\n" if closing or name == "br" else ""
    if name == "li":
        return "\n" if closing else "• "
    if name in ("pre", "code"):
        return "[/code]" if closing else "[code]"
    return ""


def _explode(df: DataFrame, tbl: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    return df.select(F.lit(tbl).alias("tbl"), F.col(id_col).cast("bigint").alias("row_id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields)])


def found(df: DataFrame, tbl: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(tbl, row_id, field, kind): the kinds of markup in each value."""
    boosted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(boosted)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            out = [(tbl, i, f, k) for c, f in enumerate(fields) for i, t in zip(ids, batch.column(2 + c).to_pylist(), strict=True) if t for k in sorted(judge.kinds(t))]
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c), pa.array(d)], names=["tbl", "row_id", "field", "kind"])

    return _explode(df, tbl, id_col, fields).mapInArrow(run, "tbl string, row_id bigint, field string, kind string")


def cleaned(df: DataFrame, tbl: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(tbl, row_id, field, clean): clean text; headings, list items, code and formulas are marked in words, table cells by tabs."""
    boosted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(boosted)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            out = [(tbl, i, f, judge.clean(t)) for c, f in enumerate(fields) for i, t in zip(ids, batch.column(2 + c).to_pylist(), strict=True) if t is not None]
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c), pa.array(d)], names=["tbl", "row_id", "field", "clean"])

    return _explode(df, tbl, id_col, fields).mapInArrow(run, "tbl string, row_id bigint, field string, clean string")
