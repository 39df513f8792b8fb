from __future__ import annotations

import numpy as np
import pytest

from pageflow.llm import boosting, markup

CASES = [
    ("<p>a</p> &amp; b", {"html"}), ("x < 5 and y > 3 hold", set()), ("here <10 words lost> and [illegible].", set()), ("from $4 to $60, no. #30", set()), ("he wrote 5 * 32 * 2 in it", set()),
    ("he wrote 5 * 32\n* 2 in it", set()), ("a < 4 and so\n> 5, it holds", set()), ("## A Heading\n\ntext", {"markdown"}), ("| a | b |\n|---|---|\n| c | 1 |", {"markdown"}), ("see [a](b.md).", {"markdown"}),
    ("text.\n* one thing\n* two things", {"markdown"}), ("text.\n- 12 -\nmore", set()), ("'''a''' : ''b''", {"wiki"}), ("[[File:a.png|thumb|b]] {{note|x|5}}", {"wiki"}), ("== Head ==\ntext", {"wiki"}), ("{| class=x\n|-\n| a || b\n|}", {"wiki"}),
    ("$x^2 + y_1$ is", {"latex"}), ("\\begin{aligned}a\\end{aligned}", {"latex"}), ("\\textbf{a} \\cite{b}", {"latex"}), ("C:\\scans\\box94\\leaf_26_b", set()), ("<table><tr><td>$\\frac{a}{b}$</td></tr></table>", {"html", "latex"}),
    ("```\na < b && *c* <p>\n```", {"markdown"}), ("x=215.03 y=268.1 ### x=1.0", set()), ("plain text", set()), ("> quoted words.", {"markdown"}), ("1. one\n2. two", set()),
]


@pytest.fixture(scope="module")
def judge():
    return markup.Judge(markup.model())


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds(judge, text, kinds):
    assert judge.kinds(text) == kinds


def test_held_out_accuracy():
    x, y = markup.training_nodes(8, seed=1234)
    assert (markup.model().scores(x).argmax(axis=1) == y).mean() > 0.98


def test_clean_keeps_structure(judge):
    html = "<h2>Head</h2><p>a &amp; <b>b</b></p><ul><li>one</li><li>two</li></ul><table><tr><td>x</td><td>1</td></tr></table>"
    assert judge.clean(html) == "[heading] Head\na & b\n• one\n• two\nx\t1"
    assert judge.clean("== Head ==\n'''a''' [[b|c]] {{note|d|5}}") == "[heading] Head\na c d"
    assert judge.clean("# Head\n\n* one **two**\n\n| a | b |\n|---|---|\n| c | 1 |\n\n```\nx = 1\n```") == "[heading] Head\n\n• one two\n\na\tb\n\nc\t1\n\n[code]\nx = 1\n[/code]"
    assert judge.clean("$$\n\\frac{a}{b}\n$$") == "[formula] \\frac{a}{b} [/formula]"
    for plain in (c for c, k in CASES if not k):
        assert judge.clean(plain) == plain


def test_decoding_allows_no_contradictions(judge):
    roots, labels = judge("$$ a < b_1 & <p> $$ and ```\n<p>*x*</p>\n```")
    stack = [(n, None) for n in roots]
    while stack:
        node, above = stack.pop()
        kind = markup.CLASSES[labels[id(node)]]
        if above is not None and above.form == "display":
            assert kind in ("none", "latex")
        stack += [(c, node) for c in node.children]


def test_odd_values(judge):
    for text in ("<" * 2000, "*" * 2000, "[" * 500 + "]" * 500, "'" * 1000, "{{" * 300, "\x00<b>", "#" * 3000, "$" * 999):
        judge.clean(text)


def test_found(spark):
    df = spark.createDataFrame([(1, "<b>a</b> $x^2$", None, 9), (2, None, "", 9), (1, "plain", "# H", 9)], "page_result_id bigint, text string, source_text string, field int")
    got = sorted(tuple(r) for r in markup.found(df, "page_results", "page_result_id", ["text", "source_text"]).collect())
    assert got == [("page_results", 1, "source_text", "markdown"), ("page_results", 1, "text", "html"), ("page_results", 1, "text", "latex")]
    assert markup.cleaned(df.filter("false"), "page_results", "page_result_id", ["text"]).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 5))
    y = x[:, 0] ^ x[:, 3]
    model = boosting.fit(x, y, 2, rounds=10)
    assert (model.scores(x).argmax(axis=1) == y).all()
    assert np.allclose(np.exp(model.scores(x)).sum(axis=1), 1)


def test_no_bound_of_depth_or_length(judge):
    deep = "{|\n" * 60 + "<b>a</b>"
    assert judge.kinds(deep) == {"wiki", "html"}
    judge.clean("{|\n" * 1500 + "<b>a</b>")
    assert judge.kinds("the sum $" + "x^2 + y_1 + " * 30 + "z$ holds") == {"latex"}
    assert judge.kinds("from $4 to " + "so many words and " * 20 + "$60 a year") == set()
    assert judge.kinds('the <a class="b"\n href="c">word</a\n> here') == {"html"}
    assert judge.kinds('<span class="b"\n id="c">') == {"html"}
    assert judge.kinds('see [a](b.md "A title").') == judge.kinds("see [a](my leaf.md).") == judge.kinds("see [a](b_(c).md).") == {"markdown"}
    assert judge.kinds("here [illegible] (see leaf 4).") == set()


def test_a_lone_star_is_a_footnote(judge):
    for text in ("The cellar was painted.\n\n* Under the printed laboratory the steward received 763 shillings.\n\nEach was illustrated.", "* 1703年，青溪的报纸曾被恢复。", "End.\n* Entre 1887 et 1842, environ 13 pages furent copiées."):
        assert judge.kinds(text) == set() and judge.clean(text) == text
    assert judge.kinds("Items:\n\n* Under the printed laboratory.\n* Each was illustrated.") == {"markdown"}
    assert judge.kinds("* a note with <b>mark</b> &amp; more") == {"html"}


def test_decoding_is_joint():
    """A descendant's score counts in the class of its ancestor, and inside code nothing is markup."""
    inner = markup.Node("tag", 1, 2, (1,))
    outer = markup.Node("code", 0, 3, (0,), [inner])
    weak = {(0,): np.array([-0.7, -9, -0.6, -9, -9.0]), (1,): np.array([-3.0, -0.1, -9, -9, -9])}
    assert markup.decode([outer], weak) == {id(outer): 0, id(inner): 1}
    strong = {(0,): np.array([-9.0, -9, -0.1, -9, -9]), (1,): weak[1,]}
    assert markup.decode([outer], strong) == {id(outer): 2, id(inner): 0}


def test_elements_pair():
    roots = markup.parse("<div><b>a</b><br/>b</div><i>")
    state, around = markup._elements("<div><b>a</b><br/>b</div><i>", roots)
    assert state == [3, 3, 3, 2, 3, 1] and around == [0, 1, 1, 1, 0, 0]
