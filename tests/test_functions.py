from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageflow.functions import geometry as G
from pageflow.functions import htmltext, inline, latex, normalize
from pageflow.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("text", "want"), [("**b** _i_ `c` [l](u) ~~s~~", "b i c l s"), ("<b>x</b><span>y</span>", "xy"), ("a $x^2$ b", "a x^2 b"), ("from $5  to $6", "from $5  to $6"), (None, None), ("", "")])
def test_strip_markdown(text, want):
    assert inline.strip_markdown(text) == want


@pytest.mark.parametrize(("text", "want"), [("12", True), ("[3]", True), ("xiv", True), ("12345", False), ("a", False), (None, False)])
def test_page_number(spark, text, want):
    assert one(spark, X.is_page_number_like(F.col("t")), t=text) is want


def test_dot_leaders(spark):
    assert one(spark, X.shorten_dot_leaders(F.col("t")), t="A" + "." * 40 + "1").count(".") == 24
    assert one(spark, X.has_dot_explosion(F.col("t")), t=". " * 300)
    assert not one(spark, X.has_dot_explosion(F.col("t")), t="." * 299)


def test_overlap_key_and_ngrams(spark):
    assert one(spark, normalize.arrow_function("overlap_text")(F.col("t")), t="A b-1 é!") == "ab1é"
    assert one(spark, F.size(X.ngrams(F.col("t"), 4)), t="aaaaaa") == 1
    assert one(spark, F.size(X.ngrams(F.col("t"), 4)), t="abc") == 0


@pytest.mark.parametrize(("seconds", "want"), [(5.0, "5s"), (125.4, "2m05s"), (3723.0, "1h02m03s"), (-1.0, "0s")])
def test_format_seconds(spark, seconds, want):
    assert one(spark, X.format_seconds(F.col("s")), s=seconds) == want


def test_line_classes(spark):
    lines = {"# a": "heading1", "### a": "heading3", "> q": "quote", "- x": "list", "| a | b |": "table", "---": "rule", "```py": "code", "": "blank", "text": "normal"}
    assert {k: one(spark, X.line_class(F.col("t")), t=k) for k in lines} == lines


def test_boxes(spark):
    assert one(spark, G.normalized_bbox(F.col("b")), b=[1.0, 2.0, 3.0, 4.0]) == [1, 2, 3, 4]
    assert one(spark, G.normalized_bbox(F.col("b")), b=[3.0, 2.0, 1.0, 4.0]) is None
    assert one(spark, G.normalized_bbox(F.col("b")), b=[0.0, 1.0, 5.0, 0.0, 4.0, 7.0, 1.0, 6.0]) == [0, 0, 5, 7]
    assert one(spark, G.overlap_ratio(F.col("a"), F.col("b")), a=[0.0, 0.0, 10.0, 10.0], b=[5.0, 0.0, 20.0, 10.0]) == 0.5
    page = G.to_page(F.col("b"), F.lit("image"), F.lit(1392.0), F.lit(2040.0), F.lit(3867), F.lit(5667))
    x0, y0, x1, y1 = one(spark, page, b=[485.0, 2149.0, 555.0, 2220.0])
    assert (round(x0, 1), round(y0, 1), round(x1 - x0, 1), round(y1 - y0, 1)) == (174.6, 773.6, 25.2, 25.6)


@pytest.mark.parametrize(("formula", "want"), [("$F^{-1}$", "F⁻¹"), (r"\frac{1}{2}", "½"), (r"\frac{a+b}{c}", "(a+b)/c"), (r"\alpha \cdot x_{12}", "α · x₁₂"), (r"\text{if } x \leq \sqrt{y", "if x ≤ √y"), (r"\begin{aligned}a&=b\end{aligned}", "a =b"), ("", ""), (None, None)])
def test_latex(formula, want):
    assert latex.linearize(formula) == want


def test_latex_unicode_is_lossless():
    assert latex.simple_unicode("F^{-1}") == "F⁻¹"
    assert latex.simple_unicode("$$S_{F}^{-1}$$") is None
    assert latex.simple_unicode(r"\frac{1}{2}") is None


def test_latex_depth():
    assert latex.linearize("{" * 500 + "x" + "}" * 500) is not None


def test_normalize():
    assert normalize.nfkc_keeping("Ａ ½ x² ﬁ") == "A ½ x² fi"
    assert normalize.overlap_text("Ａ b-1") == "ab1"
    assert normalize.normalize_text("## **Head**\r\n<table><tr><td>a</td><td>b</td></tr></table>") == "Head\na b"
    assert normalize.normalize_text(None) == ""
    assert normalize.normalize_markup("⚲ 函数, A⚲B") == "Ψ 函数, A⚲B"


def test_collapse():
    assert normalize.collapse_repeated("one two three one two three one two three one two three") == "one two three"
    assert normalize.collapse_repeated("same line\nsame line\nsame line\nother") == "same line\nother"
    twice = "A sentence stands here. A sentence stands here. Another one follows it."
    assert normalize.collapse_sentences(twice) == twice
    assert normalize.collapse_sentences("A sentence stands here. " * 3 + "Another one follows it.").count("A sentence") == 1
    assert normalize.collapse_repeated("") == "" and normalize.collapse_repeated(None) is None


def test_append_with_overlap():
    shared = "a passage of more than forty characters that both hold"
    assert normalize.append_with_overlap("first " + shared, shared + " last") == f"first {shared} last"
    assert normalize.append_with_overlap("x", "y") == "x y"
    assert normalize.append_with_overlap("", "y") == "y"


def test_functions_in_sql(spark):
    normalize.register(spark)
    assert spark.sql("SELECT linearize_latex('x^{2}') AS r, normalize_text(NULL) AS n").first() == ("x²", "")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("***a*** ___b___ ==c== H~2~O x^2^", "a b c H2O x2"), ("*a **b** c*", "a b c"), ("a * b", "a * b"), ("**a\nb**", "**a\nb**"), ("![i](u) [**l**](u)", "i l"), ("note[^3] here", "note3 here"),
        ("```py\nx = 1\n```", "x = 1\n"), ("line<br>end", "line end"), ("<b>x</b> <i>y", "x <i>y"), ("\\(x+1\\) and $5 and", "x+1 and $5 and"), ("$$a_1$$", "a_1"), ("****", "****"), ("2 ** 3", "2 ** 3"), ("<table><b>t</b></table>", "<table>t</table>"),
    ],
)
def test_inline_scan(text, want):
    assert inline.strip_markdown(text) == want


def test_html_as_markdown():
    assert inline.html_as_markdown("<strong>a</strong> <em>b</em> <code>c</code> <u>d</u> <del>e</del> x<sup>2</sup> <span>f</span>") == "**a** *b* `c` ==d== ~~e~~ x2 f"
    assert inline.html_as_markdown("\\(x\\) \\[y\\] $$z$$") == "$x$ $y$ $z$"
    assert inline.strip_html("<b>a</b><br/><font size=1>b</font> **c**") == "a b **c**"
    assert inline.strip_html(None) is None and inline.strip_markdown("") == ""


@pytest.mark.parametrize(("text", "want"), [("x", True), ("a = b", True), ("F(x), g", True), ("two  spaces", False), ("", False), ("é", False), ("y" * 221, False), (None, False)])
def test_is_likely_math(text, want):
    assert inline.is_likely_math(text) is want


def test_html_text():
    assert htmltext.html_to_text("<p>a &amp; b</p><p>c<br>d</p>") == "a & b\nc\nd"
    assert htmltext.tables_to_text("x <table><tr><td>a</td><td></td><td>b  c</td></tr><tr><th>d</th></tr></table> y") == "x a    b c\nd y"
    assert htmltext.tables_to_text("<td>a</td> <td>b</td>") == "a | b"
    assert htmltext.tables_to_text("no <b>table</b>") == "no <b>table</b>" and htmltext.tables_to_text(None) is None


def test_repeats_are_compared_without_markup():
    assert normalize.repeat_key("  **The &amp; End**. ") == normalize.repeat_key("the & end") == "the & end"
    assert normalize.collapse_lines("**Same**\nsame\nSAME.\nother") == "**Same**\nother"
    assert normalize.collapse_lines("a\n\n\n\nb") == "a\n\n\n\nb"
    assert normalize.collapse_repeated("x=1 y=2 x=1 y=2 x=1 y=2 x=1 y=2\nkept as it is") == "x=1 y=2\nkept as it is"
    page = "One line of prose that stays.\nAnother line of prose follows here.\nThe third one differs again."
    assert normalize.collapse_repeated(page) == page
    long = " ".join(["w" * 150, "v" * 150])
    assert normalize.collapse_tokens(" ".join([long] * 3)) == " ".join([long] * 3)  # a group longer than a unit stays


def test_nearly_equal_edges_are_taken_once():
    shared = "a passage that was recognised twice with one small difference at its end"
    got = normalize.append_with_overlap("First words. " + shared + "ing", "x " + shared + " and more")
    assert got.count("a passage") == 1 and got.endswith("and more")
    assert normalize.texts_overlap("abc", "xx abc yy") and not normalize.texts_overlap("abc", "") and not normalize.texts_overlap("first text", "second text")


def test_citations(spark):
    for text, want in (("x^{[3]}", "x[3]"), ("x^([4, 5])", "x[4, 5]"), ("\\textsuperscript{ [6] }", "[6]"), ("2^{lei}", "2lei"), ("a_{n}", "an"), ("a^b", "a^b")):
        assert one(spark, X.unwrap_citations(F.col("t")), t=text) == want
