from __future__ import annotations

import pytest

from pageflow.llm import truncation

STATES = [
    ("The survey was read in the council.", None, ""),
    ("The survey was read in the coun", None, "sentence"),
    ("A. The survey was read,", None, "sentence"),
    ("A line.\n\nOn the Former Granary", None, "heading"),
    ("A line.\n\nThe barren baro", None, "sentence"),
    ("A line.\n\nBescheidene messung", None, "heading"),
    ("A line.\n\nDie bescheidene Mes", None, "sentence"),
    ("一句话。\n肥沃的人口", None, "heading"),
    ("没有证据表明云岭的", None, "sentence"),
    ("Text.\n12 / 223", None, ""),
    ("Text.\nxxvii", None, ""),
    ("Text.\n— 4 —", None, ""),
    ("<table><tr><td>a</td></tr></table>", "table", ""),
    ("<table><tr><td>a</td><td>b", "table", "table"),
    ("{| class=x\n|-\n| a || b\n|} {{note|a|5}}", None, ""),
    ("{| class=x\n|-\n| a", None, "table"),
    ("| a | b |\n|---|---|\n| c | 5 |\n", None, ""),
    ("Text.\n```\na = 1\n```\n", None, ""),
    ("$$ \\frac{a}{b} $$", "display_formula", ""),
    ("\\begin{aligned}a", "display_formula", "table"),
    ("1. wool, 12.\n2. iron, 13.", None, ""),
    ("He said “go.”", None, ""),
    ("   ", None, ""),
    ("It was read.\u200b \ufeff", None, ""),
    ("Notes from Kelwick", "paragraph_title", "heading"),
]


@pytest.mark.parametrize(("text", "label", "state"), STATES)
def test_end_states(text, label, state):
    assert truncation.end_state(text, label)[0] == state


def values(spark, rows):
    return spark.createDataFrame(rows, "tbl string, row_id bigint, source string, label string, text string")


def test_trie_and_rates(spark):
    rows = [("b", i, "w1", "text", "The granary and the harbour were read in the council again.") for i in range(10)]
    rows += [("b", 20, "w1", "paragraph_title", "The Gran"), ("b", 21, "w1", "paragraph_title", "The Granary"), ("b", 22, "w2", "text", "The harbour were rea"), ("b", 23, "w2", "text", None), ("b", 24, "w2", "text", ""), ("b", 25, None, "text", "It was")]
    got = {r.row_id: r.cut for r in truncation.judged(values(spark, rows)).collect()}
    assert {k for k, v in got.items() if v} == {20, 22, 25} and 23 not in got and 24 not in got
    rates = {r.source: (r.n_values, r.n_cut) for r in truncation.rates(values(spark, rows)).collect()}
    assert rates == {"w1": (12, 1), "w2": (1, 1), None: (1, 1)}


def test_field_limit_decides_for_headings(spark):
    body = "The harbour was read in the council. "
    cut = [("b", i, "w1", "text", (body * 9)[: 100 - len(str(i))] + str(i)) for i in range(20)]
    head = [("b", 50, "w1", "text", ("Done it is so far. " * 9)[:85] + ".\n\n" + "The Harbour")]
    head = [(*head[0][:4], head[0][4][-100:].rjust(100, "x"))]
    got = {r.row_id: r.cut for r in truncation.judged(values(spark, cut + head)).collect()}
    assert got[50] and all(got[i] for i in range(20))


def test_evidence_of_every_open_value(spark):
    rows = [("b", i, "w1", "text", "The granary and the harbour were read in the council again.") for i in range(10)]
    rows += [("b", 20, "w1", "text", "It stood by the gran"), ("b", 21, "w1", "text", "It stood by the granary"), ("b", 22, "w1", "paragraph_title", "The Harbour")]
    got = {r.row_id: (r.state, r.rest_of_word, r.at_limit, r.score) for r in truncation.evidence(values(spark, rows)).filter("state <> ''").collect()}
    assert got == {20: ("sentence", True, False, 2.0), 21: ("sentence", False, False, 1.0), 22: ("heading", False, False, 0.0)}
    assert sum(r.n_cut for r in truncation.by_evidence(values(spark, rows)).collect()) == 2


def test_empty_table(spark):
    assert truncation.judged(values(spark, [])).count() == 0
