from __future__ import annotations

from pageflow.llm import lookalike

ROWS = [
    (1, "plain text", None, set(), "plain text"),
    (2, "ｔｈｅ １２ end", None, {"fullwidth"}, "the 12 end"),
    (3, "fu\u0308r cafe\u0301", None, {"combining"}, "für café"),
    (4, "the mean m\u0304 stays", None, set(), "the mean m\u0304 stays"),
    (5, "a\u200bb \ufeffc", None, {"zero_width"}, "ab c"),
    (6, "a\u00a0b\u2007c\u202fd", None, {"nbsp"}, "a b c d"),
    (7, "the m\u043est \u0455hip \u03bfn", None, {"lookalike"}, "the most ship on"),
    (8, "слoво и книга α β 铜器，（x）", None, {"lookalike"}, "слово и книга α β 铜器，（x）"),
    (9, "Ελλάδα Москва θ und °", None, set(), "Ελλάδα Москва θ und °"),
    (10, "o\u0323\u0302 o\u0302\u0323", None, {"combining"}, "ộ ộ"),
    (11, "", None, set(), ""),
    (12, "m\u043e\u200bst ｆu\u0308r", None, {"lookalike", "zero_width", "fullwidth", "combining"}, "most für"),
    (13, "\u0301x", None, set(), "\u0301x"),
    (14, "\U0001f600a\u00a0\U0001f600", None, {"nbsp"}, "\U0001f600a \U0001f600"),
    (15, "line one\nｔｗｏ\tthree  ", None, {"fullwidth"}, "line one\ntwo\tthree  "),
]


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], "clash", 3) for r in rows], "page_result_id bigint, text string, source_text string, token string, pos int")


def test_kinds_and_forms(spark):
    df = frame(spark, [*ROWS, *[(100 + r[0], None, r[1]) for r in ROWS]])
    got: dict = {}
    for r in lookalike.found(df, "page_result_id", ["text", "source_text"]).collect():
        got.setdefault((r.id, r.field), set()).add(r.kind)
    forms = {(r.id, r.field): r.normal for r in lookalike.normalized(df, "page_result_id", ["text", "source_text"]).collect()}
    for i, text, _, kinds, normal in ROWS:
        for key in ((i, "text"), (100 + i, "source_text")):
            assert got.get(key, set()) == kinds, (key, text)
            assert forms[key] == normal, (key, text)
    assert (1, "source_text") not in forms


def test_normal_form_is_stable(spark):
    df = frame(spark, [(r[0], r[4], None) for r in ROWS])
    assert lookalike.found(df, "page_result_id", ["text", "source_text"]).count() == 0


def test_long_and_empty(spark):
    long = "文" * 30_000 + "\u200b"
    df = frame(spark, [(1, long, None)])
    assert lookalike.normalized(df, "page_result_id", ["text"]).first().normal == "文" * 30_000
    assert lookalike.found(frame(spark, []), "page_result_id", ["text", "source_text"]).count() == 0
