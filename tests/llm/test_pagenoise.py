from __future__ import annotations

import random

from pageflow.llm import pagenoise
from pageflow.llm.pagenoise import PageNoise, broken_words, line_kinds, misread_as, skeleton

WORDS = "committee measured together which remaining orchard plateau survey harbour weather bridge council letter garden station market between granary".split()


def table(spark, extra):
    rng = random.Random(4)
    rows = [(i, 7, " ".join(["the", "of", "and"] + [rng.choice(WORDS) for _ in range(60)]) + ".", None, None, 0) for i in range(60)]
    rows += [(1000 + i, f, t, m, b, 0) for i, (f, t, m, b) in enumerate(extra)]
    pages = spark.createDataFrame(rows, "page_result_id bigint, file_id bigint, text string, md_nohf_text string, fallback_text string, title int")
    files = spark.createDataFrame([(7, "The Harbour Gazette"), (8, None)], "file_id bigint, title string")
    return PageNoise(pages, files, "page_result_id", ["text", "md_nohf_text", "fallback_text"])


CASES = [
    (7, "the council and the gar-\nden of the market", None, None),  # 1000 hyphen
    (7, "the sta¬\n12\nT H E  H A R B O U R   GAZETTE 14\ntion of the council", None, None),  # 1001 hyphen over other lines
    (7, "the pre- and post-war survey of the council", None, None),  # 1002 nothing
    (7, "the cornmittee of the vvhich togcther 0rchard.", None, None),  # 1003 misread
    (7, "the H2O A4 401B and the 1723\n1723\n3. council, 12.", None, None),  # 1004 nothing
    (7, None, "- 12 -\nthe survey of the garden", "p. 9\nthe harbour gazette\nthe market"),  # 1005
    (8, "THE HARBOUR GAZETTE 5\nthe survey of the council", None, None),  # 1006 another file
    (7, "", None, None),
    (None, "xxvii\nthe survey of the bridge", None, None),  # 1008
    (7, "# The Harbour Gazette\nthe survey of the bridge and the let- ter", None, None),  # 1009 a heading of its own
]
WANT = {
    (1000, "text", "hyphen"), (1001, "text", "hyphen"), (1001, "text", "header"), (1001, "text", "page_no"), (1003, "text", "misread"),
    (1005, "md_nohf_text", "page_no"), (1005, "fallback_text", "page_no"), (1005, "fallback_text", "header"), (1008, "text", "page_no"), (1009, "text", "hyphen"),
}


def test_found_and_repaired(spark):
    noise = table(spark, CASES)
    got = [tuple(r) for r in noise.found().collect()]
    assert set(got) == WANT and len(got) == len(WANT)
    texts = {(r.id, r.field): r.repaired for r in noise.repaired().collect()}
    assert texts[1000, "text"] == "the council and the garden of the market"
    assert texts[1001, "text"] == "the station of the council"
    assert texts[1002, "text"] == CASES[2][1]
    assert texts[1003, "text"] == "the committee of the which together orchard."
    assert texts[1005, "fallback_text"] == "the market"
    assert texts[0, "text"].startswith("the of and")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_result_id bigint, file_id bigint, text string, md_nohf_text string, fallback_text string")
    files = spark.createDataFrame([], "file_id bigint, title string")
    assert PageNoise(pages, files, "page_result_id", ["text", "md_nohf_text", "fallback_text"]).found().count() == 0


def test_skeletons_agree_with_the_rules():
    for word in ["committee", "worden", "хижина", "building", "winter", "default"]:
        for a, b in pagenoise._RULES:
            if a in word:
                form = word.replace(a, b, 1)
                assert misread_as(word, form) and skeleton(word) == skeleton(form), (word, form)
    assert not misread_as("house", "houses") and not misread_as("same", "same")


def test_names_are_left_alone(spark):
    pages = [(i, 7, "The council of Kelwick and the survey of the harbour in Kelwick.", None, None) for i in range(30)] + [(99, 7, "The council of Kclwick and the survey.", None, None)]
    df = spark.createDataFrame(pages, "page_result_id bigint, file_id bigint, text string, md_nohf_text string, fallback_text string")
    assert PageNoise(df, spark.createDataFrame([], "file_id bigint, title string"), "page_result_id", ["text", "md_nohf_text", "fallback_text"]).found().count() == 0


def test_lines():
    assert line_kinds(["1 2", "[12]", "1830", "3.", "46 / 257", "第13页", "iv", "IV", "mix", "12 men", ""], None) == ["", "page_no", "", "", "page_no", "page_no", "page_no", "", "", "", ""]
    assert broken_words(["well-", "known"], ["", ""]) == [(0, 1, "wellknown")]
    assert broken_words(["pre-", "and post"], ["", ""]) == []


def noise_of(spark, texts):
    rows = [(i, 7, t, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_result_id bigint, file_id bigint, text string, md_nohf_text string, fallback_text string")
    return PageNoise(df, spark.createDataFrame([], "file_id bigint, title string"), "page_result_id", ["text", "md_nohf_text", "fallback_text"])


def test_misreadings_in_both_directions(spark):
    pairs = [("lantern", "lantem"), ("private", "pnvate"), ("enclosed", "endosed"), ("which", "wliich"), ("committee", "cornmittee")]
    assert all(misread_as(word, form) for word, form in pairs)
    assert not misread_as("leads", "reads") and not misread_as("the", "file")
    texts = [f"The {w} {i} of the {w} and the {w} was seen." for w, _ in pairs for i in range(8)] + [f"The {f} of the survey was seen." for _, f in pairs]
    noise = noise_of(spark, texts)
    assert {(r.word, r.repair) for r in noise.forms.collect()} == {(f, w) for w, f in pairs}
    assert {tuple(r) for r in noise.found().collect()} == {(40 + i, "text", "misread") for i in range(len(pairs))}


def test_large_page_numbers():
    pages = ["cxiii", "cix", "cc", "cdxii", "dxc", "p. 1234", "S. 1018 / 1200", "Seite 1018 / 1200", "page 1830", "с. 1204", "1234 / 2000", "[1018]", "vi"]
    assert line_kinds(pages, None) == ["page_no"] * len(pages)
    others = ["c", "d", "m", "di", "dix", "mi", "mix", "cm", "civil", "mdcccxxx", "CXIII", "iiii", "cccc", "1830", "1830/1831", "s 1830", "с 1830"]
    assert line_kinds(others, None) == [""] * len(others)
    lines = ["the sta-", "cxiii", "tion"]
    assert broken_words(lines, line_kinds(lines, None)) == [(0, 2, "station")]


def test_copies_of_a_misread_text(spark):
    texts = [f"The lantern {i} of the council was seen and kept." for i in range(8)] + ["The lantem of the council was seen and kept."] * 12
    noise = noise_of(spark, texts)
    assert {(r.word, r.repair) for r in noise.forms.collect()} == {("lantem", "lantern")}
    assert {tuple(r) for r in noise.found().collect()} == {(8 + i, "text", "misread") for i in range(12)}


def test_the_bound_of_known_words_decides_nothing(spark, monkeypatch):
    texts = [f"The hafen {i} and the meister of the council, the hafenmeister and the upper river." for i in range(6)]
    texts += ["The hafen- meister of the council.", "The upper- river of the council.", "The upper- moor of the council.", "The hafen- meister and upper- river council."]
    want = {(6, "text", "hyphen"), (8, "text", "hyphen"), (9, "text", "hyphen")}
    for bound in (50_000, 7, 4, 1):
        monkeypatch.setattr(pagenoise, "KNOWN_WORDS", bound)
        assert {tuple(r) for r in noise_of(spark, texts).found().collect()} == want, bound


def test_many_lines_between_the_halves():
    lines = ["the sta-", *[""] * 9, "12", "", "tion of"]
    assert broken_words(lines, line_kinds(lines, None)) == [(0, 12, "station")]
    assert broken_words(["the sta-", "", "A caption.", "tion"], [""] * 4) == []
    lines = ["a-", ""] * 20_000
    assert len(broken_words(lines, [""] * len(lines))) == 19_999
