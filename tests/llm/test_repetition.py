from __future__ import annotations

import random

import pytest

from pageflow.llm import repetition


def brute(words, run):
    marked = set()
    for i in range(len(words) - run + 1):
        if any(words[j : j + run] == words[i : i + run] for j in range(i)):
            marked |= set(range(i, i + run))
    return len(marked)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_words_like_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
    for run in (2, 6, 12):
        assert repetition.repeated_words(words, run) == brute(words, run)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "clash") for r in rows], "page_result_id bigint, origin string, text string, md_nohf_text string, d2 double, lang string")


def unique(rng, n):
    return " ".join("the of and " + "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def test_nothing_escapes_whatever_the_group(spark):
    """In a group where nearly every value repeats, its own estimate calls repetition usual; that of all values doesn't."""
    rng = random.Random(5)
    phrase = "one two three four five six seven. "
    rows = [(i, "a", phrase * 9, None) for i in range(40)] + [(100 + i, "b", unique(rng, 20), unique(rng, 10)) for i in range(40)]
    rows += [(300, "b", phrase * 5, phrase), (301, None, "One, two - three. FOUR five SIX seven " + phrase * 2, ""), (302, "b", None, None), (303, "b", "...", None)]
    got = {tuple(r) for r in repetition.repetitive(pages(spark, rows), "page_result_id", "origin", ["text", "md_nohf_text"]).collect()}
    assert got == {(i, "text") for i in range(40)} | {(300, "text"), (301, "text")}
    flagged = {r.id for r in repetition.outliers(pages(spark, rows), "page_result_id", "origin", ["text"]).filter("rejected").collect()}
    assert 300 in flagged and not flagged & set(range(100, 140))


def test_chinese_runs_are_longer():
    part = "甲乙丙丁戊己庚辛壬癸"
    assert repetition.value_statistics(part * 2)[2] == 0 or len(part) >= repetition.HAN_RUN
    lang, n, repeated, *_ = repetition.value_statistics((part + "子丑寅") * 2)
    assert (lang, n, repeated) == ("zh", 26, 13)
    assert repetition.value_statistics("") is None and repetition.value_statistics("... !") is None


def test_empty_table(spark):
    assert repetition.repetitive(pages(spark, []), "page_result_id", "origin", ["text", "md_nohf_text"]).count() == 0


def test_the_estimate_decides(spark):
    """Values with the share are found by their distance: against an estimate that calls them usual, none is."""
    phrase = "one two three four five six seven. "
    usual = [(i, "a", phrase * 9, None) for i in range(60)]
    assert repetition.repetitive(pages(spark, usual), "page_result_id", "origin", ["text"]).count() == 0
    rng = random.Random(6)
    plain = [(100 + i, "a", unique(rng, 20), None) for i in range(200)]
    df = pages(spark, usual + plain)
    assert repetition.repetitive(df, "page_result_id", "origin", ["text"]).count() == 60
    r = repetition.recall(df, "page_result_id", "origin", ["text"]).groupBy().sum().first()
    assert (r["sum(n_values)"], r["sum(n_repetitive)"], r["sum(n_both)"]) == (260, 60, 60) and r["sum(n_rejected)"] < 90


def test_determinant_is_the_least_of_the_starts(spark):
    """Half of a group is compact; the estimate is of that half, wherever the quartiles lie."""
    rng = random.Random(1)
    rows = [(float(rng.gauss(0.1, 0.02)), float(rng.gauss(2, 0.1)), float(rng.gauss(5, 0.1))) for _ in range(130)]
    rows += [(float(rng.uniform(0.5, 1.5)), float(rng.uniform(-3, 1)), float(rng.uniform(1, 9))) for _ in range(100)]
    stats = spark.createDataFrame([("en", "s", *r) for r in rows], "lang string, source_key string, x1 double, x2 double, x3 double")
    m = repetition.mcd(stats).filter("lang = 'en'").first()
    assert abs(m.m_x1 - 0.1) < 0.02 and abs(m.m_x2 - 2) < 0.1 and abs(m.m_x3 - 5) < 0.1


def test_many_groups_are_joined_by_salted_keys(spark, monkeypatch):
    rng = random.Random(9)
    phrase = "one two three four five six seven. "
    rows = [(i, "ab"[i % 2], phrase * 6 if i % 10 == 0 else unique(rng, 12), None) for i in range(150)]
    few = sorted((r.id, round(r.distance, 6)) for r in repetition.outliers(pages(spark, rows), "page_result_id", "origin", ["text"]).collect())
    monkeypatch.setattr(repetition, "FEW", 0)
    many = sorted((r.id, round(r.distance, 6)) for r in repetition.outliers(pages(spark, rows), "page_result_id", "origin", ["text"]).collect())
    assert few == many and len(few) == 150
