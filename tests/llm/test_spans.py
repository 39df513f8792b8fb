from __future__ import annotations

import random

import pytest

from pageflow.llm import spans

SCHEMA = "page_result_id bigint, text string, source_text string, h int, c1 string, rep int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)


def words(rng, n):
    return "".join(rng.choice("abcdefghij ") for _ in range(n))


def brute(rows, n):
    grams = {i: {t[k : k + n] for t in fields if t for k in range(len(t) - n + 1)} for i, *fields in rows}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_and_shares_like_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 40
    pool = [words(rng, rng.randint(30, 60)) for _ in range(6)]
    rows = []
    for i in range(40):
        text = [words(rng, rng.randint(0, 50)) + rng.choice([*pool, ""]) + words(rng, rng.randint(0, 50)) if rng.random() < 0.9 else None for _ in range(2)]
        rows.append((i, *text))
    rows += [(100, *rows[3][1:]), (101, *rows[3][1:]), (102, rows[5][2], rows[5][1]), (103, None, None), (104, "", "x")]
    shared = spans.SharedSpans(frame(spark, rows), "page_result_id", ["text", "source_text"], min_len=n)
    assert {tuple(r) for r in shared.pairs().collect()} == brute(rows, n)
    assert shared.pairs().count() == len(brute(rows, n))
    got = {(r.id, r.field): r.n_shared for r in shared.shared_by_record().collect()}
    for i, *fields in rows:
        others = {t[k : k + n] for j, *ts in rows if j != i for t in ts if t for k in range(len(t) - n + 1)}
        for f, t in enumerate(fields):
            if t and len(t) >= n:
                covered = {p for k in range(len(t) - n + 1) if t[k : k + n] in others for p in range(k, k + n)}
                assert got[i, f] == len(covered), (i, f)


def test_exact_bound(spark):
    rng = random.Random(1)
    s = words(rng, 200)
    rows = [(1, "A" + s[:199] + "B", None), (2, "C" + s[:199] + "D", None), (3, "E" + s + "F", None), (4, None, "G" + s)]
    assert {tuple(r) for r in spans.SharedSpans(frame(spark, rows), "page_result_id", ["text", "source_text"]).pairs().collect()} == {(3, 4)}


def test_a_record_shares_nothing_with_itself(spark):
    s = words(random.Random(2), 300)
    rows = [(1, s + s, s), (2, "short", None)]
    assert spans.SharedSpans(frame(spark, rows), "page_result_id", ["text", "source_text"]).pairs().count() == 0


def test_periodic_text_is_finite(spark):
    rows = [(1, "a" * 5000, None), (2, "a" * 300 + "b", None)]
    shared = spans.SharedSpans(frame(spark, rows), "page_result_id", ["text", "source_text"])
    assert {tuple(r) for r in shared.pairs().collect()} == {(1, 2)}
    assert {r.id: r.n_shared for r in shared.shared_by_record().collect()} == {1: 5000, 2: 300}


def maximal(s, t, n):
    out = []
    for i in range(len(s)):
        for j in range(len(t)):
            if s[i] == t[j] and not (i and j and s[i - 1] == t[j - 1]):
                k = 0
                while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                    k += 1
                if k >= n:
                    out.append((0, i, 0, j, k))
    return sorted(out)


@pytest.mark.parametrize(("s", "t"), [("ab" * 100, "x" + "ab" * 80 + "y"), ("a" * 150, "a" * 120 + "b" + "a" * 90), ("abc" * 40 + "z" * 50, "z" * 45 + "abc" * 30), (words(random.Random(4), 60) * 3, words(random.Random(4), 60) * 2)])
def test_all_maximal_repeats_of_periodic_texts(s, t):
    """More pairs of places than any bound: every maximal repeat is given with both its places."""
    n = 20
    h, places = spans.anchors(s, n // 2, n - n // 2 + 1)
    shared = [int(p) for x, p in zip(h, places, strict=True) if x in set(spans.anchors(t, n // 2, n - n // 2 + 1)[0])]
    assert spans.common_spans([s], [t], shared, n // 2, n) == maximal(s, t, n)


def test_many_copies_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spans, "COPIES", 7)
    s = words(random.Random(9), 250)
    rows = [(i, s, None) for i in range(40)] + [(100 + i, "x" + s, "y") for i in range(30)] + [(200, "short", None)]
    got = [tuple(r) for r in spans.SharedSpans(frame(spark, rows), "page_result_id", ["text", "source_text"]).pairs().collect()]
    assert len(got) == 70 * 69 // 2 == len(set(got))


def test_empty_table(spark):
    assert spans.SharedSpans(frame(spark, []), "page_result_id", ["text", "source_text"]).pairs().count() == 0
