from __future__ import annotations

import itertools
import random

import pytest

from pageflow.llm import pii, semicrf
from pageflow.llm.semicrf import Segment

GIVEN = ["elvella", "tamond", "karika", "nivin"]
FAMILY = ["varnworth", "limgate", "garden", "marsh"]
COMMON = {"garden", "marsh", "fertile", "the", "from", "steamer", "bridge"}
CASES = [
    ("Write to 69 Orchard Rd., Kelwick or call +1 (212) 555-0149.", [("address", "69 Orchard Rd."), ("phone", "+1 (212) 555-0149")]),
    ("The key is kept by Elvella Varnworth; Mr Garden has left.", [("name", "Elvella Varnworth"), ("name", "Garden")]),
    ("Signed for by LIMGATE, KARIKA at Flat 2, 54 Alder Row, Nesby.", [("name", "LIMGATE, KARIKA"), ("address", "Flat 2, 54 Alder Row")]),
    ("Albert Limgate (666-12-3456) leased it.", [("name", "Albert Limgate"), ("id_number", "666-12-3456")]),
    ("Reader ticket: QQ 12 34 56 C; reply to <k.limgate (at) mill (dot) invalid>.", [("id_number", "QQ 12 34 56 C"), ("email", "k.limgate (at) mill (dot) invalid")]),
    ("Anschrift: Am Lindenplatz 12, D-00154 Kelfeld; Tel. 030/23125-539.", [("address", "Am Lindenplatz 12"), ("phone", "030/23125-539")]),
    ("Herr Limgate, Ausweis L0X548374.", [("name", "Limgate"), ("id_number", "L0X548374")]),
    ("Madame Marsh ; appeler le 01 99 00 51 38, 58 bis, quai des Tilleuls.", [("name", "Marsh"), ("phone", "01 99 00 51 38"), ("address", "58 bis, quai des Tilleuls")]),
    ("Паспорт 0000 905062; адрес: ул. Липовая, д. 5, кв. 7; телефон 8-000-555-17-88.", [("id_number", "0000 905062"), ("address", "ул. Липовая, д. 5, кв. 7"), ("phone", "8-000-555-17-88")]),
    ("身份证号990000196812169335，来信请寄白石镇柳荫路73号，电话010-55500109。", [("id_number", "990000196812169335"), ("address", "白石镇柳荫路73号"), ("phone", "010-55500109")]),
    ("The Garden & Sons mill closed. The Marsh Bridge and the steamer Tamond. The Fertile Garden of Kelwick.", []),
    ("ISBN 978-0-8375-8363-0; Accession no. 6363-2300-9335; box 6945-329; six bales @ 15 shillings; dated 1873-05-24.", []),
    ("It stands on Lantern Street, near Box 28, position 51.6311 by 0.2403.", []),
    ("", []),
]


@pytest.fixture(scope="module")
def finder():
    given, family = frozenset(GIVEN), frozenset(FAMILY)
    return pii.Finder(set(given), set(family), COMMON, pii.trained(given, family))


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(finder, text, want):
    got = [(s.kind, text[s.start : s.end]) for s in finder(text)]
    assert [k for k, _ in got] == [k for k, _ in want], got
    assert all(g.startswith(w) for (_, g), (_, w) in zip(got, want, strict=True)), got


@pytest.mark.parametrize("name", ["Elvella Karika Varnworth", "Elvella Bramlin Varnworth", "Osten Elvella Varnworth", "Varnworth, Elvella", "K. Limgate", "Nivin B. Limgate"])
def test_names_of_several_parts(finder, name):
    for text in (f"The key is kept by {name}; it was read.", f"Questions go to {name} in April."):
        assert [text[s.start : s.end] for s in finder(text)] == [name]


def test_local_parts_of_any_length(finder):
    for local in ("a" * 200, "k.limgate-" * 20 + "x"):
        text = f"Reply to <{local}@mill.invalid> or mailto:{local} @ mill.invalid now."
        got = finder(text)
        assert [s.kind for s in got] == ["email", "email"] and all(text[s.start :].startswith(local) for s in got)
    assert finder("six bales @ 15 shillings, at dot") == []


def test_numbers_of_other_blocks(finder):
    """Numbers outside the blocks that are kept for examples are found as well."""
    for text, kind, value in (("Call +44 113 4960 1234 today.", "phone", "+44 113 4960 1234"), ("Ring (0121) 496 0123 and ask.", "phone", "(0121) 496 0123"), ("Passport of the owner: AB 98 76 54 D, shown.", "id_number", "AB 98 76 54 D"), ("Паспорт 4510 123456, рядом.", "id_number", "4510 123456")):
        assert [(s.kind, text[s.start : s.end]) for s in finder(text)] == [(kind, value)], text


def test_held_out_accuracy(finder):
    right = wrong = missed = 0
    for segments, gold in pii.training_examples(finder, 400, seed=77):
        got = {(s.start, s.end, s.kind) for s in semicrf.decode(segments, finder.weights)}
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


@pytest.mark.parametrize("seed", range(10))
def test_decoding_is_the_best_choice(seed):
    rng = random.Random(seed)
    segments = [Segment(s, s + rng.randint(1, 5), "k", (str(i),)) for i in range(9) for s in [rng.randint(0, 14)]]
    weights = {str(i): rng.uniform(-2, 3) for i in range(9)}

    def value(chosen):
        ordered = sorted(chosen, key=lambda s: s.start)
        return sum(semicrf.score(s, weights) for s in chosen) if all(a.end <= b.start for a, b in zip(ordered, ordered[1:], strict=False)) else float("-inf")

    best = max(value(c) for n in range(10) for c in itertools.combinations(segments, n))
    got = semicrf.decode(segments, weights)
    assert abs(value(got) - best) < 1e-9
    for group in semicrf.clusters(segments):
        group.sort(key=lambda s: s.end)
        z = {c: 2.718281828459045 ** value(c) for n in range(len(group) + 1) for c in itertools.combinations(group, n) if value(c) > float("-inf")}
        for s, p in zip(group, semicrf._marginals(group, weights), strict=True):
            assert abs(p - sum(v for c, v in z.items() if s in c) / sum(z.values())) < 1e-6


def test_tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(99, None, "x")], "doc_id bigint, text string, kind string")
    names = spark.createDataFrame([(1, "Elvella", "given"), (2, "Karika", "given"), (3, "Limgate", "family"), (4, "Varnworth", "family"), (5, None, "given"), (6, "", "family"), (7, "Garden", "family"), (8, "Marsh", "family"), (9, "Tamond", "given")], "entry_id bigint, name_part string, part_kind string")
    got = {(r.id, r.start_char, r.kind) for r in pii.occurrences(docs, names).collect()}
    assert (1, CASES[1][0].index("Elvella"), "name") in got
    clean = {r.id: r.redacted for r in pii.redacted(docs, names).collect()}
    assert clean[1] == "The key is kept by [NAME]; Mr [NAME] has left." and clean[99] is None and clean[13] == ""
    assert pii.occurrences(docs.filter("false"), names.filter("false")).count() == 0


def test_all_common_words_of_candidates_count(spark, monkeypatch):
    monkeypatch.setattr(pii, "COMMON_WORDS", 2, raising=False)
    texts = ["the garden of the house and the house of the fertile island"] * 3 + ["Mr Garden and Tamond Fertile came by the house.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = spark.createDataFrame([(1, "Garden", "family"), (2, "Tamond", "given")], "entry_id bigint, name_part string, part_kind string")
    assert pii.finder(docs, names).common == {"garden", "fertile"}
