from __future__ import annotations

import random

import pytest

from pageflow.llm import mixing, packing, tokens


@pytest.mark.parametrize("seed", range(6))
def test_patterns_place_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 512])
    histogram = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    slots, bins = packing.patterns(dict(histogram), capacity)
    fill = [0] * bins
    placed = dict.fromkeys(histogram, 0)
    for n in histogram:
        own = sorted((s for s in slots if s.length == n), key=lambda s: s.first)
        for s, following in zip(own, [*own[1:], None], strict=True):
            stop = following.first if following else histogram[n]
            for rank in range(s.first, stop):
                fill[s.base + (rank - s.first) // s.uses] += n
                placed[n] += 1
    assert placed == histogram and max(fill) <= capacity and min(fill) > 0
    total = sum(n * c for n, c in histogram.items())
    assert bins <= 1.3 * total / capacity + 1


def documents(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id bigint, text string, source string, length int, bin string")


def test_packing_is_whole(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 60))), "s") for i in range(150)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "word " * 500, "s"), (903, rows[0][1], "s")] + [(1000 + i, "same size text", "s") for i in range(100)]
    docs = documents(spark, rows)
    sizes = spark.createDataFrame([("small", 32), ("large", 200), ("none", 0)], "container string, capacity_tokens int")
    got = packing.packed(docs, sizes).collect()
    count = {r.id: r.tokens for r in tokens.with_tokens(docs, "doc_id", "text").collect()}
    for name, capacity in (("small", 32), ("large", 200)):
        own = [r for r in got if r.container == name]
        fill: dict = {}
        parts: dict = {}
        for r in own:
            parts.setdefault(r.id, []).append((r.token_from, r.length))
            if r.bin is not None:
                fill[r.bin] = fill.get(r.bin, 0) + r.length
        assert max(fill.values()) <= capacity and set(parts) == set(count)
        for i, p in parts.items():
            at = 0
            for start, n in sorted(p):
                assert start == at
                at += n
            assert at == count[i] and (len([n for _, n in p if n]) <= 1 or count[i] > capacity)
        assert sum(fill.values()) / (len(fill) * capacity) > 0.95
    assert packing.packed(documents(spark, []), sizes).count() == 0


def test_token_counts_agree_with_the_library(spark):
    texts = ["Hello world", "Über den Fluß", "没有证据", "<|endoftext|>", "a" * 1000, " \n\t "]
    got = {r.id: r.tokens for r in tokens.with_tokens(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), "doc_id", "text").collect()}
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def mix_docs(spark, rng, sizes, nulls=0):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(rng.choice(["x", "yy", source[:3]]) for _ in range(rng.randint(1, 40))), source))
            i += 1
    rows += [(i + k, "aaa unknown text", None) for k in range(nulls)] + [(i + 50, "", "aaa"), (i + 51, None, "bbb")]
    return documents(spark, rows)


def test_shares_are_met_within_bounds(spark):
    docs = mix_docs(spark, random.Random(3), {"aaa": 300, "bbb": 60, "ccc": 150, "other": 40}, nulls=5)
    targets = spark.createDataFrame([("aaa", 0.25, 1), ("bbb", 0.25, 3), ("ccc", 0.25, 2), ("absent", 0.25, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.mixed(docs, targets).collect()
    assert len(rows) == docs.count()
    cap = {"aaa": 1, "bbb": 3, "ccc": 2}
    assert all(r.uses <= cap.get(r.domain, 0) for r in rows)
    assert all(r.uses == 0 for r in rows if r.source == "other" or r.tokens == 0)
    used = {s: sum(r.uses * r.tokens for r in rows if r.source == s) for s in cap}
    assert all(abs(v / sum(used.values()) - 1 / 3) < 0.01 for v in used.values()), used
    whole = {s: sum(r.tokens for r in rows if r.source == s) * c for s, c in cap.items()}
    assert max(used[s] / whole[s] for s in cap) > 0.97  # no more can be had from the scarcest source
    report = {r.source: r for r in mixing.shares(mixing.mixed(docs, targets), targets).collect()}
    assert report["absent"].tokens_used == 0 and abs(report["aaa"].actual_share - report["aaa"].reachable_share) < 0.01


def test_mixing_odd_tables(spark):
    empty = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    docs = mix_docs(spark, random.Random(1), {"aaa": 3})
    assert {r.uses for r in mixing.mixed(docs, empty).collect()} == {0}
    targets = spark.createDataFrame([("zzz", 1.0, 1), (None, 0.2, 1), ("aaa", 0.0, 1)], "source string, target_share double, max_repeats int")
    assert {r.uses for r in mixing.mixed(docs, targets).collect()} == {0}
    assert mixing.mixed(documents(spark, []), targets).count() == 0


def test_classifier_knows_clear_cases(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(v) for _ in range(30)), s) for i in range(60) for s, v in [(("a", "b")[i % 2], (["sea", "ship", "port"], ["mill", "corn", "field"])[i % 2])]], "id bigint, text string, source string")
    model = mixing.fit_classifier(docs, ["a", "b"])
    got = [r.post for r in mixing.posteriors(spark.createDataFrame([(1, "the ship in the port"), (2, "corn and mill"), (3, None)], "id bigint, text string"), model).orderBy("id").collect()]
    assert got[0][0] > 0.9 and got[1][1] > 0.9 and abs(sum(got[2]) - 1) < 1e-9


def test_chinese_characters_are_words():
    assert len(mixing.hashed_words("灯塔抄本")) == 4 and len(mixing.hashed_words("the 灯 ship")) == 3


def test_memberships_are_soft_and_bounded(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.5, 0.3, 0.1, 0.06, 0.04],), ([0.0, 0.0, 1.0, 0.0, 0.0],), ([0.2, 0.2, 0.2, 0.2, 0.2],)], "post array<double>")
    got = [r.m for r in df.select(mixing.membership(F.col("post"), 4).alias("m")).collect()]
    assert got == [[0.5, 0.3125, 0.125, 0.0], [0.0, 0.0, 1.0, 0.0], [0.1875, 0.1875, 0.1875, 0.0]]


def test_soft_documents_count_by_their_parts(spark):
    rng = random.Random(5)
    words = {"aaa": ["sea", "ship", "port", "mast"], "bbb": ["mill", "corn", "field", "flour"], "other": ["law", "court", "judge", "jury"]}
    rows = [(i, " ".join(rng.choice(words[s]) for _ in range(20)), s) for i, s in enumerate(["aaa", "bbb", "other"] * 60)]
    rows += [(1000 + i, " ".join(rng.choice(words["aaa"] + words["bbb"]) for _ in range(3)), None) for i in range(30)] + [(2000 + i, "law court judge jury", None) for i in range(5)]
    targets = spark.createDataFrame([("aaa", 0.7, 2), ("bbb", 0.3, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(documents(spark, rows), targets)
    by = {r.id: r for r in got.collect()}
    assert all(by[2000 + i].uses == 0 for i in range(5))  # they belong to the class of all other sources
    assert any(0 < by[1000 + i].membership["aaa"] < 1 for i in range(30))
    assert all(r.uses <= 2 for r in by.values() if r.membership["aaa"] > 0)
    report = {r.source: r for r in mixing.shares(got, targets).collect()}
    assert abs(report["aaa"].expected_share - 0.7) < 0.01 and abs(report["bbb"].expected_share - 0.3) < 0.01
    known = {r.source: r for r in mixing.held_out(documents(spark, rows), targets).collect()}
    assert sum(r.n_right for r in known.values()) >= 0.95 * sum(r.n_docs for r in known.values())


def test_frontier(spark):
    docs = documents(spark, [(i, "word " * 10, "aaa") for i in range(10)] + [(20 + i, "word " * 10, "bbb") for i in range(90)])
    targets = spark.createDataFrame([("aaa", 0.5, 1), ("bbb", 0.5, 1), ("ccc", 0.3, 1)], "source string, target_share double, max_repeats int")
    got = {(r.factor, r.source): r.reachable_share for r in mixing.frontier(docs, targets).collect()}
    assert got[1, "aaa"] == got[1, "bbb"] == 0.5 and got[5, "aaa"] == round(1 / 6, 8) and got[10, "bbb"] == 0.9
