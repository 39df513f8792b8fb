from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageflow.operators import cells, lines, overlap, pages, rebuild, state, tables

CELL = "file_id bigint, page_index int, cell_ord int, box array<double>, content string"


def test_hole_filling_is_greedy_and_ordered(spark):
    have = spark.createDataFrame([(1, 0, 0, [0.0, 0.0, 10.0, 10.0], "a")], CELL)
    more = spark.createDataFrame([(1, 0, 0, [0.0, 0.0, 10.0, 9.0], "covered"), (1, 0, 1, [20.0, 0.0, 30.0, 10.0], "new"), (1, 0, 2, [21.0, 0.0, 30.0, 10.0], "covered by new"), (2, 0, 0, [0.0, 0.0, 1.0, 1.0], "other page")], CELL)
    got = cells.fill_holes(have, more, ["file_id", "page_index"])
    assert {r.content for r in got.collect()} == {"a", "new", "other page"}
    free = cells.uncovered(more, have, ["file_id", "page_index"])
    assert {r.content for r in free.collect()} == {"new", "covered by new", "other page"}


def test_marker_body_goes_to_the_nearest_empty_sibling(spark):
    schema = "file_id bigint, page_index int, block_uid bigint, block_id int, block_order int, block_label string, block_content string, block_bbox array<double>"
    body = "[35]\n" + "a long body of the note that is in the wrong place"
    rows = [(1, 0, 10, 0, 0, "text", body, [0.0, 0.0, 10.0, 10.0]), (1, 0, 11, 1, 1, "text", "", [12.0, 0.0, 112.0, 10.0]), (1, 0, 12, 2, 2, "text", "", [12.0, 0.0, 212.0, 10.0]), (1, 1, 13, 0, 0, "text", "", [12.0, 0.0, 112.0, 10.0])]
    got = cells.marker_bodies(spark.createDataFrame(rows, schema)).collect()
    assert [(r.block_uid, r.sibling_uid) for r in got] == [(10, 11)]
    filled = [(*r[:6], "taken", r[7]) if r[2] in (11, 12) else r for r in rows]
    assert cells.marker_bodies(spark.createDataFrame(filled, schema)).count() == 0


def test_categories(spark):
    df = spark.createDataFrame([(x,) for x in ("Figure_Caption", " TABLE ", "odd", None, "")], "c string")
    assert [r.r for r in df.select(cells.category(F.col("c")).alias("r")).collect()] == ["Caption", "Table", "odd", "Text", "Text"]
    assert [r.r for r in df.select(cells.block_category(F.col("c")).alias("r")).collect()] == ["Caption", "Table", "Text", "Text", "Text"]


def _leak_pages(spark):
    rng = random.Random(3)
    text = ["Page %d " % p + " ".join(f"word{rng.randint(100, 999)}{p}" for _ in range(80)) for p in range(8)]
    rows = [(1, p, text[p] + (" " + text[p + 1] if p == 0 else ""), text[p]) for p in range(8)]
    return spark.createDataFrame(rows, "file_id bigint, page_index int, text string, source_text string"), text


def test_leak_is_found_and_repaired(spark):
    df, text = _leak_pages(spark)
    keys = overlap.page_keys(df)
    leaking = overlap.leaking_pages(keys)
    got = leaking.collect()
    assert [(r.page_index, [t.target_page for t in r.targets]) for r in got] == [(0, [2])]
    retries = spark.createDataFrame([(1, 0, text[0], True)], "file_id bigint, page_index int, retry_text string, page_local boolean")
    assert overlap.repair(df, retries, leaking).first().repaired_from == "retry"
    assert overlap.repair(df, retries.filter("false"), leaking).first().repaired_from == "source_text"
    local = overlap.page_local(keys, leaking)
    assert {r.page_index: r.page_local for r in local.collect()} == {p: p != 0 for p in range(8)}


@pytest.mark.parametrize("first", [0, 57])
def test_overlaps_cross_blocks_like_brute_force(spark, first):
    rng = random.Random(first)
    rows = [(1, p, "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), "".join(rng.choice("abc") for _ in range(40))) for p in range(first, first + 9) if p != first + 4]
    df = spark.createDataFrame(rows, "file_id bigint, page_index int, out_key string, src_key string")
    grams = lambda s: {s[i : i + 16] for i in range(len(s) - 15)}
    want = {(a[1], b[1] + 1, len(grams(b[3]) & grams(a[2])), len(grams(b[3]))) for a in rows for b in rows if 0 < b[1] - a[1] <= 5}
    got = overlap.forward_overlaps(df, gated=False).collect()
    assert {(r.page_index, r.target_page, r.shared, r.total) for r in got} == want and len(got) == len(want)


def test_repeated_lines(spark):
    df = spark.createDataFrame([(1, "a\nA \na\nb\n\n\n\nc"), (2, None), (3, "")], "id bigint, t string")
    assert [tuple(r) for r in lines.repeated_runs(df, ["id"], "t").collect()] == [(1, 0, 3, "a")]
    assert {r.id: r.collapsed for r in lines.collapse_lines(df, ["id"], "t").collect()} == {1: "a\nb\n\n\n\nc", 2: "", 3: ""}


def test_tables(spark):
    html = "<table><tr><td></td><th>Outer</th></tr><tr><td><b>x</b></td><td>12</td></tr><tr><td>y</td><td>xiv</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "| a | b |\n|---|---|\n| c | 5 |"), (3, None), (4, "no table")], "id bigint, t string")
    rows = tables.table_rows(df, ["id"], "t")
    got = {(r.id, r.row_no): (r.cells, r.first_col, r.source) for r in rows.collect()}
    assert got == {(1, 0): (["", "Outer"], 1, "html"), (1, 1): (["x", "12"], 0, "html"), (1, 2): (["y", "xiv"], 0, "html"), (2, 0): (["a", "b"], 0, "plain"), (2, 1): (["c", "5"], 0, "plain")}
    assert {r.id: r.is_toc for r in tables.contents_tables(rows, ["id"]).collect()} == {1: True, 2: False}
    assert {r.id: r.markdown for r in tables.to_markdown(rows, ["id"]).collect()}[2] == "| a | b |\n|---|---|\n| c | 5 |"


def test_retry_reasons_are_a_set(spark):
    df = spark.createDataFrame([(["a; b"],), (None,)], "r array<string>")
    assert [r.r for r in df.select(pages.append_reason(F.col("r"), "a; b").alias("r")).collect()] == [["a; b"], ["a; b"]]


def test_coverage(spark):
    files = spark.createDataFrame([(1, 3), (2, None), (3, 0)], "file_id bigint, page_count int")
    have = spark.createDataFrame([(1, 0), (1, 0), (1, 5), (4, 1)], "file_id bigint, page_index int")
    got = {r.file_id: (r.n_expected, r.n_covered, r.n_missing, r.n_beyond) for r in pages.coverage_manifest(files, have).collect()}
    assert got == {1: (3, 1, 2, 1), 4: (0, 0, 0, 1)}


def test_checksums(spark):
    df = state.with_checksum(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), ["k", "v"])
    assert state.verified(df, ["k", "v"]).count() == 2
    assert state.verified(df.withColumn("v", F.lit("changed")), ["k", "v"]).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        state.with_checksum(df, ["k"])


def test_reuse(spark):
    old = spark.createDataFrame([(1, "completed", "x", None), (2, "completed", "x", "y"), (3, "failed", "x", None)], "k int, status string, code string, cfg string")
    now = spark.createDataFrame([(i, "x", None) for i in (1, 2, 3, 4)], "k int, code string, cfg string")
    assert {r.k: r.reuse for r in state.reusable(old, now, ["k"], ["code", "cfg"]).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [r.k for r in state.pending(now, old, ["k"]).collect()] == [4]


def test_book(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, " ")], "file_id bigint, page_index int, markdown string")
    assert rebuild.book_markdown(df).first().markdown == "a\n\nb\n"
