from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pageflow.operators import records, recovery


@pytest.mark.parametrize(
    ("record", "hint", "want"),
    [({"page_idx": 3}, None, 3), ({"page_no": 3}, None, 2), ({"page": 0}, None, 0), ({"page_number": "7", "page_idx": "2"}, None, 2), ({"page_id": -4}, 1, 0), ({"page_idx": "x", "page_no": 9}, 5, 5), ({"other": 1}, 6, 6), ({"page_idx": None}, 4, 4)],
)
def test_page_of_a_record(spark, record, hint, want):
    df = spark.createDataFrame([(json.dumps(record), hint)], "r string, h int")
    assert df.select(records.page_index_of_record(F.col("r"), F.col("h")).alias("p")).first().p == want


def test_page_of_odd_records(spark):
    df = spark.createDataFrame([(None, 2), ("no json", 3), ("[1]", 4)], "r string, h int")
    assert [r.p for r in df.select(records.page_index_of_record(F.col("r"), F.col("h")).alias("p")).collect()] == [2, 3, 4]


def test_units_tables_and_blocks(spark):
    df = spark.createDataFrame([("o/a_content_list.json", [1.0, 900.0]), ("o/a_MODEL.json", [0.1, 0.9]), ("o/a_model.json", [10.0, 20.0]), ("o/a_middle.json", None), ("o/x.json", [1.0])], "p string, b array<double>")
    assert [r.u for r in df.select(records.box_units(F.col("p"), F.col("b")).alias("u")).collect()] == ["mineru_1000", "relative", None, "pdf", None]
    own = {"html": " <table>a</table> "}
    below = {"blocks": [{"lines": [{"spans": [{"html": "<table>1</table>"}, {"text": "x"}, None]}]}, {"lines": None}, {"lines": [{"spans": [{"html": " <table>2</table>"}]}, {"spans": None}]}]}
    rows = spark.createDataFrame([(json.dumps(x),) for x in (own, below, {"blocks": None}, {})] + [(None,)], "r string")
    assert [r.h for r in rows.select(records.table_html(F.col("r")).alias("h")).collect()] == ["<table>a</table>", "<table>1</table>\n<table>2</table>", "", "", ""]
    df = spark.createDataFrame([("Text", [1.0], "t", ""), ("Text", None, "t", ""), ("Table", [1.0], "", "<table>"), ("Text", [1.0], " ", "<table>"), ("Text", [1.0], None, None)], "c string, b array<double>, t string, h string")
    assert [r.k for r in df.select(records.is_block(F.col("c"), F.col("b"), F.col("t"), F.col("h")).alias("k")).collect()] == [True, False, True, False, False]


PAGE = "file_id bigint, page_index int, category string, text string, left double, top double, width double, height double"


def test_retry_blocks_merge(spark):
    shared = "the same words that both of the cropped bands have read at their common edge"
    rows = [
        (1, 0, "Text", "First part, " + shared, 50.0, 100.0, 400.0, 80.0), (1, 0, "Text", shared + " and last part.", 52.0, 300.0, 400.0, 60.0),  # the same words
        (1, 0, "Text", "far away", 50.0, 700.0, 400.0, 20.0), (1, 0, "Page-header", "head", 50.0, 20.0, 400.0, 20.0), (1, 0, "Table", "far away", 50.0, 700.0, 400.0, 20.0),
        (1, 1, "Text", "above", 50.0, 100.0, 400.0, 20.0), (1, 1, "List-item", "below", 60.0, 123.0, 380.0, 20.0), (1, 1, "Text", "beside", 480.0, 123.0, 80.0, 20.0), (1, 2, "Text", None, 1.0, 1.0, 0.0, 0.0),
    ]
    got = recovery.merge_retry_blocks(spark.createDataFrame(rows, PAGE)).orderBy("page_index", "block_no").collect()
    first = [(r.category, r.text, r.n_merged) for r in got if r.page_index == 0]
    assert first == [("Text", "First part, " + shared + " and last part.", 2), ("Text", "far away", 1), ("Table", "far away", 1), ("Page-header", "head", 1)]
    assert (got[0].left, got[0].top, got[0].width, got[0].height) == (50.0, 100.0, 402.0, 260.0)
    assert [(r.text, r.n_merged) for r in got if r.page_index == 1] == [("above below", 2), ("beside", 1)]
    assert [(r.text, r.n_merged) for r in got if r.page_index == 2] == [("", 1)]
    assert recovery.merge_retry_blocks(spark.createDataFrame([], PAGE)).count() == 0


def test_margins(spark):
    rows = [(1, 0, "Text", "wide", 0.0, 0.0, 600.0, 10.0), (1, 0, "Text", "inside", 100.0, 0.0, 300.0, 10.0), (1, 0, "Picture", "kept", 0.0, 0.0, 600.0, 10.0), (1, 0, "Text", "left", 0.0, 0.0, 20.0, 10.0)]
    got = {r.text: (round(r.left, 3), round(r.width, 3), r.clamped) for r in recovery.clamp_to_margins(spark.createDataFrame(rows, PAGE), F.lit(600.0)).collect()}
    assert got == {"wide": (39.0, 522.0, True), "inside": (100.0, 300.0, False), "kept": (0.0, 600.0, False), "left": (39.0, 20.0, True)}


def test_degraded_tables_and_leaks(spark):
    debris = "x=1 y=2 ### " * 30
    pages = spark.createDataFrame([(1, 0, debris, None, False), (2, 1, "good text", "an earlier reason", None), (3, 2, None, None, True)], "page_result_id bigint, page_index int, text string, retry_reason string, needs_retry boolean").withColumn("file_id", F.lit(7))
    got = {r.page_result_id: (r.degraded, r.reasons, r.text) for r in recovery.degraded(pages).collect()}
    assert got == {1: (True, [recovery.IMAGE_REASON], None), 2: (False, ["an earlier reason"], "good text"), 3: (False, [], None)}
    cells = spark.sql("SELECT array(named_struct('category', ' Table', 'bbox', array(1.0)), named_struct('category', 'Text', 'bbox', null)) AS cells")
    assert [c.category for c in cells.select(recovery.tables_as_text(F.col("cells")).alias("c")).first().c] == ["Text", "Text"]
    leaking = spark.sql("SELECT 7 AS file_id, 1 AS page_index, array(named_struct('target_page', 3), named_struct('target_page', 4)) AS targets")
    marked = {r.page_result_id: (r.leak_targets, r.needs_retry, r.reasons) for r in recovery.with_leaks(pages, leaking, "leak").collect()}
    assert marked == {1: (None, False, []), 2: ([3, 4], True, ["an earlier reason", "leak"]), 3: (None, True, [])}


def test_identities(spark):
    df = spark.createDataFrame([("s", [1, 2], 0, 59, "c", "r", "k"), ("s", [1, 3], 0, 60, "c", "r", "k"), ("s", [1, 2], 0, 59, "c", "r", "k")], "sha string, pages array<int>, a int, b int, cfg string, rt string, code string")
    sets = [r.identity for r in recovery.page_set_identity(df, "sha", "pages", "cfg", "rt").collect()]
    alone = [r.identity for r in recovery.page_set_identity(df, "sha", "pages", "cfg", "rt", isolated=True).collect()]
    chunks = [r.identity for r in recovery.chunk_identity(df, "sha", "a", "b", "cfg", "code", "rt").collect()]
    assert sets[0] == sets[2] != sets[1] and chunks[0] == chunks[2] != chunks[1] and not set(sets) & set(alone)
