from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pageflow.functions.segments import inline_segments, safe_text, script_runs, uncovered_chars
from pageflow.operators import layout, validate
from pageflow.sources import recognize

CELL = "file_id bigint, page_index int, cell_ord int, category string, content string, box array<double>, units string"


def made(spark, rows):
    w, h = F.lit(595.0), F.lit(842.0)
    return layout.blocks(spark.createDataFrame([(1, 0, i, *r, "pdf") for i, r in enumerate(rows)], CELL), w, h, w, h)


def test_blocks_drop_empty_text_and_clamp(spark):
    got = made(spark, [("Text", " ", [0.0, 0.0, 10.0, 10.0]), ("Formula", "", [10.0, 10.0, 700.0, 20.0]), ("Text", "a", [5.0, 5.0, 5.2, 5.2]), ("Text", "b", None)]).collect()
    assert {r.cell_ord: (r.width, r.height) for r in got} == {1: (585.0, 10.0), 2: (1.0, 1.0)}


def test_dense_notes(spark):
    rows = [("Text", f"{n}. note", [10.0, 10.0 * n, 200.0, 10.0 * n + 5.0]) for n in range(1, 11)]
    got = layout.dense_note_pages(made(spark, rows), F.lit(330.0)).collect()
    assert [(r.n_blocks, r.n_numbered, r.n_rising) for r in got] == [(10, 10, 9)] and abs(got[0].note_size - 5.0 / 1.2) < 0.01
    assert layout.dense_note_pages(made(spark, rows[:7]), F.lit(330.0)).count() == 0
    assert layout.dense_note_pages(made(spark, rows[::-1]), F.lit(330.0)).count() == 0


def test_fit_and_reflow(spark):
    long = "word " * 300
    b = made(spark, [("Text", long, [50.0, 50.0, 60.0, 51.0]), ("Text", "short text", [50.0, 100.0, 545.0, 140.0]), ("Picture", "", [0.0, 300.0, 90.0, 400.0])])
    fit = layout.fitted(layout.with_fonts(b.withColumn("body_size", F.lit(10.0))))
    assert {r.cell_ord: r.fits for r in fit.collect()} == {0: False, 1: True, 2: True}
    assert [[f.cell_ord for f in r.failures] for r in layout.fit_failures(fit).collect()] == [[0]]
    new = {r.cell_ord: r for r in layout.reflow_pairs(fit).collect()}
    assert new[0].height > 1.0 and abs(new[1].top + new[1].height - 140.0) < 1e-6
    assert {r.cell_ord: r.block_no for r in layout.page_order(fit).collect()} == {0: 0, 1: 1, 2: 2}


def test_repairs(spark):
    prose = "This header is prose that stands in a box that is far too small for it, so it is text."
    b = made(spark, [("Page-header", prose, [50.0, 50.0, 120.0, 60.0]), ("Page-header", "Short", [50.0, 50.0, 120.0, 60.0])])
    got = {r.cell_ord: (r.category, r.repaired) for r in layout.repair_running_text(b, layout.body_sizes(b, F.lit(842.0)), F.lit(595.0)).collect()}
    assert got == {0: ("Text", True), 1: ("Page-header", False)}
    low = made(spark, [("Text", "word " * 200, [50.0, 50.0, 545.0, 60.0]), ("Text", "next", [50.0, 300.0, 545.0, 320.0])])
    grown = {r.cell_ord: (r.expanded, r.height) for r in layout.expand_compressed(low.join(layout.body_sizes(low, F.lit(842.0)), ["file_id", "page_index"]), F.lit(595.0), F.lit(842.0)).collect()}
    assert grown[0][0] and 10.0 < grown[0][1] <= 246.0 and not grown[1][0]


def test_validation(spark):
    df = spark.createDataFrame([(1, 0, "fine", False), (1, 1, "x \\frac{a} y", False), (1, 2, "⺀ \x01", True), (1, 3, "**b**", False), (1, 4, None, False)], "file_id bigint, page_index int, text string, img boolean")
    s = validate.scan(df, has_image=F.col("img"))
    assert {(r.page_index, r.rule) for r in validate.failures(s, ["page_index"]).collect()} == {(1, "latex_residue"), (2, "radical_chars"), (2, "control_chars"), (3, "suspected_markdown")}
    pages = spark.createDataFrame([(1, 0), (1, 4), (1, 2)], "file_id bigint, page_index int")
    assert {r.page_index for r in validate.not_blank(s, pages).collect()} == {0, 2}
    assert {r.page_index for r in validate.without_image(s, pages).collect()} == {0, 4}
    assert validate.with_raster(s).count() == 1
    files = spark.createDataFrame([(1, 6), (2, 1), (3, None)], "file_id bigint, page_count int")
    assert {(r.file_id, r.expected, r.actual) for r in validate.page_count_mismatches(files, s).collect()} == {(1, 6, 5), (2, 1, 0)}


def test_segments(spark):
    assert inline_segments("a **b _c_** `*d*` $e$ * f") == [("a ", "normal"), ("b ", "bold"), ("c", "italic"), (" ", "normal"), ("*d*", "code"), (" ", "normal"), ("e", "math"), (" * f", "normal")]
    assert inline_segments(None) == [] and inline_segments("**") == [("**", "normal")]
    df = spark.createDataFrame([("ab 文字，cd слово αβ",), (None,)], "t string")
    got = [[(x.text, x.script) for x in r.r] for r in df.select(script_runs(F.col("t")).alias("r")).collect()]
    assert got == [[("ab ", "latin"), ("文字，", "han"), ("cd ", "latin"), ("слово", "cyrillic"), (" ", "latin"), ("αβ", "greek")], []]
    one = spark.createDataFrame([("aßc",)], "t string").select(safe_text(F.col("t"), "a-z").alias("s"), uncovered_chars(F.col("t"), "a-z").alias("u")).first()
    assert (one.s, one.u) == ("a□c", ["ß"])


def test_recognizer_sees_only_open_pages(spark):
    def model(batches):
        for b in batches:
            yield pd.DataFrame({"file_id": b.file_id, "page_index": b.page_index, "text": ["seen"] * len(b)})

    work = spark.createDataFrame([(1, 0), (1, 1)], "file_id bigint, page_index int")
    done = spark.createDataFrame([(1, 0, "old")], "file_id bigint, page_index int, text string")
    new = recognize.recognize(work, done, model)
    assert [(r.page_index, r.text) for r in new.collect()] == [(1, "seen")]
    assert {(r.page_index, r.text) for r in recognize.merged(done, recognize.recognize(work, done, model, force=True)).collect()} == {(0, "seen"), (1, "seen")}
