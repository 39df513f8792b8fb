from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pageflow.sources import readers, writers
from pageflow.streaming import progress


def test_layout_files(spark, tmp_path):
    good = [{"bbox": [1, 2, 3, 4], "category": "Text", "text": "t"}]
    (tmp_path / "a_middle.json").write_text(json.dumps(good))
    (tmp_path / "b_middle.json").write_text(json.dumps(json.dumps(good)))
    (tmp_path / "c_model.json").write_text('[{"bbox": [1, 2, 3, 4], "category": "Text", "text": "cut \\"of')
    (tmp_path / "d_other.json").write_text("nothing")
    df = readers.parsed_layout(readers.whole_texts(spark, str(tmp_path), "*.json"))
    got = {r.path.rsplit("/")[-1][0]: (r.t, r.repaired) for r in df.select("path", "repaired", F.try_variant_get("layout", "$[0].text", "string").alias("t")).collect()}
    assert got == {"a": ("t", False), "b": ("t", False), "c": ('cut "of', True), "d": (None, False)}
    chosen = readers.select_layout_files(readers.files(spark, str(tmp_path), "*.json"))
    assert sorted(r.name for r in chosen.collect()) == ["a_middle.json", "b_middle.json"]


@pytest.mark.parametrize(
    ("names", "chosen"),
    [
        (["a_model.json", "a_content_list.json", "a_content_list_v2.json"], ["a_content_list.json"]),
        (["a_model.json", "a_content_list_v2.json"], ["a_model.json"]),
        (["a_layout.json", "b_layout.json", "z.json"], ["a_layout.json"]),
        (["a_middle.json", "b_middle.json", "a_model.json"], ["a_middle.json", "b_middle.json"]),
        (["middle_notes.json", "x.json"], ["middle_notes.json"]),
    ],
)
def test_one_family_of_layout_files(spark, names, chosen):
    df = spark.createDataFrame([(f"/out/{n}",) for n in names], "path string")
    assert sorted(r.path.rsplit("/")[-1] for r in readers.select_layout_files(df).collect()) == chosen
    assert readers.supplement_layout_files(df).count() == sum(n.endswith("_middle.json") for n in names)


def test_progress_of_each_stage(spark):
    stages = [("a", 1, "parse 90/200", 29.2), ("b", 1, "layout 100/200", 80.0), ("c", 1, "render 50/200", 86.2), ("d", 1, "validate 100/200", 91.5), ("e", 1, "image validate 50/200", 95.8)]
    df = spark.createDataFrame([x[:3] for x in stages], "run_id string, seq bigint, line string")
    got = {r.run_id: r.percent for r in progress.running_progress(progress.parse_lines(df)).collect()}
    assert got == {x[0]: x[3] for x in stages}


def test_markdown_and_logs(spark, tmp_path):
    (tmp_path / "x_nohf.md").write_text("a\n\n\n\nb ")
    (tmp_path / "x.md").write_text("other")
    (tmp_path / "run.log").write_text("cells post process error\nNCCL error\ncells post process error")
    assert [r.text for r in readers.markdown_files(spark, str(tmp_path)).collect()] == ["a\n\nb"]
    log = readers.log_failures(readers.whole_texts(spark, str(tmp_path), "*.log")).first()
    assert (log.n_cell_errors, log.json_errors, log.transient) == (2, True, True)


def test_page_names_and_lists(spark):
    df = spark.createDataFrame([("d/page_0003.png", "2, 1,2", 5), ("d/x.png", "", 3), ("d/p12.json", None, 1)], "p string, v string, n int")
    assert [r.i for r in df.select(readers.page_index_of(F.col("p")).alias("i")).collect()] == [2, None, 11]
    assert [r.i for r in df.select(readers.page_list(F.col("v"), F.col("n")).alias("i")).collect()] == [[0, 1], [0, 1, 2], [0]]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([("9", 5)], "v string, n int").select(readers.page_list(F.col("v"), F.col("n"))).collect()


def test_writers(spark, tmp_path):
    books = spark.createDataFrame([(1, 0, "a\n"), (2, 0, "b\n"), (1, 1, "c\n")], "file_id bigint, part_no int, markdown string")
    writers.write_books(books, str(tmp_path / "books"))
    assert spark.read.text(str(tmp_path / "books")).filter("value <> ''").count() == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "books" / "file_id=1")).collect() if r.value] == ["a", "c"]
    counts = spark.createDataFrame([(1, 2, 0, 0), (2, 1, 0, 1), (3, 0, 1, 0)], "file_id bigint, completed bigint, skipped bigint, failed bigint")
    r = writers.batch_summary(counts).first()
    assert (r.completed, r.skipped, r.failed, r.status) == (1, 1, 1, "completed_with_failures")


LINES = [("r", 1, "Processing file"), ("r", 2, "\x1b[32mparse 30/60\x1b[0m"), ("r", 3, "parse 10/60"), ("r", 4, "layout 100/200"), ("r", 5, "noise"), ("r", 6, "image render 50/200"), ("s", 1, "skipped")]


def test_progress_never_falls(spark):
    df = spark.createDataFrame(LINES, "run_id string, seq bigint, line string")
    got = {(r.run_id, r.seq): (r.stage, r.percent) for r in progress.running_progress(progress.parse_lines(df)).collect()}
    assert got == {("r", 1): (None, 0.0), ("r", 2): ("parse", 32.5), ("r", 3): ("parse", 32.5), ("r", 4): ("layout", 80.0), ("r", 5): ("layout", 80.0), ("r", 6): ("image_render", 93.5), ("s", 1): (None, 100.0)}


def test_stream_folds_to_the_same_state(spark, tmp_path):
    for i, part in enumerate((LINES[:3], LINES[3:], LINES[1:4])):  # the last part repeats lines
        spark.createDataFrame(part, "run_id string, seq bigint, line string").coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("run_id string, seq bigint, line string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = progress.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.run_id: r for r in spark.sql("SELECT run_id, max_by(stage, seq) AS stage, max(percent) AS percent, max(seq) AS seq FROM folded GROUP BY run_id").collect()}
    assert (last["r"].stage, last["r"].percent, last["r"].seq) == ("image_render", 93.5, 6)
    assert last["s"].percent == 100.0


def test_log_cursor(spark):
    df = spark.createDataFrame([("r", 1, "abc"), ("r", 2, "defg")], "run_id string, seq bigint, line string")
    assert progress.log_since(df, 4).first().text == "defg"
    assert progress.log_since(df, 0).first().offset == 9
    assert progress.log_since(df, 0, kept=5).first().text == "defg"
