from __future__ import annotations

import json

from pageflow.operators import nested

BODY = {"pdf_info": [{"page_idx": 0, "para_blocks": [{"type": "list", "blocks": {"type": "text", "lines": [None, {"spans": [{"content": "a"}, 3, {"text": "b"}]}]}}], "discarded_blocks": None}, None, {"preproc_blocks": {"type": "image", "lines": {"spans": {"latex": "x"}}}}]}
PATHS = {
    "pdf_info[0].para_blocks[0]": "pdf_info[0]",
    "pdf_info[0].para_blocks[0].blocks[0]": "pdf_info[0].para_blocks[0]",
    "pdf_info[0].para_blocks[0].blocks[0].lines[1]": "pdf_info[0].para_blocks[0].blocks[0]",
    "pdf_info[0].para_blocks[0].blocks[0].lines[1].spans[0]": "pdf_info[0].para_blocks[0].blocks[0].lines[1]",
    "pdf_info[0].para_blocks[0].blocks[0].lines[1].spans[2]": "pdf_info[0].para_blocks[0].blocks[0].lines[1]",
    "pdf_info[2].preproc_blocks[0]": "pdf_info[2]",
    "pdf_info[2].preproc_blocks[0].lines[0]": "pdf_info[2].preproc_blocks[0]",
    "pdf_info[2].preproc_blocks[0].lines[0].spans[0]": "pdf_info[2].preproc_blocks[0].lines[0]",
}


def rows(spark, bodies):
    df = spark.createDataFrame([(i, b, "x", 1) for i, b in enumerate(bodies)], "record_id bigint, body string, node_path string, tag int")
    return {(r.record_id, r.node_path): r.parent_path for r in nested.nodes_below_pages(df).collect()}


def test_shapes(spark):
    plain = json.dumps(BODY)
    wrapped = json.dumps({"status": "done", "result": {"more": [{"pdf_info": json.dumps(BODY["pdf_info"])}]}})
    got = rows(spark, [plain, wrapped, plain])
    for i in range(3):
        assert {p: v for (r, p), v in got.items() if r == i} == PATHS


def test_no_cases(spark):
    assert rows(spark, [None, "", "{", '{"pdf_info": [', "[]", "3", '{"pdf_info": null}', '{"pdf_info": "no json"}', '{"pdf_info": [NaN]}']) == {}


def test_empty_table(spark):
    assert rows(spark, []) == {}


def test_deep_nesting_without_recursion(spark):
    body: dict = {"type": "text"}
    for _ in range(300):
        body = {"blocks": [body]}
    got = rows(spark, [json.dumps({"pdf_info": {"para_blocks": [body]}})])
    assert len(got) == 301


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps(BODY))], "record_id bigint, body string")
    nested.write_tagged(nested.emit_tagged(df), str(tmp_path / "t"))
    tables = nested.read_tables(spark, str(tmp_path / "t"))
    assert {k: t.count() for k, t in tables.items()} == {"pages": 2, "blocks": 3, "lines": 2, "spans": 3}
    assert {r.node_value for r in tables["spans"].collect()} == {"a", "b", "x"}
    keys = {r.node_path for t in tables.values() for r in t.collect()}
    assert all(r.parent_path in keys for t in ("blocks", "lines", "spans") for r in tables[t].collect())
