from __future__ import annotations

import json

from pageflow.operators import blocktext


def test_cells_of_records(spark):
    def line(box, *spans):
        return {"bbox": box, "spans": list(spans)}

    def span(text, box=None, **more):
        return {"content": text, **({"bbox": box} if box else {}), **more}

    body = {
        "pdf_info": [
            {
                "page_idx": 4,
                "para_blocks": [
                    {"type": "text", "bbox": [0, 0, 100, 20], "lines": [line([0, 0, 100, 10], span("one", [0, 0, 20, 10]), span("two", [30, 0, 50, 10]), span("three", [50, 0, 70, 10])), line([0, 10, 100, 20], span("甲", [0, 10, 10, 20]), span("乙", [40, 10, 50, 20])), line([200, 0, 300, 10], span("outside"))]},
                    {"type": "list", "bbox": [0, 30, 100, 60], "blocks": [{"type": "text", "lines": {"spans": {"text": "inner"}}}]},
                ],
                "discarded_blocks": [{"type": "footer", "lines": [line(None, span("foot"))]}, {"type": "text", "lines": [line(None, span("dropped"))]}],
                "preproc_blocks": [{"type": "text", "bbox": [0, 0, 100, 19], "lines": [line(None, span("covered"))]}, {"type": "text", "bbox": [0, 200, 100, 220], "lines": [line(None, span("x", type="inline_equation"), span(""))]}],
            },
            {"para_blocks": {"type": "title", "lines": {"spans": {"latex": "E=m"}}}},
        ]
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, "{")], "record_id bigint, body string")
    got = {(r.page_index, r.container, r.category, r.content) for r in blocktext.record_cells(df).collect()}
    assert got == {
        (4, "para_blocks", "Text", "one twothree\n甲乙"),
        (4, "para_blocks", "Text", "inner"),
        (4, "discarded_blocks", "Page-footer", "foot"),
        (4, "preproc_blocks", "Text", "x"),
        (1, "para_blocks", "Title", "E=m"),
    }
    assert blocktext.record_cells(df.filter("record_id > 1")).count() == 0
