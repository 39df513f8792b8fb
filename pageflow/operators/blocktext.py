"""Text of lines and blocks from the flat tables of nested layout records, and the cells that they make.

Spans are joined in order; a space is put between two of them where the gap is
wider than a fifth of the line's height and both sides are Latin, Greek or
digits.  Lines that lie mostly outside their block are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.functions import geometry as G
from pageflow.functions import text as X
from pageflow.operators import cells, nested

_WORDLIKE = r"[A-Za-z0-9À-ɏͰ-Ͽ]"
#: Blocks that are kept of those that the recogniser discarded.
KEPT_DISCARDED = ("Footnote", "Page-header", "Page-footer")


def needs_gap(left: Column, right: Column) -> Column:
    """Whether two neighbouring texts need a space between them, by the characters that meet."""
    return left.rlike(_WORDLIKE + "$") & right.rlike("^" + _WORDLIKE)


def span_style(kind: Column) -> Column:
    return F.when(F.lower(X.or_empty(kind)).rlike("formula|equation"), "math").otherwise("text")


def line_texts(spans: DataFrame) -> DataFrame:
    """(record_id, line_path, line_text, n_spans, n_math): the spans of each line as one text."""
    w = Window.partitionBy("record_id", "parent_path").orderBy("ordinal")
    filled = spans.withColumn("t", X.first_filled(F.col("node_content"), F.col("node_text"), F.col("node_latex"), F.col("node_html"))).filter("t is not null")
    before, box = F.lag("t").over(w), F.lag("node_bbox").over(w)
    ok = G.normalized_bbox(F.col("node_bbox")).isNotNull() & G.normalized_bbox(box).isNotNull()
    wide = F.when(ok, (F.col("node_bbox")[0] - box[2]) > cells.SPAN_GAP * (box[3] - box[1])).otherwise(F.lit(True))
    joined = filled.withColumn("piece", F.when(before.isNotNull() & needs_gap(before, F.col("t")) & wide, F.concat(F.lit(" "), F.col("t"))).otherwise(F.col("t")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "piece")))
    return joined.groupBy("record_id", F.col("parent_path").alias("line_path")).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("line_text"), F.count(F.lit(1)).alias("n_spans"), F.count_if(span_style(F.col("node_type")) == "math").alias("n_math"))


def block_texts(blocks: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, block_path, block_text, n_lines): the lines of each block that lie in it by half, by line ends."""
    own = lines.join(texts, (lines.record_id == texts.record_id) & (lines.node_path == texts.line_path)).select(lines.record_id, lines.parent_path, lines.ordinal, lines.node_bbox.alias("line_box"), "line_text")
    b = blocks.select(F.col("record_id").alias("_r"), F.col("node_path").alias("block_path"), F.col("node_bbox").alias("block_box"))
    j = own.join(b, (F.col("record_id") == F.col("_r")) & (F.col("parent_path") == F.col("block_path")))
    line_box, block_box = G.normalized_bbox(F.col("line_box")), G.normalized_bbox(F.col("block_box"))
    inside = line_box.isNull() | block_box.isNull() | (G.overlap_ratio(line_box, block_box) >= cells.LINE_IN_BLOCK)
    kept = j.filter(inside & (F.trim("line_text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "line_text")))
    return kept.groupBy("record_id", "block_path").agg(F.array_join(F.transform(ordered, lambda x: x["line_text"]), "\n").alias("block_text"), F.count(F.lit(1)).alias("n_lines"))


def record_cells(records: DataFrame) -> DataFrame:
    """(record_id, page_path, page_index, container, category, content, box, cell_path): the cells of each record's pages.

    Blocks with text of their own become cells: those of ``para_blocks``, of
    ``discarded_blocks`` only notes, headers and footers, of ``preproc_blocks``
    only what no other cell of the page covers.
    """
    tagged = nested.emit_tagged(records)
    pages, blocks, lines, spans = (nested.typed_table(tagged, t) for t in ("pages", "blocks", "lines", "spans"))
    texts = block_texts(blocks, lines, line_texts(spans))
    page = F.regexp_extract("node_path", r"^(\w+\[\d+\])", 1)
    top = F.regexp_extract("node_path", r"^\w+\[\d+\]\.(\w+)\[", 1)
    numbered = pages.select("record_id", F.col("node_path").alias("page_path"), F.coalesce("node_page_idx", "ordinal").alias("page_index"))
    made = blocks.withColumns({"page_path": page, "top": top}).join(texts, (blocks.record_id == texts.record_id) & (F.col("node_path") == F.col("block_path"))).select(blocks.record_id, "page_path", F.col("top").alias("container"), cells.category(F.col("node_type")).alias("category"), F.col("block_text").alias("content"), G.normalized_bbox(F.col("node_bbox")).alias("box"), F.col("node_path").alias("cell_path"))
    known = made.filter((F.col("container") == "para_blocks") | ((F.col("container") == "discarded_blocks") & F.col("category").isin(*KEPT_DISCARDED)))
    spare = made.filter(F.col("container") == "preproc_blocks")
    added = cells.uncovered(spare, known, ["record_id", "page_path"])
    return known.unionByName(added).join(numbered, ["record_id", "page_path"])
