"""Cells: the recognised pieces of a page, their categories, boxes and places.

A page result holds its cells as an array; a block table has one row per block.
Order is data: a cell's position in its array is kept as ``cell_ord``.
"""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.functions import geometry as G
from pageflow.functions import text as X

# Layout labels and the categories that they stand for.
CATEGORIES = {
    "caption": "Caption", "figure_caption": "Caption",
    "footnote": "Footnote", "page_footnote": "Footnote", "page-footnote": "Footnote",
    "formula": "Formula", "equation": "Formula", "interline_equation": "Formula", "isolate_formula": "Formula",
    "list": "List-item", "list-item": "List-item", "list_item": "List-item",
    "page-footer": "Page-footer", "page_footer": "Page-footer", "footer": "Page-footer", "page_number": "Page-footer",
    "page-header": "Page-header", "page_header": "Page-header", "header": "Page-header",
    "image": "Picture", "figure": "Picture", "picture": "Picture",
    "section-header": "Section-header", "section_header": "Section-header", "section title": "Section-header", "section_title": "Section-header", "paragraph_title": "Section-header",
    "table": "Table", "text": "Text", "plain_text": "Text", "paragraph": "Text", "title": "Title",
}
# Labels of the block recogniser.
BLOCK_LABELS = {
    "abstract": "Text", "algorithm": "Text", "aside_text": "Text", "chart": "Picture", "content": "Text", "display_formula": "Formula", "doc_title": "Title", "figure_caption": "Caption", "figure_title": "Caption", "footer": "Page-footer", "footnote": "Footnote", "formula": "Formula",
    "header": "Page-header", "image": "Picture", "inline_formula": "Formula", "list_item": "List-item", "number": "Page-footer", "paragraph_title": "Section-header", "reference": "Text", "table": "Table", "table_caption": "Caption", "text": "Text", "vertical_text": "Text",
}
KNOWN_CATEGORIES = ("Caption", "Footnote", "Formula", "List-item", "Page-footer", "Page-header", "Picture", "Section-header", "Table", "Text", "Title")
# Bounds of overlap and likeness.
COVERED_AREA, LINE_IN_BLOCK, LIKE_CHARS, SPAN_GAP = 0.45, 0.50, 30, 0.20


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(pairs.items()))])


def category(label: Column) -> Column:
    """The category of a layout label; unknown labels stay as they are, null is Text."""
    known = F.element_at(_lookup(CATEGORIES), F.lower(F.trim(label)))
    return F.when(label.isNull() | (F.trim(label) == ""), "Text").otherwise(F.coalesce(known, label))


def block_category(label: Column) -> Column:
    """The category of a block label; unknown labels are Text."""
    return F.coalesce(F.element_at(_lookup(BLOCK_LABELS), F.lower(F.trim(X.or_empty(label)))), F.lit("Text"))


def render_policy(cat: Column) -> Column:
    """How a category is shown: kept, skipped, drawn or as a table."""
    return F.when(cat.isin("Page-header", "Page-footer"), "skip in Markdown").when(cat == "Picture", "image only").when(cat == "Table", "table rows").when(cat == "Formula", "formula text").when(cat.isin("Title", "Section-header"), "heading").otherwise("text")


def explode_cells(pages: DataFrame) -> DataFrame:
    """(page_result_id, file_id, page_index, cell_ord, category, units, x0, y0, x1, y1, valid): one row per cell."""
    one = pages.select("page_result_id", "file_id", "page_index", F.posexplode("cells").alias("cell_ord", "cell"))
    box = F.col("cell.bbox")
    ok = G.normalized_bbox(box)
    return one.select("page_result_id", "file_id", "page_index", "cell_ord", category(F.col("cell.category")).alias("category"), F.col("cell.bbox_units").alias("units"), *[ok[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], ok.isNotNull().alias("valid"))


def block_cells(blocks: DataFrame) -> DataFrame:
    """Blocks as cells in reading order: by block order, else position, then top and left; empty ones only if pictures."""
    cat = block_category(F.col("block_label"))
    box = G.normalized_bbox(F.col("block_bbox"))
    kept = blocks.withColumns({"category": cat, "box": box, "content": X.or_empty(F.col("block_content"))}).filter((F.trim("content") != "") | (F.col("category") == "Picture"))
    order = Window.partitionBy("file_id", "page_index").orderBy(F.coalesce("block_order", "block_id"), F.col("box")[1].asc_nulls_last(), F.col("box")[0].asc_nulls_last(), "block_uid")
    return kept.withColumn("cell_ord", F.row_number().over(order) - 1)


def category_counts(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n_cells"))


def dedupe_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are equal to each other."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    w = Window.partitionBy(*names).orderBy(*order)
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", *names)


def rounded_key(box: Column) -> Column:
    """A box as text with two decimals, for keys."""
    return F.concat_ws(",", F.transform(box, lambda v: F.format_string("%.2f", v)))


def same_text(a: Column, b: Column) -> Column:
    """Whether two long texts, neither a page marker, contain one another."""
    plain = ~X.is_numeric_page_marker(a) & ~X.is_numeric_page_marker(b)
    return (F.length(a) >= LIKE_CHARS) & (F.length(b) >= LIKE_CHARS) & plain & (a.contains(b) | b.contains(a))


def uncovered(candidates: DataFrame, existing: DataFrame, page_keys: list[str]) -> DataFrame:
    """The candidates that no existing cell of their page covers (order-free anti join).

    Covered is: 45 % of the candidate's area, or one long text within the other.
    Both sides have ``box`` and ``content``.
    """
    e = existing.select(*[F.col(k).alias(f"_{k}") for k in page_keys], F.col("box").alias("_box"), F.col("content").alias("_content"))
    on = [F.col(k) == F.col(f"_{k}") for k in page_keys] + [(G.overlap_ratio(F.col("box"), F.col("_box")) >= COVERED_AREA) | same_text(F.col("content"), F.col("_content"))]
    return candidates.join(e, on, "left_anti")


def fill_holes(existing: DataFrame, supplement: DataFrame, page_keys: list[str]) -> DataFrame:
    """Supplement cells added in order where nothing covers them, cells added before included.

    The rule depends on the order, so each page is folded by itself; the groups
    are pages, whose size doesn't grow with the data.  Both sides have
    ``cell_ord``, ``box`` and ``content``.
    """
    columns = [*page_keys, "cell_ord", "box", "content"]
    both = existing.select(*columns, F.lit(0).alias("extra")).unionByName(supplement.select(*columns, F.lit(1).alias("extra")))

    def covered(box: list[float], content: str, cells: list[tuple]) -> bool:
        size = max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1])
        for b, t in cells:
            common = max(0.0, min(box[2], b[2]) - max(box[0], b[0])) * max(0.0, min(box[3], b[3]) - max(box[1], b[1]))
            if size > 0 and common / size >= COVERED_AREA:
                return True
            if len(t) >= LIKE_CHARS and len(content) >= LIKE_CHARS and not t.strip("[] ").isdigit() and not content.strip("[] ").isdigit() and (t in content or content in t):
                return True
        return False

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["extra", "cell_ord"], kind="stable")
        kept: list[tuple] = []
        keep = []
        for box, content, extra in zip(page["box"], page["content"], page["extra"], strict=True):
            box = list(box)
            ok = not extra or not covered(box, content or "", kept)
            keep.append(ok)
            if ok:
                kept.append((box, content or ""))
        return page[keep]

    return both.groupBy(*page_keys).applyInPandas(fold, both.schema)


def marker_bodies(blocks: DataFrame) -> DataFrame:
    """Markers ``[n]`` whose block holds a long body in a tiny box, each with the empty sibling that the body belongs to.

    The sibling is within three positions on the page, overlaps the marker's
    height by half and has eight times its area; the nearest one by position,
    then gap, then overlap is chosen.
    """
    base = block_cells_all(blocks)
    marked = base.filter(F.col("content").rlike(r"^\s*\[[0-9A-Za-z]{1,4}\]\s*\n?\s*\S[\s\S]{19,}") & F.col("box").isNotNull())
    empty = base.filter((F.trim("content") == "") & F.col("box").isNotNull()).select(F.col("file_id").alias("_f"), F.col("page_index").alias("_p"), F.col("block_uid").alias("sibling_uid"), F.col("pos").alias("_pos"), F.col("box").alias("_box"))
    high = F.least(F.col("box")[3], F.col("_box")[3]) - F.greatest(F.col("box")[1], F.col("_box")[1])
    overlap = high / (F.col("box")[3] - F.col("box")[1])
    gap = F.greatest(F.lit(0.0), F.col("_box")[0] - F.col("box")[2], F.col("box")[0] - F.col("_box")[2])
    on = (F.col("file_id") == F.col("_f")) & (F.col("page_index") == F.col("_p")) & (F.abs(F.col("pos") - F.col("_pos")) <= 3)
    pairs = marked.join(empty, on).filter((overlap >= 0.5) & (G.area(F.col("_box")) >= 8 * G.area(F.col("box"))))
    best = Window.partitionBy("block_uid").orderBy(F.abs(F.col("pos") - F.col("_pos")), gap, -overlap, "sibling_uid")
    return pairs.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("file_id", "page_index", "block_uid", "sibling_uid")


def block_cells_all(blocks: DataFrame) -> DataFrame:
    """All blocks with ``pos`` on their page, ``box`` and ``content``, empty ones included."""
    order = Window.partitionBy("file_id", "page_index").orderBy(F.coalesce("block_order", "block_id"), "block_uid")
    return blocks.withColumns({"box": G.normalized_bbox(F.col("block_bbox")), "content": X.or_empty(F.col("block_content")), "category": block_category(F.col("block_label"))}).withColumn("pos", F.row_number().over(order))


def next_flow_top(cells: DataFrame, page_keys: list[str]) -> DataFrame:
    """Each cell with the top of the nearest later one below it that it overlaps by 12 % of the width, headers, footers and markers left out."""
    flow = cells.filter(~F.col("category").isin("Page-header", "Page-footer") & ~X.is_numeric_page_marker(F.col("content")) & F.col("box").isNotNull())
    other = flow.select(*[F.col(k).alias(f"_{k}") for k in page_keys], F.col("block_uid").alias("_u"), F.col("box").alias("_b"))
    on = [F.col(k) == F.col(f"_{k}") for k in page_keys] + [F.col("_u") != F.col("block_uid"), F.col("_b")[1] > F.col("box")[1], G.horizontal_overlap(F.col("box")[0], F.col("box")[2], F.col("_b")[0], F.col("_b")[2]) >= 0.12]
    return flow.join(other, on, "left").groupBy(*page_keys, "block_uid").agg(F.min(F.col("_b")[1]).alias("next_top"))
