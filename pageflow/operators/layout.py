"""Blocks on a page: sizes of fonts and lines, repairs of their categories and boxes, and whether they fit.

Widths are estimated from character classes; a caller with real font metrics
gives another width expression.  Everything but the reflow of overflowing pairs
is an expression or a window over the blocks of a page.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.functions import geometry as G
from pageflow.functions import text as X

# Bounds of fonts, lines and repairs, for a page of 842 points.
BODY_MIN, BODY_MAX, BODY_FLOOR, BODY_DEFAULT = 8.8, 11.8, 8.6, 10.8
MARGIN_X, MARGIN_Y = 0.09, 0.08
COMPRESSED_CHARS, COMPRESSED_WIDTH, COMPRESSED_GROWTH, COMPRESSED_FONT = 120, 0.45, 1.28, 0.72
FLOW_GAP, FLOW_OVERLAP, PAIR_OVERLAP = 4.0, 0.12, 0.20
NOTES_SHARE, NOTES_LEAST, NOTES_HEIGHT = 0.75, 8, 0.035
MIN_LINE = {"Title": 0.92, "Section-header": 0.90, "Table": 0.86, "Caption": 0.84, "Footnote": 0.80}
PREFERRED_LINE = {"Title": 1.15, "Section-header": 1.15, "Table": 1.12, "Caption": 1.15, "Footnote": 1.12}
PAGE = ["file_id", "page_index"]


def blocks(cells: DataFrame, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> DataFrame:
    """Cells of (file_id, page_index, cell_ord, category, content, box, units) as blocks with left, top, width and height of at least one point.

    Empty blocks stay only if they are formulas or tables; pictures need a box.
    """
    b = G.to_page(F.col("box"), F.col("units"), page_width, page_height, image_width, image_height)
    kept = cells.filter(F.col("box").isNotNull() & ((F.trim("content") != "") | F.col("category").isin("Formula", "Table", "Picture")))
    p = F.col("_b")
    return kept.withColumn("_b", b).withColumns({"left": p[0], "top": p[1], "width": F.greatest(F.lit(1.0), p[2] - p[0]), "height": F.greatest(F.lit(1.0), p[3] - p[1])}).drop("_b")


def fallback_block(pages: DataFrame, text: str, page_width: float, page_height: float) -> DataFrame:
    """One block with the text of a page that has no cells, within its margins."""
    return pages.filter(X.or_empty(F.col(text)) != "").select(*PAGE, F.lit(0).alias("cell_ord"), F.lit("Text").alias("category"), F.col(text).alias("content"), F.lit(page_width * MARGIN_X).alias("left"), F.lit(page_height * MARGIN_Y).alias("top"), F.lit(page_width * (1 - 2 * MARGIN_X)).alias("width"), F.lit(page_height * (1 - 2 * MARGIN_Y)).alias("height"))


def line_count(text: Column) -> Column:
    """The non-blank lines of a text, at least one."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(X.or_empty(text), "\n"), lambda x: F.trim(x) != "")))


def visual_lines(text: Column, width: Column, size: Column, measure: Callable[[Column, Column], Column] = G.inline_width) -> Column:
    """The lines of a text when wrapped to a width."""
    return F.aggregate(F.split(X.or_empty(text), "\n"), F.lit(0), lambda n, x: n + F.greatest(F.lit(1), F.ceil(measure(x, size) / F.greatest(width, F.lit(1.0)))).cast("int"))


def required_height(text: Column, width: Column, size: Column, line_height: Column) -> Column:
    return visual_lines(text, width, size) * size * line_height


def body_sizes(b: DataFrame, page_height: Column) -> DataFrame:
    """(file_id, page_index, body_size): the median of the long text blocks' clamped font estimates; a page without any has the default."""
    scale = G.page_scale(page_height)
    long = (F.col("category") == "Text") & (F.length("content") >= 80)
    estimate = G.clamp(G.font_estimate(F.col("height"), line_count(F.col("content"))), BODY_MIN * scale, BODY_MAX * scale)
    return b.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(long, estimate)), F.first(F.lit(BODY_DEFAULT) * scale)).alias("body_size"))


def note_number(text: Column) -> Column:
    """The number that a note begins with, as in ``12.`` or ``12)``."""
    return F.nullif(F.regexp_extract(X.or_empty(text), r"^\s*(\d{1,4})[.)]", 1), F.lit("")).cast("int")


def dense_note_pages(b: DataFrame, page_height: Column) -> DataFrame:
    """(file_id, page_index, n_blocks, n_numbered, n_rising, note_size): pages of dense numbered notes.

    Three quarters of the blocks or more are numbered, at least eight, three
    quarters of the neighbours rise, and the median height is low.
    """
    flow = b.filter(F.col("category").isin("Text", "List-item", "Footnote")).withColumn("no", note_number(F.col("content")))
    w = Window.partitionBy(*PAGE).orderBy("cell_ord")
    # The fold looks at the numbered blocks only; their neighbours are the numbered ones before them.
    numbered = flow.filter("no is not null").withColumn("rises", (F.col("no") > F.lag("no").over(w)).cast("int"))
    per = numbered.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_numbered"), F.coalesce(F.sum("rises"), F.lit(0)).alias("n_rising"), F.median("height").alias("m"))
    both = flow.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_blocks")).join(per, PAGE)
    dense = (F.col("n_numbered") >= NOTES_LEAST) & (F.col("n_numbered") * 4 >= F.col("n_blocks") * 3) & (F.col("n_rising") * 4 >= (F.col("n_numbered") - 1) * 3) & (F.col("m") <= page_height * NOTES_HEIGHT)
    return both.filter(dense).select(*PAGE, "n_blocks", "n_numbered", "n_rising", (F.col("m") / 1.2).alias("note_size"))


def is_misplaced_running_text(category: Column, text: Column, width: Column, body_size: Column, page_width: Column) -> Column:
    """A header or footer that is prose: long, and too wide for its box."""
    prose = X.or_empty(text).rlike(r"[.。;；,，]") | note_number(text).isNotNull()
    return category.isin("Page-header", "Page-footer") & (F.length(F.trim(text)) >= 36) & (G.inline_width(text, body_size) > width * 1.15) & (width < page_width) & prose


def repair_running_text(b: DataFrame, body: DataFrame, page_width: Column) -> DataFrame:
    """Blocks with such headers and footers as text, widened to the margins; ``repaired`` marks them."""
    j = b.join(body, PAGE)
    bad = is_misplaced_running_text(F.col("category"), F.col("content"), F.col("width"), F.col("body_size"), page_width)
    return j.withColumn("repaired", bad).withColumns({"category": F.when(bad, "Text").otherwise(F.col("category")), "left": F.when(bad, F.least(F.col("left"), page_width * MARGIN_X)).otherwise(F.col("left")), "width": F.when(bad, F.greatest(F.col("width"), page_width * (1 - 2 * MARGIN_X))).otherwise(F.col("width"))})


def with_fonts(b: DataFrame) -> DataFrame:
    """Blocks of (…, body_size) with font_size and line_height by their category."""
    size = G.font_estimate(F.col("height"), line_count(F.col("content")))
    body = F.col("body_size")
    font = (
        F.when(F.col("category") == "Title", G.clamp(size, body * 1.2, body * 2.4))
        .when(F.col("category") == "Section-header", G.clamp(size, body * 1.05, body * 1.8))
        .when(F.col("category").isin("Footnote", "Caption", "Table"), G.clamp(size, body * 0.55, body))
        .when(F.col("category").isin("Page-header", "Page-footer"), G.clamp(size, body * 0.6, body))
        .otherwise(G.clamp(size, F.least(body, F.lit(BODY_FLOOR)), body))
    )
    line = F.lit(1.2)
    for c, v in PREFERRED_LINE.items():
        line = F.when(F.col("category") == c, v).otherwise(line)
    return b.withColumns({"font_size": font, "line_height": line})


def expand_compressed(b: DataFrame, page_width: Column, page_height: Column) -> DataFrame:
    """Wide long text blocks that are far too low for their text grow into the free space below, up to the next block."""
    flow = b.filter(~F.col("category").isin("Page-header", "Page-footer") & ~X.is_numeric_page_marker(F.col("content")))
    other = flow.select(*[F.col(k).alias(f"_{k}") for k in PAGE], F.col("cell_ord").alias("_o"), F.col("left").alias("_l"), F.col("width").alias("_w"), F.col("top").alias("_t"))
    on = [F.col(k) == F.col(f"_{k}") for k in PAGE] + [F.col("_o") != F.col("cell_ord"), F.col("_t") > F.col("top"), G.horizontal_overlap(F.col("left"), F.col("left") + F.col("width"), F.col("_l"), F.col("_l") + F.col("_w")) >= FLOW_OVERLAP]
    below = b.select(*PAGE, "cell_ord", "top", "left", "width").join(other, on, "left").groupBy(*PAGE, "cell_ord").agg(F.min("_t").alias("next_top"))
    bottom = F.coalesce(F.col("next_top") - FLOW_GAP, page_height * 0.92)
    need = required_height(F.col("content"), F.col("width"), F.col("body_size"), F.lit(1.15))
    own = G.font_estimate(F.col("height"), visual_lines(F.col("content"), F.col("width"), F.col("body_size")))
    grow = (F.col("category") == "Text") & (F.length("content") >= COMPRESSED_CHARS) & (F.col("width") >= page_width * COMPRESSED_WIDTH) & (need > F.col("height") * COMPRESSED_GROWTH) & (own < F.col("body_size") * COMPRESSED_FONT)
    return b.join(below, [*PAGE, "cell_ord"]).withColumn("expanded", grow & (bottom - F.col("top") > F.col("height"))).withColumn("height", F.when(F.col("expanded"), F.least(need, bottom - F.col("top"))).otherwise(F.col("height")))


def font_candidates(start: Column, minimum: Column, step: float) -> Column:
    """Sizes from a start down to a minimum, which always ends them."""
    n = F.greatest(F.lit(0), F.floor((start - minimum) / step)).cast("int")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), n), lambda i: F.round(start - i * step, 4)), F.array(F.round(minimum, 4))))


def fitted(b: DataFrame, step: float = 0.4) -> DataFrame:
    """Blocks of (…, font_size, line_height) with the largest size at which the text fits its box, and ``fits``."""
    least = F.when(F.col("category").isin("Title", "Section-header"), F.col("font_size") * 0.6).otherwise(F.greatest(F.lit(4.0), F.col("font_size") * 0.5))
    ems = F.transform(F.split(X.or_empty(F.col("content")), "\n"), lambda x: G.inline_width(x, F.lit(1.0)))
    measured = b.withColumns({"_ems": ems, "_sizes": font_candidates(F.col("font_size"), least, step)})

    def height(s: Column) -> Column:
        rows = F.aggregate("_ems", F.lit(0), lambda n, em: n + F.greatest(F.lit(1), F.ceil(em * s / F.greatest(F.col("width"), F.lit(1.0)))).cast("int"))
        return rows * s * F.col("line_height")

    ok = F.filter("_sizes", lambda s: (F.col("category") == "Picture") | (height(s) <= F.col("height") + 0.01))
    return measured.withColumn("_ok", ok).withColumns({"fit_size": F.coalesce(F.get("_ok", F.lit(0)), F.element_at("_sizes", -1)), "fits": F.size("_ok") > 0}).drop("_ok", "_ems", "_sizes")


def fit_failures(b: DataFrame) -> DataFrame:
    """(file_id, page_index, failures): the blocks of each page that don't fit; such a page is shown as its image."""
    one = F.struct("cell_ord", "category", F.substring("content", 1, 120).alias("text"))
    return b.filter(~F.col("fits")).groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("failures"))


def reflow_pairs(b: DataFrame) -> DataFrame:
    """Blocks with the height of each that doesn't fit shared anew with the first later one below it.

    Two blocks that overlap in width by a fifth split the height of both in
    proportion to their needs.  A change moves the next pair's bounds, so each
    page is folded in reading order; pages don't grow with the data.
    """
    need = required_height(F.col("content"), F.col("width"), F.col("fit_size"), F.col("line_height"))
    sized = b.withColumn("need", need)

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("cell_ord", kind="stable").reset_index(drop=True)
        for i in range(len(page)):
            if page.at[i, "fits"]:
                continue
            for j in range(i + 1, len(page)):
                common = min(page.at[i, "left"] + page.at[i, "width"], page.at[j, "left"] + page.at[j, "width"]) - max(page.at[i, "left"], page.at[j, "left"])
                if page.at[j, "top"] <= page.at[i, "top"] or common < PAIR_OVERLAP * min(page.at[i, "width"], page.at[j, "width"]):
                    continue
                top, bottom = page.at[i, "top"], page.at[j, "top"] + page.at[j, "height"]
                share = page.at[i, "need"] / max(1e-6, page.at[i, "need"] + page.at[j, "need"])
                page.at[i, "height"] = (bottom - top) * share
                page.at[j, "top"] = top + page.at[i, "height"]
                page.at[j, "height"] = bottom - page.at[j, "top"]
                break
        return page

    return sized.groupBy(*PAGE).applyInPandas(fold, sized.schema)


def page_order(b: DataFrame) -> DataFrame:
    """Blocks in their final order: flow first, headers and footers last, by top, left and cell."""
    running = F.col("category").isin("Page-header", "Page-footer").cast("int")
    return b.withColumn("block_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy(running, "top", "left", "cell_ord")) - 1)
