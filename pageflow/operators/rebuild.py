"""Pages and books as Markdown, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import text as X
from pageflow.operators.cells import block_cells


def block_markdown(category: Column, content: Column) -> Column:
    """A block's Markdown by its category; headers, footers and pictures have none."""
    t = F.trim(content)
    return (
        F.when(category.isin("Page-header", "Page-footer", "Picture"), None)
        .when(category == "Title", F.concat(F.lit("# "), t))
        .when(category == "Section-header", F.concat(F.lit("## "), t))
        .when(category == "List-item", F.concat(F.lit("- "), t))
        .when(category == "Caption", F.concat(F.lit("*"), t, F.lit("*")))
        .when(category == "Formula", F.concat(F.lit("$$\n"), t, F.lit("\n$$")))
        .otherwise(t)
    )


def page_markdown(blocks: DataFrame) -> DataFrame:
    """(file_id, page_index, markdown): the blocks of each page, joined by blank lines."""
    cells = block_cells(blocks).withColumn("md", block_markdown(F.col("category"), F.col("content"))).filter("md <> ''")
    return cells.groupBy("file_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_ord", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))


def prefer_page_markdown(pages: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(file_id, page_index, markdown): a page's own Markdown wins over the rebuilt one."""
    own = pages.select("file_id", "page_index", "md_nohf_text")
    return own.join(rebuilt, ["file_id", "page_index"], "full_outer").select("file_id", "page_index", X.first_filled(F.col("md_nohf_text"), F.col("markdown")).alias("markdown"))


#: Pages of a book that are joined to one row, so that no book is one value.
PART_PAGES = 60


def book_markdown(page_md: DataFrame, pages_each: int = PART_PAGES) -> DataFrame:
    """(file_id, part_no, n_pages, markdown): the non-blank pages of each part of a file, joined by blank lines, with a final line end."""
    filled = page_md.filter(F.trim("markdown") != "").withColumn("part_no", F.floor(F.col("page_index") / pages_each).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", F.trim("markdown").alias("md")))), lambda x: x["md"]), "\n\n")
    return filled.groupBy("file_id", "part_no").agg(F.count(F.lit(1)).alias("n_pages"), F.concat(joined, F.lit("\n")).alias("markdown"))
