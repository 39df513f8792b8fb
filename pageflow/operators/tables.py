"""Tables in text: rows and cells, tables of contents, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import text as X

# Patterns of table markup.
ROW, CELL = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
RULE = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def cell_text(c: Column) -> Column:
    """A table cell without tags, its common entities read and its blanks squeezed."""
    plain = X.replace_all(c, [(r"(?is)<br\s*/?>", "\n"), (r"(?is)<[^>]+>", ""), *_ENTITIES])
    return F.trim(F.regexp_replace(plain, r"[ \t\r\f\x0B]+", " "))


def html_rows(text: Column) -> Column:
    """The rows of HTML tables as arrays of cells, those without a filled cell left out."""
    rows = F.transform(F.regexp_extract_all(X.or_empty(text), F.lit(ROW), 1), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), 1), cell_text))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def pipe_rows(text: Column) -> Column:
    """The rows of pipe tables as arrays of filled cells."""
    lines = F.filter(F.split(X.or_empty(text), r"\n"), lambda x: F.trim(x).contains("|") & ~F.trim(x).rlike(RULE))
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    return F.filter(cells, lambda r: F.size(r) >= 2)


def table_rows(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, row_no, cells, nonempty, first_col, col_count, source): HTML rows if there are any, else pipe rows."""
    h = html_rows(F.col(text))
    both = df.filter(F.col(text).contains("<t") | F.col(text).contains("|")).withColumn("_h", h)
    rows = both.select(*keys, F.when(F.size("_h") > 0, "html").otherwise("plain").alias("source"), F.when(F.size("_h") > 0, F.col("_h")).otherwise(pipe_rows(F.col(text))).alias("_rows"))
    one = rows.select(*keys, "source", F.posexplode("_rows").alias("row_no", "cells"))
    full = F.filter("cells", lambda c: c != "")
    first = F.array_position(F.transform("cells", lambda c: c != ""), True) - 1
    return one.select(*keys, "row_no", "cells", full.alias("nonempty"), first.cast("int").alias("first_col"), F.size("cells").alias("col_count"), "source")


def contents_tables(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows, n_usable, n_page_like, is_toc): a table of contents has two rows or more, and 60 % of those with two cells end in a page number."""
    usable = F.size("nonempty") >= 2
    page = usable & X.is_page_number_like(F.element_at("nonempty", -1))
    by = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(usable).alias("n_usable"), F.count_if(page).alias("n_page_like"))
    return by.withColumn("is_toc", (F.col("n_rows") >= 2) & (F.col("n_usable") > 0) & (F.col("n_page_like") * 5 >= F.col("n_usable") * 3))


def row_level(nonempty: Column, first_col: Column, source: Column) -> Column:
    """The indent level of a row: its first filled column, or its numbering style."""
    t = F.trim(nonempty[0])
    return F.when((source == "html") & (first_col > 0), F.least(F.lit(3), first_col)).when(t.rlike(r"^[a-z]\."), 2).when(t.rlike(r"^[IVX]+\."), 1).otherwise(0)


def to_markdown(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, markdown): each table as a pipe table, padded to its widest row, the first row as the head."""
    width = F.max("col_count")
    lines = F.array_sort(F.collect_list(F.struct("row_no", "cells")))
    by = rows.groupBy(*keys).agg(width.alias("_w"), lines.alias("_l"))

    def line(cells: Column, w: Column) -> Column:
        padded = F.transform(F.sequence(F.lit(1), w), lambda i: F.coalesce(F.get(cells, i - 1), F.lit("")))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("_w")))
    body = F.transform("_l", lambda r: line(r["cells"], F.col("_w")))
    return by.select(*keys, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 1 << 20)), "\n").alias("markdown"))
