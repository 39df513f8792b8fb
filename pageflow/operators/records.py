"""Layout records of uneven form: their page, the units of their boxes, their tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that name a record's page, those that count from 0 first, and limits.
FROM_ZERO, FROM_ONE = ("page_idx", "page_index", "page_id"), ("page_no", "page_number", "page")
RELATIVE_LIMIT = 1.5


def page_index_from_value(key: Column, value: Column, hint: Column) -> Column:
    """The page, counted from 0, that a key's value names; *hint* where the value is no whole number or the key is another."""
    n = F.when(value.rlike(r"^\s*[+-]?\d+(?:\.\d+)?\s*$"), F.trim(value).cast("double").cast("int"))
    own = F.when(key.isin(*FROM_ZERO), n).when(key.isin(*FROM_ONE), n - 1)
    return F.when(own.isNotNull(), F.greatest(F.lit(0), own)).otherwise(hint)


def page_index_of_record(record: Column, hint: Column) -> Column:
    """The page of a record given as JSON: by the first of the keys that it has, else *hint*."""
    members = F.from_json(record, "map<string,string>")
    out = hint
    for key in reversed(FROM_ZERO + FROM_ONE):
        out = F.when(F.map_contains_key(members, key), page_index_from_value(F.lit(key), members[key], hint)).otherwise(out)
    return F.when(members.isNull(), hint).otherwise(out)


def box_units(path: Column, box: Column) -> Column:
    """The units of a record's box by the file it comes from: thousandths, shares of the page, points, or unknown."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    small = F.coalesce(F.array_max(F.transform(box, F.abs)) <= RELATIVE_LIMIT, F.lit(False))
    return F.when(name.contains("content_list"), "mineru_1000").when(name.contains("model") & small, "relative").when(name.contains("middle"), "pdf")


_TABLE = "struct<html:string,blocks:array<struct<lines:array<struct<spans:array<struct<html:string>>>>>>>"


def table_html(record: Column) -> Column:
    """The HTML of a table's record given as JSON: its own, else that of its blocks' spans in order; empty if there is none."""
    t = F.from_json(record, _TABLE)
    spans = F.flatten(F.transform(F.flatten(F.transform(t["blocks"], lambda b: F.coalesce(b["lines"], F.array()))), lambda x: F.coalesce(x["spans"], F.array())))
    inner = F.array_join(F.filter(F.transform(spans, lambda s: F.trim(s["html"])), lambda h: h != ""), "\n")
    return F.coalesce(F.nullif(F.trim(t["html"]), F.lit("")), inner, F.lit(""))


def is_block(category: Column, box: Column, text: Column, html: Column) -> Column:
    """Whether a record is a block: it has a box, and text or, for a table, HTML."""
    content = F.when(category == "Table", F.coalesce(F.nullif(html, F.lit("")), text)).otherwise(text)
    return box.isNotNull() & (F.trim(F.coalesce(content, F.lit(""))) != "")
