"""Boxes as Column expressions.  A box is an array of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, v))


def normalized_bbox(value: Column) -> Column:
    """Four numbers with a positive area, or the bounds of a polygon of eight or more numbers; else null."""
    four = F.when((F.size(value) == 4) & (value[2] > value[0]) & (value[3] > value[1]), value)
    xs = F.filter(value, lambda _, i: i % 2 == 0)
    ys = F.filter(value, lambda _, i: i % 2 == 1)
    polygon = F.when((F.size(value) >= 8) & (F.size(value) % 2 == 0), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    return F.when(F.exists(value, lambda x: x.isNull()), None).otherwise(F.coalesce(four, polygon))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    # greatest and least pass over nulls, so a missing box must be told apart.
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h))


def overlap_ratio(source: Column, target: Column) -> Column:
    """The share of *source* that lies in *target*; 0 for an empty source."""
    return F.when(area(source) > 0, intersection_area(source, target) / area(source)).otherwise(0.0)


def horizontal_overlap(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """The common width of two spans as a share of the narrower one."""
    common = F.greatest(F.lit(0.0), F.least(right_a, right_b) - F.greatest(left_a, left_b))
    narrow = F.least(right_a - left_a, right_b - left_b)
    return F.when(narrow > 0, common / narrow).otherwise(0.0)


def to_page(b: Column, units: Column, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> Column:
    """A box in page units, from its units or else from the size of its numbers, clamped to the page."""
    top = F.array_max(b)
    kind = F.coalesce(units, F.when(top <= 1.5, F.lit("relative")).when(top <= 1200, F.lit("mineru_1000")).otherwise(F.lit("image")))
    wide = F.when(kind == "relative", page_width).when(kind == "mineru_1000", page_width / 1000).when(kind == "image", page_width / image_width).otherwise(F.lit(1.0))
    high = F.when(kind == "relative", page_height).when(kind == "mineru_1000", page_height / 1000).when(kind == "image", page_height / image_height).otherwise(F.lit(1.0))
    return F.array(clamp(b[0] * wide, 0.0, page_width), clamp(b[1] * high, 0.0, page_height), clamp(b[2] * wide, 0.0, page_width), clamp(b[3] * high, 0.0, page_height))


def page_scale(page_height: Column) -> Column:
    return clamp(page_height / 842.0, 0.75, 5.0)


def inline_width(text: Column, size: Column) -> Column:
    """The estimated width of a text: ideographs one em, Latin letters and digits 0.55, others 0.45."""
    han = F.regexp_count(text, F.lit(r"[\u3400-\u9fff]"))
    latin = F.regexp_count(text, F.lit(r"[A-Za-z0-9]"))
    return size * (han * 1.0 + latin * 0.55 + (F.length(text) - han - latin) * 0.45)


def font_estimate(height: Column, lines: Column) -> Column:
    return height / (F.greatest(lines, F.lit(1)) * 1.2)
