"""Checks of finished pages: one scan, whose metrics all rules read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import text as X

# Marks of Markdown that should not be left in finished text.
MARKDOWN = r"\*\*[^*\n]+\*\*|__[^_\n]+__|~~[^~\n]+~~|(?m)^#{1,6}\s|```|\[[^\]\n]+\]\([^)\n]+\)"
SNIPPETS, MARKS = 4, 5


def scan(artifact: DataFrame, text: str = "text", has_image: Column | None = None) -> DataFrame:
    """Artifact rows with n_chars, has_image, radicals, controls, latex (first four with their surroundings) and markdown (first five)."""
    t = X.or_empty(F.col(text))
    return artifact.withColumns(
        {
            "n_chars": F.length(F.regexp_replace(t, r"\s+", "")),
            "has_image": F.lit(False) if has_image is None else has_image,
            "radicals": F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(X.RADICALS), 0))),
            "controls": F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(X.CONTROLS), 0))),
            "latex": F.slice(F.regexp_extract_all(t, F.lit(rf"(?s).{{0,45}}(?:{X.LATEX_RESIDUE}).{{0,45}}"), 0), 1, SNIPPETS),
            "markdown": F.slice(F.regexp_extract_all(t, F.lit(MARKDOWN), 0), 1, MARKS),
        }
    )


def failures(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, detail): the rules on single pages that fail."""
    rules = F.array(
        F.when(F.size("radicals") > 0, F.struct(F.lit("radical_chars").alias("rule"), F.array_join("radicals", " ").alias("detail"))),
        F.when(F.size("controls") > 0, F.struct(F.lit("control_chars").alias("rule"), F.size("controls").cast("string").alias("detail"))),
        F.when(F.size("latex") > 0, F.struct(F.lit("latex_residue").alias("rule"), F.get("latex", F.lit(0)).alias("detail"))),
        F.when(F.size("markdown") > 0, F.struct(F.lit("suspected_markdown").alias("rule"), F.array_join("markdown", " ").alias("detail"))),
    )
    return scanned.select(*keys, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select(*keys, "r.rule", "r.detail")


def page_count_mismatches(source: DataFrame, scanned: DataFrame) -> DataFrame:
    """(file_id, expected, actual): files whose artifact has another number of pages than their source."""
    actual = scanned.groupBy("file_id").agg(F.countDistinct("page_index").alias("actual"))
    both = source.filter("page_count is not null").select("file_id", F.col("page_count").cast("bigint").alias("expected")).join(actual, "file_id", "left")
    return both.select("file_id", "expected", F.coalesce("actual", F.lit(0)).alias("actual")).filter("expected <> actual")


def not_blank(scanned: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed pages that should be blank and aren't."""
    return scanned.join(listed, ["file_id", "page_index"], "left_semi").filter((F.col("n_chars") > 0) | F.col("has_image"))


def without_image(scanned: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed pages that should have an image and have none."""
    return listed.join(scanned.filter("has_image").select("file_id", "page_index"), ["file_id", "page_index"], "left_anti")


def with_raster(scanned: DataFrame) -> DataFrame:
    """Pages of a text variant that hold an image."""
    return scanned.filter("has_image")


def completed(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, page_index, kind): every page that a file should have, as its result, blank or its image.

    The page domain is left joined with the results: a page without any, or
    with an unusable one, is blank if its source is, else shown as its image.
    """
    from pageflow.operators.pages import page_domain, primary_text

    own = pages.select("file_id", "page_index", X.or_empty(primary_text()).alias("own"), F.trim(X.or_empty(F.col("source_text"))).alias("src"), F.coalesce("needs_retry", F.lit(False)).alias("bad"))
    j = page_domain(files).join(own, ["file_id", "page_index"], "left")
    usable = F.col("own").isNotNull() & (F.trim("own") != "") & ~F.col("bad") & ~X.is_font_test_text(F.col("own"))
    kind = F.when(usable, "result").when(F.col("own").isNull(), "missing_image").when(F.col("src") == "", "blank").otherwise("unusable_image")
    return j.select("file_id", "page_index", kind.alias("kind"))
