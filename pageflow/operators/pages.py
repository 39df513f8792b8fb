"""Page results: deduplication, choice by priority, completeness, quality and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.functions import text as X

# Reasons for a retry, in the order in which they are given.
REASONS = {
    "filtered": "OCR parser filtered/cleaned invalid JSON",
    "fallback": "using Markdown fallback instead of layout JSON",
    "phrase": "suspicious hallucinated placeholder text",
    "dots": "overlong dot leader hallucination; MinerU batched quality retry needed",
    "pseudotext": "high repeated pseudo text; MinerU batched quality retry needed",
}
CHUNK_PAGES, RETRY_BATCH = 60, 24
#: Pages of a file that are ranked together.
RANK_BLOCK = 1024


def first_loaded(pages: DataFrame) -> DataFrame:
    """One row of each natural key (file, page, run): the first loaded, then the smallest id."""
    w = Window.partitionBy("file_id", "page_index", "run_no").orderBy("loaded_at", "page_result_id")
    return pages.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_run(pages: DataFrame) -> DataFrame:
    """One row of each page: the last run wins; ``n_runs`` tells how many there are."""
    page = Window.partitionBy("file_id", "page_index")
    ranked = first_loaded(pages).withColumns({"_rn": F.row_number().over(page.orderBy(F.desc("run_no"), "page_result_id")), "n_runs": F.count(F.lit(1)).over(page)})
    return ranked.filter("_rn = 1").drop("_rn")


def primary_text(c: str = "text") -> Column:
    """The text of a page: its own, else the fallback's, else the Markdown."""
    return X.first_filled(F.col(c), F.col("fallback_text"), F.col("md_nohf_text"))


def with_primary_text(pages: DataFrame) -> DataFrame:
    kind = F.when(X.or_empty(F.col("text")) != "", "text").when(X.or_empty(F.col("fallback_text")) != "", "fallback_text").when(X.or_empty(F.col("md_nohf_text")) != "", "md_nohf_text")
    return pages.withColumns({"primary_text": primary_text(), "primary_from": kind})


def text_metrics(df: DataFrame, text: str) -> DataFrame:
    """The columns raw_len, n_tokens, n_coords, n_hashes, top_count and n_distinct of a text column."""
    t = F.col("_tokens")
    return (
        df.withColumn("_tokens", X.tokens(F.col(text)))
        .withColumns({"raw_len": F.length(X.or_empty(F.col(text))), "n_tokens": F.size(t), "n_coords": X.coordinate_tokens(t), "n_hashes": F.regexp_count(X.or_empty(F.col(text)), F.lit("###")), "n_hash_tokens": X.hash_tokens(t), "top_count": X.top_token_count(t), "n_distinct": F.size(F.array_distinct(t))})
        .drop("_tokens")
    )


def token_artifacts(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("token_artifact", X.is_token_artifact(F.col("n_tokens"), F.col("n_coords"), F.col("n_hash_tokens"), F.col("top_count"), F.col("n_distinct")))


def retry_reasons(pages: DataFrame) -> DataFrame:
    """(…, reasons): every reason for which a page should be read again, in fixed order, each once."""
    body = X.or_empty(F.col("text"))
    fallback = X.or_empty(F.col("fallback_text"))
    rules = [
        (F.col("needs_retry") & F.col("retry_reason").isNull(), "filtered"),
        ((fallback != "") & (body == ""), "fallback"),
        (X.has_suspicious_phrase(body), "phrase"),
        (X.has_dot_explosion(body) | X.has_dot_explosion(fallback), "dots"),
        ((F.col("raw_len") >= X.PSEUDOTEXT_MIN_CHARS) & ((F.col("n_coords") >= X.PSEUDOTEXT_MIN_COORDS) | (F.col("n_hashes") >= X.PSEUDOTEXT_MIN_HASHES)), "pseudotext"),
    ]
    found = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(REASONS[name])) for rule, name in rules])
    return text_metrics(pages, "text").withColumn("reasons", F.filter(found, lambda r: r.isNotNull()))


def append_reason(reasons: Column, reason: str) -> Column:
    """A set of reasons with one more; a reason that is there isn't added again."""
    return F.array_union(F.coalesce(reasons, F.array().cast("array<string>")), F.array(F.lit(reason)))


def page_domain(files: DataFrame) -> DataFrame:
    """(file_id, page_index): all pages that the files should have."""
    return files.filter("page_count > 0").select("file_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_index"))


def coverage_manifest(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, n_expected, n_covered, n_missing, n_beyond, coverage_hash) of each file.

    The page domain is full-outer joined with the pages present; the hash is of
    the sorted, 1-based list of the pages covered.
    """
    present = pages.select("file_id", "page_index").distinct().withColumn("here", F.lit(1))
    both = page_domain(files).withColumn("wanted", F.lit(1)).join(present, ["file_id", "page_index"], "full_outer")
    by = both.groupBy("file_id").agg(
        F.count("wanted").alias("n_expected"),
        F.count(F.when(F.col("wanted").isNotNull() & F.col("here").isNotNull(), 1)).alias("n_covered"),
        F.count(F.when(F.col("wanted").isNotNull() & F.col("here").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("wanted").isNull(), 1)).alias("n_beyond"),
        F.array_sort(F.collect_list(F.when(F.col("wanted").isNotNull() & F.col("here").isNotNull(), F.col("page_index") + 1))).alias("_pages"),
    )
    return by.select("file_id", "n_expected", "n_covered", "n_missing", "n_beyond", F.sha2(F.array_join("_pages", ","), 256).alias("coverage_hash"))


def priority_merge(pages: DataFrame) -> DataFrame:
    """(page_result_id, final_text, final_from): a page's result by priority.

    A page that needs no retry keeps its text; otherwise the text layer is
    taken, else the fallback, else the page is left to its image.
    """
    good = ~F.coalesce("needs_retry", F.lit(False)) & (X.or_empty(F.col("text")) != "")
    steps = [(good, "text"), (X.or_empty(F.col("source_text")) != "", "source_text"), (X.or_empty(F.col("fallback_text")) != "", "fallback_text")]
    text, kind = F.when(steps[0][0], F.col(steps[0][1])), F.when(steps[0][0], F.lit(steps[0][1]))
    for rule, name in steps[1:]:
        text, kind = text.when(rule, F.col(name)), kind.when(rule, F.lit(name))
    return pages.select("page_result_id", text.alias("final_text"), kind.otherwise("image").alias("final_from"))


def suppress_blank(pages: DataFrame) -> DataFrame:
    """(page_result_id, blank, cleared_text): a page whose source has no text and whose own text is nothing or the font-test sentence is cleared."""
    nothing = F.trim(X.or_empty(F.col("source_text"))) == ""
    own = X.or_empty(primary_text())
    blank = nothing & ((F.trim(own) == "") | X.is_font_test_text(own))
    return pages.select("page_result_id", blank.alias("blank"), F.when(~blank, own).alias("cleared_text"))


def chunk_plan(files: DataFrame, pages_each: int = CHUNK_PAGES) -> DataFrame:
    """(file_id, chunk_no, start_page, end_page): the files in chunks of whole pages."""
    starts = F.explode(F.sequence(F.lit(0), F.col("page_count") - 1, F.lit(pages_each))).alias("start_page")
    return files.filter("page_count > 0").select("file_id", "page_count", starts).select("file_id", F.floor(F.col("start_page") / pages_each).cast("int").alias("chunk_no"), "start_page", F.least(F.col("start_page") + pages_each, F.col("page_count")).alias("_stop")).select("file_id", "chunk_no", "start_page", (F.col("_stop") - 1).alias("end_page"))


def retry_batches(pages: DataFrame, size: int = RETRY_BATCH) -> DataFrame:
    """(file_id, page_index, batch_no, local_index): the pages of each file that need a retry, in batches; a blank page follows each.

    Pages are ranked within blocks of a file, and blocks by their counts, so that no file is sorted in one task.
    """
    bad = pages.filter("needs_retry").select("file_id", "page_index").distinct().withColumn("_block", F.floor(F.col("page_index") / RANK_BLOCK))
    counts = bad.groupBy("file_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file_id", "_block").orderBy("page_index")) - 1
    ranked = bad.withColumn("_own", own).join(counts.select("file_id", "_block", before.alias("_before")), ["file_id", "_block"]).withColumn("rn", F.col("_own") + F.col("_before"))
    return ranked.select("file_id", "page_index", F.floor(F.col("rn") / size).cast("int").alias("batch_no"), (F.col("rn") % size * 2).cast("int").alias("local_index"))


def with_chunk(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages with the chunk that holds them: an equi join on the chunk's number, not a range join."""
    return pages.withColumn("chunk_no", F.floor(F.col("page_index") / CHUNK_PAGES).cast("int")).join(plan, ["file_id", "chunk_no"])


def offset_pages(results: DataFrame, offset: Column) -> DataFrame:
    """Results of a chunk with the page numbers of the whole file."""
    return results.withColumn("page_index", F.col("page_index") + offset)


def issue_rules() -> list[tuple[str, Column]]:
    """The quality issues of a page as rules over its columns; a caller may add its own."""
    text = X.or_empty(primary_text())
    pseudo = (F.col("raw_len") >= X.PSEUDOTEXT_MIN_CHARS) & ((F.col("n_coords") >= X.PSEUDOTEXT_MIN_COORDS) | (F.col("n_hashes") >= X.PSEUDOTEXT_MIN_HASHES))
    return [
        ("page_range_retry", F.col("run_no") > 1),
        ("high_repeated_pseudotext", pseudo),
        ("retry_still_needed", F.coalesce("needs_retry", F.lit(False))),
        ("markdown_fallback_only", (X.or_empty(F.col("fallback_text")) != "") & (X.or_empty(F.col("text")) == "")),
        ("font_test_pangram", X.is_font_test_text(text)),
        ("radical_chars_in_ocr_text", X.has_radicals(text)),
        ("control_chars_in_ocr_text", X.has_control_chars(text)),
        ("suspicious_placeholder_text", X.has_suspicious_phrase(text)),
        ("very_low_text_nonblank_source", (text != "") & (F.length(F.trim(text)) < 12) & (F.trim(X.or_empty(F.col("source_text"))) != "")),
        ("blank_page_output_cleared", (F.trim(text) == "") & (F.trim(X.or_empty(F.col("source_text"))) == "")),
        ("latex_residue_in_text", X.has_latex_residue(text)),
        ("table_without_cell_rows", F.exists("cells", lambda c: (F.lower(c["category"]) == "table") & c["bbox"].isNull())),
        ("image_fallback_page", (F.trim(text) == "") & F.coalesce("needs_retry", F.lit(False))),
    ]


def issues(pages: DataFrame, extra: list[tuple[str, Column]] | None = None) -> DataFrame:
    """(page_result_id, file_id, page_no, issue): the issues as rows; page numbers count from 1."""
    rules = issue_rules() + (extra or [])
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules]), lambda c: c.isNotNull())
    return text_metrics(pages, "text").select("page_result_id", "file_id", (F.col("page_index") + 1).alias("page_no"), F.explode(found).alias("issue"))


def suspect_pages(pages: DataFrame) -> DataFrame:
    """(file_id, page_no, issues): the sorted issues of each page that has any, of all its results together."""
    return issues(pages).groupBy("file_id", "page_no").agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def status_counts(pages: DataFrame) -> DataFrame:
    """(file_id, completed, skipped, failed): how the pages of each file ended."""
    done = ~F.coalesce("needs_retry", F.lit(False)) & (X.or_empty(primary_text()) != "")
    empty = ~F.coalesce("needs_retry", F.lit(False)) & (X.or_empty(primary_text()) == "")
    return pages.groupBy("file_id").agg(F.count_if(done).alias("completed"), F.count_if(empty).alias("skipped"), F.count_if(F.coalesce("needs_retry", F.lit(False))).alias("failed"))
