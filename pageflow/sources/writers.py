"""Writers: Markdown books, quality reports, batch summaries and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.operators.state import with_checksum


def write_books(books: DataFrame, folder: str) -> None:
    """One folder for each book, named by its id; its parts stand in order in one text file, as rows and never as one value."""
    ordered = books.repartition("file_id").sortWithinPartitions("file_id", "part_no")
    ordered.select("file_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("file_id").text(folder)


def quality_reports(suspects: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_id, report): each file's report as JSON: its coverage and its suspect pages in order."""
    pages = suspects.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "issues"))).alias("suspect_pages"))
    both = manifest.join(pages, "file_id", "left")
    body = F.struct("file_id", "n_expected", "n_covered", "n_missing", F.coalesce("suspect_pages", F.array().cast("array<struct<page_no:int,issues:array<string>>>")).alias("suspect_pages"))
    return both.select("file_id", F.to_json(body).alias("report"))


def write_reports(reports: DataFrame, folder: str) -> None:
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(folder)


def batch_summary(counts: DataFrame) -> DataFrame:
    """One row: the numbers of files completed, skipped and failed, and the status of the batch, with a checksum."""
    state = F.when(F.col("failed") > 0, "failed").when(F.col("completed") > 0, "completed").otherwise("skipped")
    by = counts.select(state.alias("s")).agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("completed", "skipped", "failed")])
    out = by.withColumn("status", F.when(F.col("failed") > 0, "completed_with_failures").otherwise("completed"))
    return with_checksum(out, ["completed", "skipped", "failed", "status"])
