"""Repeated lines, sentences and tokens, and other operators over the lines of a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.functions import text as X
from pageflow.functions.normalize import MAX_UNIT, MIN_RUN, arrow_function


def explode_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, line_no, line): one row per line."""
    return df.select(*keys, F.posexplode(F.split(X.or_empty(F.col(text)), r"\r\n|\r|\n")).alias("line_no", "line"))


def line_runs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines with ``run`` and ``run_length``: gaps and islands of equal lines, compared without markup, entities, case and marks at their edges."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    keyed = lines.withColumn("key", arrow_function("repeat_key")("line"))
    starts = F.when((F.col("key") == F.lag("key").over(order)) & (F.col("key") != ""), 0).otherwise(1)
    numbered = keyed.withColumn("_s", starts).withColumn("run", F.sum("_s").over(order)).drop("_s")
    return numbered.withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))


def repeated_runs(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, first_line, run_length, line): runs of three or more equal lines that are neither blank nor longer than a unit."""
    runs = line_runs(explode_lines(df, keys, text), keys)
    kept = runs.filter((F.col("run_length") >= MIN_RUN) & (F.col("key") != "") & (F.length(F.trim("line")) <= MAX_UNIT))
    return kept.groupBy(*keys, "run").agg(F.min("line_no").alias("first_line"), F.max("run_length").alias("run_length"), F.min_by("line", "line_no").alias("line")).drop("run")


def collapse_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, collapsed): the texts with each such run reduced to its first line."""
    runs = line_runs(explode_lines(df, keys, text), keys)
    first = F.row_number().over(Window.partitionBy(*keys, "run").orderBy("line_no"))
    kept = runs.withColumn("_rn", first).filter((F.col("_rn") == 1) | (F.col("run_length") < MIN_RUN) | (F.col("key") == "") | (F.length(F.trim("line")) > MAX_UNIT))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("collapsed"))


def line_classes(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, line_no, line_class): the Markdown class of every line."""
    return explode_lines(df, keys, text).select(*keys, "line_no", X.line_class(F.col("line")).alias("line_class"))
