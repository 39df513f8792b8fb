"""Readers: layout JSON (whole, nested in text or cut off), JSON lines, Markdown, logs, file lists, page files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The kinds of layout files, by preference, and the log lines that tell of failures.
FILE_KINDS = (("middle", 0), ("model", 1), ("layout", 2), ("content", 3))
JSON_ERRORS = ("cells post process error", "JSON parsing failed", "Unterminated string", "Expecting value")
TRANSIENT = (
    "address already in use", "broken pipe", "cannot allocate memory", "connection aborted", "connection closed", "connection refused", "connection reset", "configured external mineru api is not healthy", "cuda error: unknown error", "database is locked",
    "engine core failed", "enginecore encountered a fatal error", "engine process failed", "enginecore failed", "enginedeaderror", "failed to start", "mineru api did not become healthy", "mineru api exited during startup", "mineru api restart limit exhausted",
    "nccl error", "port is already in use", "produced no stdout/stderr", "resource temporarily unavailable", "server disconnected", "service unavailable", "temporarily unavailable", "terminated by signal", "zmq.error",
)


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, size_bytes, modified): the files below a folder, without their content."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return listed.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def file_signatures(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size_bytes, sha256): the content signature of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def whole_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, text): each file as one row."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): Markdown files, those without headers and footers where a folder has any; three line ends or more as two."""
    found = whole_texts(spark, folder, "*.md").withColumn("dir", F.regexp_extract("path", r"(.*)/", 1)).withColumn("nohf", F.col("path").rlike(r"nohf[^/]*$"))
    best = found.withColumn("any", F.max("nohf").over(Window.partitionBy("dir"))).filter(F.col("nohf") | ~F.col("any"))
    return best.select("path", F.trim(F.regexp_replace("text", r"\n{3,}", "\n\n")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are left out."""
    return spark.read.schema(schema).json(path)


def repair_layout(text: str | None) -> str | None:
    """The one object of a layout list that was cut off, as JSON: its box, category and what there is of its text."""
    if not text or not text.lstrip().startswith("[{"):
        return None
    box = re.search(r'"bbox"\s*:\s*\[\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\]', text)
    category = re.search(r'"category"\s*:\s*"([^"]*)"', text)
    tail = re.search(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)', text, re.S)
    if not (box and category and tail):
        return None
    body = tail[1].rstrip("\\")
    try:
        body = json.loads(f'"{body}"', strict=False)
    except ValueError:
        body = body.replace("\\n", "\n").replace('\\"', '"')
    return json.dumps([{"bbox": [int(x) for x in box.groups()], "category": category[1], "text": body.strip()}], ensure_ascii=False)


def parsed_layout(texts: DataFrame) -> DataFrame:
    """(path, layout VARIANT, repaired): layout files; JSON within JSON text is read, a cut-off list is repaired."""

    @F.pandas_udf("string")
    def repaired(s: pd.Series) -> pd.Series:
        return s.map(lambda t: repair_layout(t) if isinstance(t, str) else None)

    once = F.try_parse_json("text")
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    direct = F.when(F.schema_of_variant(once) == "STRING", inner).otherwise(once)
    return texts.withColumn("_d", direct).withColumn("_r", F.when(F.col("_d").isNull(), repaired("text"))).select("path", F.coalesce("_d", F.try_parse_json("_r")).alias("layout"), F.col("_r").isNotNull().alias("repaired"))


def layout_kind(path: Column) -> Column:
    """The preference of a layout file by its name; the least is best."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    out = F.lit(10)
    for kind, rank in reversed(FILE_KINDS):
        out = F.when(name.contains(kind), rank).otherwise(out)
    return out


def select_layout_files(listed: DataFrame) -> DataFrame:
    """One family of layout files of each folder.

    All ``*_middle.json``; without any, all ``*_content_list.json`` of the first
    form; without any, all ``*_model.json``; else only the first file by the
    preference of its name and its path.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    family = F.when(name.endswith("_middle.json"), 0).when(name.endswith("_content_list.json") & ~name.contains("_content_list_v2"), 1).when(name.endswith("_model.json"), 2).otherwise(3)
    d = listed.withColumns({"_dir": F.regexp_extract("path", r"(.*)/", 1), "_family": family, "_kind": layout_kind(F.col("path"))})
    w = Window.partitionBy("_dir")
    best = d.withColumns({"_best": F.min("_family").over(w), "_rn": F.row_number().over(w.orderBy("_family", "_kind", "path"))})
    return best.filter((F.col("_family") == F.col("_best")) & ((F.col("_family") < 3) | (F.col("_rn") == 1))).drop("_dir", "_family", "_kind", "_best", "_rn")


def supplement_layout_files(listed: DataFrame) -> DataFrame:
    """The files that may fill holes: only ``*_middle.json``, whose spare blocks have a layout."""
    return listed.filter(F.regexp_extract("path", r"([^/]*)$", 1).endswith("_middle.json"))


def page_index_of(path: Column) -> Column:
    """The page of a file by its name, counted from 0; null if the name has none."""
    n = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)(?:page|p)[_-]?(\d+)", 1)
    return F.when(n != "", F.greatest(F.lit(0), n.cast("int") - 1))


def page_list(value: Column, page_count: Column) -> Column:
    """Pages given as "1,5", counted from 1, as sorted distinct indexes from 0; none given means all; others than the file's are an error."""
    given = F.array_sort(F.array_distinct(F.transform(F.split(value, r"\s*,\s*"), lambda x: F.trim(x).cast("int") - 1)))
    checked = F.when(F.exists(given, lambda i: i.isNull() | (i < 0) | (i >= page_count)), F.raise_error(F.concat(F.lit("pages out of range: "), value))).otherwise(given)
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.sequence(F.lit(0), page_count - 1)).otherwise(checked)


def log_failures(logs: DataFrame) -> DataFrame:
    """(path, n_cell_errors, json_errors, transient): what a log tells of a run."""
    text = F.col("text")
    low = F.lower(text)
    json_errors, transient = F.lit(False), F.lit(False)
    for p in JSON_ERRORS:
        json_errors = json_errors | text.contains(p)
    for p in TRANSIENT:
        transient = transient | low.contains(p)
    return logs.select("path", F.regexp_count(text, F.lit(JSON_ERRORS[0])).alias("n_cell_errors"), json_errors.alias("json_errors"), transient.alias("transient"))
