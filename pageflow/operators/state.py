"""Fingerprints, file lists and incremental reuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_json(columns: Sequence[str]) -> Column:
    """The columns as JSON with sorted keys, nulls kept out: the form that is hashed."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def identity_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def with_checksum(df: DataFrame, columns: Sequence[str], name: str = "checkpoint_sha256") -> DataFrame:
    """Rows with a checksum of the given columns; a column of that name must not exist."""
    if name in df.columns:
        raise ValueError(f"{name} is reserved")
    return df.withColumn(name, identity_hash(columns))


def verified(df: DataFrame, columns: Sequence[str], name: str = "checkpoint_sha256") -> DataFrame:
    """The rows whose checksum still holds; others are as if they weren't there."""
    return df.filter(F.col(name).eqNullSafe(identity_hash(columns))).drop(name)


def normalized_path(path: Column) -> Column:
    """A path in one style: forward slashes, no leading ./, lower-case suffix and folders as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/{2,}", "/"), r"^(?:\./)+", "")


def file_records(files: DataFrame) -> DataFrame:
    """(file_id, path, name, suffix, size_bytes, sha256): files by the parts of their paths."""
    path = normalized_path(F.col("file_path"))
    return files.select("file_id", path.alias("path"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("suffix"), "size_bytes", "sha256")


def registered_again(files: DataFrame) -> DataFrame:
    """(sha256, first_file_id, n_files, file_ids): contents that are registered more than once."""
    by = files.filter("sha256 is not null").groupBy("sha256").agg(F.min("file_id").alias("first_file_id"), F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list("file_id")).alias("file_ids"))
    return by.filter("n_files > 1")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The work that isn't done: a left anti join on the identity."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def reusable(state: DataFrame, current: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """(keys, reuse): a completed state may be reused if all identity columns are equal, null with null."""
    renamed = state.select(*keys, "status", *[F.col(c).alias(f"_{c}") for c in identity])
    same = F.col("status") == "completed"
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return current.join(renamed, list(keys), "left").select(*keys, F.coalesce(same, F.lit(False)).alias("reuse"))


def content_fingerprints(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, sha256, n_chars): the fingerprint of every text."""
    return df.select(id_col, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"))


def manifest(files: DataFrame, group: str) -> DataFrame:
    """(group, n_files, digest): one digest of the sorted (path, size, sha256) of each group."""
    entry = F.concat_ws("\t", "path", F.coalesce(F.col("size_bytes").cast("string"), F.lit("")), F.coalesce("sha256", F.lit("")))
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("digest"))


def newest(files: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """The newest row of each key; equal times go by the largest path."""
    w = Window.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last(), F.col("path").desc())
    return files.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
