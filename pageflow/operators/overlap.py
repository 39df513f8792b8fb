"""Content of one page that leaked from the pages after it.

A band join: page *p* is compared with its next five pages.  The band is cut into
blocks of pages of one file, so that a hot file is many small groups.  Texts are
compared by their distinct runs of 16 characters, as hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import text as X
from pageflow.functions.normalize import arrow_function

# Limits of the comparison.
LOOKAHEAD, NGRAM = 5, 16
BLOCK = 60
MIN_SOURCE, MIN_NEIGHBOR = 120, 500
MIN_LENGTH_RATIO, MIN_COVERAGE = (5, 4), (3, 5)
RETRY_MIN_OWN, RETRY_MAX_RATIO = (1, 2), (27, 20)


def page_keys(pages: DataFrame, text: Column | None = None, source: Column | None = None) -> DataFrame:
    """(file_id, page_index, out_key, src_key): the compared forms of a page's result and of its source."""
    key = arrow_function("overlap_text")
    out = key(F.col("text") if text is None else text)
    src = key(F.coalesce("source_text", "text") if source is None else source)
    return pages.select("file_id", "page_index", out.alias("out_key"), src.alias("src_key"))


def gram_codes(key: str, size: int = NGRAM) -> np.ndarray:
    """The distinct runs of *size* characters of a key as sorted 64-bit hashes."""
    codes = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.empty(0, np.uint64)
    mixed = codes * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x100000001B3) + mixed[i : i + len(out)]
    out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0x9E3779B97F4A7C15))


_OVERLAPS = "file_id bigint, page_index int, target_page int, shared int, total int, out_chars int, src_chars int, target_chars int"


def forward_overlaps(keys: DataFrame, gated: bool = True) -> DataFrame:
    """(file_id, page_index, target_page, shared, total, out_chars, src_chars, target_chars): runs of a later page's source that stand in a page's result.

    Pages are grouped by file and block of ``BLOCK`` pages; the first pages of a
    block also go to the block before it, so a group sees all that its pages are
    compared with, no group grows with the file, and each page is shuffled about
    once and hashed once.  With *gated*, only pairs whose lengths make a leak
    possible are compared.
    """
    own = F.floor(F.col("page_index") / BLOCK)
    blocks = F.when((F.col("page_index") % BLOCK < LOOKAHEAD) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low = int(key[1]) * BLOCK
        group = group.sort_values("page_index", kind="stable")
        index, out_key, src_key = (group[c].tolist() for c in ("page_index", "out_key", "src_key"))
        out, src = ({} for _ in range(2))
        rows = []
        for i, p in enumerate(index):
            n_out, n_src = len(out_key[i]), len(src_key[i])
            if not low <= p < low + BLOCK or gated and (n_src < MIN_SOURCE or n_out * MIN_LENGTH_RATIO[1] <= n_src * MIN_LENGTH_RATIO[0]):
                continue
            for j in range(i + 1, len(index)):
                if index[j] > p + LOOKAHEAD:
                    break
                if index[j] == p or gated and len(src_key[j]) < MIN_NEIGHBOR:
                    continue
                if i not in out:
                    out[i] = gram_codes(out_key[i])
                if j not in src:
                    src[j] = gram_codes(src_key[j])
                shared = len(np.intersect1d(src[j], out[i], assume_unique=True))
                rows.append((key[0], p, index[j] + 1, shared, len(src[j]), n_out, n_src, len(src_key[j])))
        return pd.DataFrame(rows, columns=["file_id", "page_index", "target_page", "shared", "total", "out_chars", "src_chars", "target_chars"])

    return keys.withColumn("_block", F.explode(blocks)).groupBy("file_id", "_block").applyInPandas(compare, _OVERLAPS)


def leaks(overlaps: DataFrame) -> DataFrame:
    """The overlaps that cover at least 60 % of the later page, shares compared as whole numbers."""
    return overlaps.filter((F.col("total") > 0) & (F.col("shared") * MIN_COVERAGE[1] >= F.col("total") * MIN_COVERAGE[0]))


def leaking_pages(keys: DataFrame) -> DataFrame:
    """(file_id, page_index, targets): each leaking page with its matches, by page."""
    match = F.struct("target_page", "shared", "total", "out_chars", "src_chars", "target_chars")
    return leaks(forward_overlaps(keys)).groupBy("file_id", "page_index").agg(F.array_sort(F.collect_list(match)).alias("targets"))


def page_local(retries: DataFrame, leaking: DataFrame) -> DataFrame:
    """(file_id, page_index, page_local): whether a retry holds its own page and no later one.

    At least half of its source's runs, at most 1.35 times its source's length,
    and no leak.
    """
    own = X.ngrams(F.col("src_key"), NGRAM)
    shared = F.size(F.array_intersect(own, X.ngrams(F.col("out_key"), NGRAM)))
    near = (shared * RETRY_MIN_OWN[1] >= F.size(own) * RETRY_MIN_OWN[0]) & (F.length("out_key") * RETRY_MAX_RATIO[1] <= F.length("src_key") * RETRY_MAX_RATIO[0])
    flagged = leaking.select("file_id", "page_index", F.lit(True).alias("_leaks"))
    return retries.join(flagged, ["file_id", "page_index"], "left").select("file_id", "page_index", (near & F.col("_leaks").isNull()).alias("page_local"))


def repair(pages: DataFrame, retries: DataFrame, leaking: DataFrame) -> DataFrame:
    """(file_id, page_index, repaired_text, repaired_from) of the leaking pages: a page-local retry, else the text layer, else the image.

    *retries* has (file_id, page_index, retry_text, page_local).
    """
    source = X.or_empty(F.col("source_text"))
    both = leaking.select("file_id", "page_index").join(pages, ["file_id", "page_index"]).join(retries, ["file_id", "page_index"], "left")
    local = F.coalesce("page_local", F.lit(False))
    usable = F.length(arrow_function("overlap_text")(source)) >= MIN_SOURCE
    return both.select("file_id", "page_index", F.when(local, F.col("retry_text")).when(usable, source).alias("repaired_text"), F.when(local, "retry").when(usable, "source_text").otherwise("image").alias("repaired_from"))
