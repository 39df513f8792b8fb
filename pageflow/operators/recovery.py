"""Recovery of pages whose recognition failed: merged retry blocks, safe margins, tables as text, images in place of debris."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import text as X
from pageflow.functions.normalize import append_with_overlap, texts_overlap
from pageflow.operators.pages import REASONS, append_reason, text_metrics
from pageflow.operators.state import identity_hash

# What may be merged or clamped, limits of nearness, and what is written.
MERGED = ("Text", "List-item", "Footnote", "Caption")
CLAMPED = ("Text", "List-item", "Footnote", "Caption", "Formula", "Table")
MIN_SIDE, MIN_DEPTH, TOUCHING, TOUCHING_SIDE = 0.20, 0.10, 4.0, 0.55
SAFE_MARGIN, LEAST_WIDTH = 0.065, 20.0
IMAGE_REASON = "high repeated pseudo text; source page image fallback"
ISOLATION = "blank-page-after-each-selected-page-v1"
BLOCK_SCHEMA = "file_id bigint, page_index int, block_no int, category string, text string, left double, top double, width double, height double, n_merged int"


def _should_merge(a: dict, b: dict) -> bool:
    if a["category"] not in MERGED or b["category"] not in MERGED:
        return False
    narrow = min(a["width"], b["width"])
    side = (min(a["left"] + a["width"], b["left"] + b["width"]) - max(a["left"], b["left"])) / narrow if narrow > 0 else 0.0
    if side < MIN_SIDE:
        return False
    depth = min(a["top"] + a["height"], b["top"] + b["height"]) - max(a["top"], b["top"])
    touching = b["top"] - a["top"] - a["height"] <= TOUCHING and side >= TOUCHING_SIDE
    return touching or depth > MIN_DEPTH * min(a["height"], b["height"]) or texts_overlap(a["text"], b["text"])


def _merged(a: dict, b: dict) -> dict:
    left, top = min(a["left"], b["left"]), min(a["top"], b["top"])
    right, bottom = (max(x[p] + x[s] for x in (a, b)) for p, s in (("left", "width"), ("top", "height")))
    return {"category": "Text", "text": append_with_overlap(a["text"], b["text"]), "left": left, "top": top, "width": right - left, "height": bottom - top, "n_merged": a["n_merged"] + b["n_merged"], "edge": a["edge"]}


def merge_blocks(blocks: Sequence[dict]) -> list[dict]:
    """The blocks of a page in reading order, each merged with the one before it as long as any two belong together."""
    done = sorted(blocks, key=lambda b: (b["edge"], b["top"], b["left"]))
    before = -1
    while before != len(done):
        before, kept = len(done), []
        for b in done:
            if kept and _should_merge(kept[-1], b):
                kept[-1] = _merged(kept[-1], b)
            else:
                kept.append(b)
        done = kept
    return done


def merge_retry_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of (file_id, page_index, category, text, left, top, width, height), those that belong together merged; a group is one page."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "text": r["text"] or "", "n_merged": 1, "edge": r["category"] in ("Page-header", "Page-footer")} for r in group.to_dict("records")]
        out = [(*key, i, b["category"], b["text"], b["left"], b["top"], b["width"], b["height"], b["n_merged"]) for i, b in enumerate(merge_blocks(rows))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return blocks.select("file_id", "page_index", "category", "text", "left", "top", "width", "height").groupBy("file_id", "page_index").applyInPandas(run, BLOCK_SCHEMA)


def clamp_to_margins(blocks: DataFrame, page_width: Column) -> DataFrame:
    """Blocks of retried pages kept within the safe part of the page, with ``clamped``; headers, footers and pictures stay."""
    low, high = page_width * SAFE_MARGIN, page_width * (1 - SAFE_MARGIN)
    right = F.col("left") + F.col("width")
    new_left = F.greatest(F.col("left"), low)
    new_right = F.least(right, high)
    new_right = F.when(new_right <= new_left + LEAST_WIDTH, F.least(high, new_left + F.greatest(F.lit(LEAST_WIDTH), F.col("width")))).otherwise(new_right)
    moves = F.col("category").isin(*CLAMPED) & ((new_left != F.col("left")) | (new_right != right))
    return blocks.withColumn("clamped", moves).withColumns({"width": F.when(F.col("clamped"), new_right - new_left).otherwise(F.col("width")), "left": F.when(F.col("clamped"), new_left).otherwise(F.col("left"))})


def tables_as_text(cells: Column) -> Column:
    """The cells of a page with every table made text."""
    return F.transform(cells, lambda c: c.withField("category", F.when(F.lower(F.trim(c["category"])) == "table", "Text").otherwise(c["category"])))


def degraded(pages: DataFrame) -> DataFrame:
    """(page_result_id, degraded, reasons, text): pages of repeated pseudotext left to their image, their text cleared and the reason noted."""
    m = text_metrics(pages, "text")
    pseudo = (F.col("raw_len") >= X.PSEUDOTEXT_MIN_CHARS) & ((F.col("n_coords") >= X.PSEUDOTEXT_MIN_COORDS) | (F.col("n_hashes") >= X.PSEUDOTEXT_MIN_HASHES))
    told = F.contains(X.or_empty(F.col("retry_reason")), F.lit(REASONS["pseudotext"]))
    bad = F.coalesce(pseudo | told, F.lit(False))
    given = F.when(X.or_empty(F.col("retry_reason")) != "", F.array("retry_reason")).otherwise(F.array().cast("array<string>"))
    return m.select("page_result_id", bad.alias("degraded"), F.when(bad, append_reason(given, IMAGE_REASON)).otherwise(given).alias("reasons"), F.when(~bad, F.col("text")).alias("text"))


def with_leaks(pages: DataFrame, leaking: DataFrame, reason: str) -> DataFrame:
    """The pages with ``leak_targets``, ``needs_retry`` and ``reasons`` as the leaks of :func:`overlap.leaking_pages` demand."""
    found = leaking.select("file_id", "page_index", F.transform("targets", lambda t: t["target_page"]).alias("leak_targets"))
    leaks = F.col("leak_targets").isNotNull()
    given = F.when(X.or_empty(F.col("retry_reason")) != "", F.array("retry_reason")).otherwise(F.array().cast("array<string>"))
    out = pages.join(found, ["file_id", "page_index"], "left")
    return out.withColumns({"needs_retry": leaks | F.coalesce("needs_retry", F.lit(False)), "reasons": F.when(leaks, append_reason(given, reason)).otherwise(given)})


def page_set_identity(df: DataFrame, source: str, pages: str, config: str, runtime: str, isolated: bool = False) -> DataFrame:
    """The rows with ``identity``: the hash by which work on a chosen set of pages may be used again."""
    named = df.withColumns({"_selected_pages": F.col(pages), "_isolation": F.lit(ISOLATION if isolated else None).cast("string")})
    return named.withColumn("identity", identity_hash([source, "_selected_pages", config, runtime, "_isolation"])).drop("_selected_pages", "_isolation")


def chunk_identity(df: DataFrame, source: str, first: str, last: str, config: str, code: str, runtime: str) -> DataFrame:
    """The rows with ``identity``: the hash by which work on a chunk of pages may be used again."""
    return df.withColumn("identity", identity_hash([source, first, last, config, code, runtime]))
