"""The registered queries of the operators for training data, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm import lookalike, markup, mixing, packing, pii, repetition, truncation
from pageflow.llm.pagenoise import PageNoise
from pageflow.llm.spans import SharedSpans
from pageflow.session import load_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "page_results")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_pages(spark, sf_dir), "page_result_id", ["text", "source_text"]).pairs()


@query
def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_pages(spark, sf_dir), "page_result_id", ["text", "source_text"]).class_spans()


@query
def p1_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(_pages(spark, sf_dir), "page_result_id", ["text", "source_text"]).shared_by_record()


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(_pages(spark, sf_dir), "page_result_id", "origin", ["text", "md_nohf_text"]).withColumnRenamed("id", "page_result_id")


@query
def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.outliers(_pages(spark, sf_dir), "page_result_id", "origin", ["text", "md_nohf_text"]).selectExpr("id as page_result_id", "field", "repeated / words as repeated_share", "round(distance, 6) as distance", "rejected")


@query
def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.recall(_pages(spark, sf_dir), "page_result_id", "origin", ["text", "md_nohf_text"])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(_pages(spark, sf_dir), "page_result_id", ["text", "source_text"]).withColumnRenamed("id", "page_result_id")


@query
def p5_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalized(_pages(spark, sf_dir), "page_result_id", ["text", "source_text"]).withColumnRenamed("id", "page_result_id")


def _cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select(F.lit("page_results").alias("tbl"), F.col("page_result_id").alias("row_id"), F.col("origin").alias("source"), F.lit(None).cast("string").alias("label"), "text")
    blocks = load_table(spark, sf_dir, "paddle_worker").select(F.lit("paddle_worker").alias("tbl"), F.col("block_uid").alias("row_id"), F.col("worker_id").alias("source"), F.col("block_label").alias("label"), F.col("block_content").alias("text"))
    return pages.unionByName(blocks)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(_cut_values(spark, sf_dir)).filter("cut").select("tbl", "row_id")


@query
def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(_cut_values(spark, sf_dir))


@query
def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_evidence(_cut_values(spark, sf_dir))


def _noise(spark: SparkSession, sf_dir: str) -> PageNoise:
    return PageNoise(_pages(spark, sf_dir), load_table(spark, sf_dir, "source_files"), "page_result_id", ["text", "md_nohf_text", "fallback_text"])


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).found().withColumnRenamed("id", "page_result_id")


@query
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).repaired().withColumnRenamed("id", "page_result_id")


@query
def p2_misread_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).forms


def _marked(f: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = f(_pages(spark, sf_dir), "page_results", "page_result_id", ["text", "source_text"])
    return pages.unionByName(f(load_table(spark, sf_dir, "paddle_worker"), "paddle_worker", "block_uid", ["block_content"]))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(markup.found, spark, sf_dir)


@query
def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(markup.cleaned, spark, sf_dir)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "container_sizes"))


@query
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query
def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.bins(_packed(spark, sf_dir))


@query
def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(_packed(spark, sf_dir))


@query
def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "mix_targets")).drop("membership").withColumnRenamed("id", "doc_id")


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load_table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mixed(load_table(spark, sf_dir, "documents"), targets), targets)


@query
def p9_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.held_out(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "mix_targets"))


@query
def p9_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.frontier(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "mix_targets"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.occurrences(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "name_list")).selectExpr("id as doc_id", "start_char", "kind")


@query
def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "name_list")).withColumnRenamed("id", "doc_id")


# The SQL that must give the same rows, where SQL can express a query.
ORACLES["p1_found"] = """WITH v AS (SELECT page_result_id AS id, unnest([text, source_text]) AS t FROM page_results), p AS (SELECT DISTINCT id, t FROM v WHERE length(t) >= 200),
    g AS (SELECT DISTINCT id, hash(substr(t, i, 200)) AS h FROM (SELECT id, t, unnest(range(1, length(t) - 198)) AS i FROM p))
    SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.h = b.h AND a.id < b.id"""
ORACLES["p4_found"] = r"""WITH v AS (SELECT page_result_id, unnest(['text', 'md_nohf_text']) AS field, unnest([text, md_nohf_text]) AS t FROM page_results),
    w AS (SELECT page_result_id, field, regexp_extract_all(lower(t), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[\p{Latin}\p{Greek}\p{Cyrillic}\p{N}]+') AS ws FROM v WHERE t <> ''),
    k AS (SELECT *, CASE WHEN len(list_filter(ws, lambda x: regexp_matches(x, '^[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]'))) * 2 > len(ws) THEN 12 ELSE 6 END AS k FROM w WHERE len(ws) > 0),
    g AS (SELECT page_result_id, field, len(ws) AS n, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM k), h AS (SELECT page_result_id, field, n, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_result_id, field, gram ORDER BY i) AS occurrence FROM h),
    m AS (SELECT DISTINCT page_result_id, field, n, unnest(range(i, i + k)) AS at FROM r WHERE occurrence > 1)
    SELECT page_result_id, field FROM m GROUP BY page_result_id, field, n HAVING count(*) * 3 >= n"""
_ZERO_WIDTH = r"[\x{00ad}\x{034f}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
ORACLES["p5_found"] = rf"""WITH v AS (SELECT page_result_id, unnest(['text', 'source_text']) AS field, unnest([text, source_text]) AS t FROM page_results),
    z AS (SELECT *, regexp_replace(t, '{_ZERO_WIDTH}', '', 'g') AS s FROM v WHERE t <> '')
    SELECT page_result_id, field, 'fullwidth' AS kind FROM z WHERE regexp_matches(t, '[\x{{ff10}}-\x{{ff19}}\x{{ff21}}-\x{{ff3a}}\x{{ff41}}-\x{{ff5a}}]')
    UNION ALL SELECT page_result_id, field, 'zero_width' FROM z WHERE regexp_matches(t, '{_ZERO_WIDTH}')
    UNION ALL SELECT page_result_id, field, 'nbsp' FROM z WHERE regexp_matches(t, '[\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]')
    UNION ALL SELECT page_result_id, field, 'combining' FROM z WHERE regexp_matches(s, '\p{{M}}') AND nfc_normalize(s) <> s
    UNION ALL SELECT page_result_id, field, 'lookalike' FROM z WHERE regexp_matches(nfc_normalize(s), '\p{{Latin}}\p{{M}}*[\p{{Greek}}\p{{Cyrillic}}]|[\p{{Greek}}\p{{Cyrillic}}]\p{{M}}*\p{{Latin}}|\p{{Greek}}\p{{M}}*\p{{Cyrillic}}|\p{{Cyrillic}}\p{{M}}*\p{{Greek}}')"""
