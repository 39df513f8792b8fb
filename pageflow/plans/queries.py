"""The registered queries of the core, each over its whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import geometry as G
from pageflow.functions import text as X
from pageflow.functions.normalize import arrow_function
from pageflow.functions.segments import script_runs, segments
from pageflow.operators import blocktext, cells, layout, lines, nested, overlap, pages, rebuild, records, recovery, state, tables, validate
from pageflow.session import load_table
from pageflow.sources import writers
from pageflow.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: load_table(spark, d, name)


_pages, _blocks, _files, _docs, _events = _t("page_results"), _t("paddle_worker"), _t("source_files"), _t("documents"), _t("events")


# ---- nested records


@query(
    r"""WITH RECURSIVE v AS (SELECT record_id, body FROM middle_json WHERE body IS NOT NULL AND json_valid(body)), q AS (SELECT record_id, coalesce(json_extract(body, '$.pdf_info'), json_extract(body, '$.result.pdf_info')) AS j FROM v),
    t AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$')::json ELSE j END AS j FROM q WHERE j IS NOT NULL),
    a AS (SELECT record_id, CASE WHEN json_type(j) = 'OBJECT' THEN [j] WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') END AS l FROM t),
    p AS (SELECT record_id, unnest(l) AS node, 'pdf_info[' || (generate_subscripts(l, 1) - 1) || ']' AS path FROM a WHERE len(l) > 0),
    n AS (SELECT record_id, node, path, NULL::varchar AS parent, 0 AS depth FROM p WHERE json_type(node) = 'OBJECT'
    UNION ALL SELECT record_id, node, path || '.' || name || '[' || i || ']', path, depth + 1 FROM (
    SELECT record_id, path, depth, name, unnest(l) AS node, generate_subscripts(l, 1) - 1 AS i FROM (SELECT n.record_id, n.path, n.depth, c.name, CASE WHEN json_type(json_extract(n.node, '$.' || c.name)) = 'OBJECT' THEN [json_extract(n.node, '$.' || c.name)] WHEN json_type(json_extract(n.node, '$.' || c.name)) = 'ARRAY' THEN json_transform(json_extract(n.node, '$.' || c.name), '["JSON"]') END AS l
    FROM n JOIN (VALUES ('para_blocks', 0), ('preproc_blocks', 0), ('discarded_blocks', 0), ('blocks', 1), ('lines', 1), ('spans', 1)) AS c(name, inner_one) ON (n.depth > 0) = (c.inner_one = 1)) WHERE len(l) > 0) WHERE json_type(node) = 'OBJECT')
    SELECT record_id, path AS node_path, parent AS parent_path FROM n WHERE depth > 0"""
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes_below_pages(load_table(spark, d, "middle_json"))


def _p7_table(tag: str) -> Query:
    return lambda spark, d: nested.typed_table(nested.emit_tagged(load_table(spark, d, "middle_json")), tag)


for _tag in nested.TABLE_SCHEMAS:
    QUERIES[f"p7_{_tag}"] = _p7_table(_tag)



@query()
def record_cells(spark: SparkSession, d: str) -> DataFrame:
    return blocktext.record_cells(load_table(spark, d, "middle_json")).select("record_id", "page_index", "container", "category", "cell_path", F.sha2("content", 256).alias("sha256"))


_PAGES_SQL = r"""WITH v AS (SELECT record_id, body FROM middle_json WHERE body IS NOT NULL AND json_valid(body)), q AS (SELECT record_id, coalesce(json_extract(body, '$.pdf_info'), json_extract(body, '$.result.pdf_info')) AS j FROM v),
    t AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$')::json ELSE j END AS j FROM q WHERE j IS NOT NULL),
    a AS (SELECT record_id, CASE WHEN json_type(j) = 'OBJECT' THEN [j] WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') END AS l FROM t),
    p AS (SELECT record_id, unnest(l) AS node, generate_subscripts(l, 1) - 1 AS i FROM a WHERE len(l) > 0)"""


@query(_PAGES_SQL + " SELECT record_id, 'pdf_info[' || i || ']' AS node_path, greatest(0, coalesce(json_extract_string(node, '$.page_idx')::int, i))::int AS page_index FROM p WHERE json_type(node) = 'OBJECT'")
def record_page_indexes(spark: SparkSession, d: str) -> DataFrame:
    """The page that each page object names; its place where it names none."""
    tagged = nested.emit_tagged(load_table(spark, d, "middle_json")).filter("tag = 'pages'")
    return tagged.select("record_id", "node_path", records.page_index_of_record(F.col("payload"), F.col("ordinal").cast("int")).alias("page_index"))


@query("SELECT page_result_id, len(list_filter(cells, lambda c: lower(trim(c.category)) = 'table')) AS n_tables, 0 AS n_tables_left, coalesce(len(cells), -1) AS n_cells FROM page_results WHERE cells IS NOT NULL")
def cells_without_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of each page before and after they are made text."""
    is_table = lambda c: F.lower(F.trim(c["category"])) == "table"
    made = recovery.tables_as_text(F.col("cells"))
    return _pages(spark, d).filter("cells is not null").select("page_result_id", F.size(F.filter("cells", is_table)).alias("n_tables"), F.size(F.filter(made, is_table)).alias("n_tables_left"), F.size(made).alias("n_cells"))


# ---- cells

_CATEGORY_SQL = "CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'Text' ELSE coalesce(map_extract(MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(cells.CATEGORIES.items())) + "}}, lower(trim({c})))[1], {c}) END"
_LABEL_SQL = "coalesce(map_extract(MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(cells.BLOCK_LABELS.items())) + "}}, lower(trim(coalesce({c}, ''))))[1], 'Text')"


@query(
    f"""WITH one AS (SELECT page_result_id, file_id, page_index, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS cell_ord FROM page_results),
    f AS (SELECT *, len(cell.bbox) = 4 AND cell.bbox[3] > cell.bbox[1] AND cell.bbox[4] > cell.bbox[2] AS ok FROM one)
    SELECT page_result_id, cell_ord, {_CATEGORY_SQL.format(c="cell.category")} AS category, cell.bbox_units AS units, coalesce(ok, false) AS valid,
    CASE WHEN ok THEN cell.bbox[1] END AS x0, CASE WHEN ok THEN cell.bbox[2] END AS y0, CASE WHEN ok THEN cell.bbox[3] END AS x1, CASE WHEN ok THEN cell.bbox[4] END AS y1 FROM f"""
)
def cells_exploded(spark: SparkSession, d: str) -> DataFrame:
    return cells.explode_cells(_pages(spark, d)).select("page_result_id", "cell_ord", "category", "units", "valid", "x0", "y0", "x1", "y1")


@query(f"SELECT {_CATEGORY_SQL.format(c='cell.category')} AS category, count(*) AS n_cells FROM (SELECT unnest(cells) AS cell FROM page_results) GROUP BY 1")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return cells.category_counts(cells.explode_cells(_pages(spark, d)))


@query(f"SELECT {_LABEL_SQL.format(c='block_label')} AS category, count(*) AS n_cells FROM paddle_worker GROUP BY 1")
def block_label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return cells.category_counts(_blocks(spark, d).withColumn("category", cells.block_category(F.col("block_label"))))


_BOX = "CASE WHEN len(block_bbox) = 4 AND block_bbox[3] > block_bbox[1] AND block_bbox[4] > block_bbox[2] THEN block_bbox END"
_CELLS_SQL = f"""SELECT *, {_LABEL_SQL.format(c="block_label")} AS category, coalesce(block_content, '') AS content, {_BOX} AS box FROM paddle_worker"""
_ORDERED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY file_id, page_index ORDER BY coalesce(block_order, block_id), box[2] ASC NULLS LAST, box[1] ASC NULLS LAST, block_uid) - 1 AS cell_ord FROM ({_CELLS_SQL}) WHERE trim(content) <> '' OR category = 'Picture'"""


@query(f"SELECT block_uid, cell_ord, category FROM ({_ORDERED_SQL})")
def block_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return cells.block_cells(_blocks(spark, d)).select("block_uid", "cell_ord", "category")


@query("SELECT file_id, page_index, substr(coalesce(block_content, ''), 1, 300) AS head, min(block_uid) AS block_uid FROM paddle_worker GROUP BY 1, 2, 3")
def block_first_wins(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring(X.or_empty(F.col("block_content")), 1, 300)
    return cells.dedupe_first(_blocks(spark, d), [F.col("file_id"), F.col("page_index"), head], [F.col("block_uid")]).select("file_id", "page_index", head.alias("head"), "block_uid")


_INTER = "greatest(0.0, least(a.box[3], b.box[3]) - greatest(a.box[1], b.box[1])) * greatest(0.0, least(a.box[4], b.box[4]) - greatest(a.box[2], b.box[2]))"


@query(
    f"""WITH c AS ({_CELLS_SQL}), s AS (SELECT * FROM c WHERE category IN ('Footnote', 'List-item') AND box IS NOT NULL), e AS (SELECT * FROM c WHERE category = 'Text' AND box IS NOT NULL)
    SELECT block_uid FROM s a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.file_id = b.file_id AND a.page_index = b.page_index AND (({_INTER}) / ((a.box[3] - a.box[1]) * (a.box[4] - a.box[2])) >= 0.45
    OR (length(a.content) >= 30 AND length(b.content) >= 30 AND NOT regexp_matches(trim(a.content), '^(?:[0-9]{{1,4}}|\\[ *[0-9]{{1,4}} *\\])$') AND NOT regexp_matches(trim(b.content), '^(?:[0-9]{{1,4}}|\\[ *[0-9]{{1,4}} *\\])$') AND (contains(a.content, b.content) OR contains(b.content, a.content)))))"""
)
def uncovered_blocks(spark: SparkSession, d: str) -> DataFrame:
    base = cells.block_cells_all(_blocks(spark, d)).filter("box is not null")
    return cells.uncovered(base.filter("category in ('Footnote', 'List-item')"), base.filter("category = 'Text'"), ["file_id", "page_index"]).select("block_uid")


@query()
def holes_filled(spark: SparkSession, d: str) -> DataFrame:
    base = cells.block_cells_all(_blocks(spark, d)).filter("box is not null").withColumn("cell_ord", F.col("pos"))
    kept = ["file_id", "page_index"]
    return cells.fill_holes(base.filter("category = 'Text'"), base.filter("category in ('Footnote', 'List-item')"), kept).select(*kept, "cell_ord", "extra")


@query()
def marker_bodies(spark: SparkSession, d: str) -> DataFrame:
    return cells.marker_bodies(_blocks(spark, d))


@query(
    f"""WITH c AS (SELECT * FROM ({_CELLS_SQL}) WHERE category NOT IN ('Page-header', 'Page-footer') AND NOT regexp_matches(trim(content), '^(?:[0-9]{{1,4}}|\\[ *[0-9]{{1,4}} *\\])$') AND box IS NOT NULL)
    SELECT a.block_uid, min(b.box[2]) AS next_top FROM c a LEFT JOIN c b ON a.file_id = b.file_id AND a.page_index = b.page_index AND a.block_uid <> b.block_uid AND b.box[2] > a.box[2]
    AND greatest(0.0, least(a.box[3], b.box[3]) - greatest(a.box[1], b.box[1])) / least(a.box[3] - a.box[1], b.box[3] - b.box[1]) >= 0.12 GROUP BY 1"""
)
def next_flow_tops(spark: SparkSession, d: str) -> DataFrame:
    return cells.next_flow_top(cells.block_cells_all(_blocks(spark, d)), ["file_id", "page_index"]).select("block_uid", "next_top")


@query(
    f"""WITH c AS (SELECT *, 842.0 AS h FROM ({_CELLS_SQL}) WHERE category = 'Text' AND box IS NOT NULL AND length(content) >= 80)
    SELECT file_id, page_index, count(*) AS n_blocks, median(box[4] - box[2]) AS median_height FROM c GROUP BY 1, 2"""
)
def body_heights(spark: SparkSession, d: str) -> DataFrame:
    text = cells.block_cells_all(_blocks(spark, d)).filter((F.col("category") == "Text") & F.col("box").isNotNull() & (F.length("content") >= 80))
    return text.groupBy("file_id", "page_index").agg(F.count(F.lit(1)).alias("n_blocks"), F.median(F.col("box")[3] - F.col("box")[1]).alias("median_height"))


@query(
    f"""WITH one AS (SELECT page_result_id, image_width AS iw, image_height AS ih, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS cell_ord FROM page_results),
    f AS (SELECT *, cell.bbox AS b FROM one WHERE len(cell.bbox) = 4 AND cell.bbox[3] > cell.bbox[1] AND cell.bbox[4] > cell.bbox[2] AND iw > 0 AND ih > 0),
    k AS (SELECT *, coalesce(cell.bbox_units, CASE WHEN list_max(b) <= 1.5 THEN 'relative' WHEN list_max(b) <= 1200 THEN 'mineru_1000' ELSE 'image' END) AS u FROM f),
    s AS (SELECT *, CASE u WHEN 'relative' THEN 595.0::double WHEN 'mineru_1000' THEN 595.0::double / 1000 WHEN 'image' THEN 595.0::double / iw ELSE 1.0::double END AS sx, CASE u WHEN 'relative' THEN 842.0::double WHEN 'mineru_1000' THEN 842.0::double / 1000 WHEN 'image' THEN 842.0::double / ih ELSE 1.0::double END AS sy FROM k)
    SELECT page_result_id, cell_ord, floor(greatest(0, least(595, b[1] * sx)) * 8)::bigint AS x0, floor(greatest(0, least(842, b[2] * sy)) * 8)::bigint AS y0, floor(greatest(0, least(595, b[3] * sx)) * 8)::bigint AS x1, floor(greatest(0, least(842, b[4] * sy)) * 8)::bigint AS y1 FROM s"""
)
def cells_on_page(spark: SparkSession, d: str) -> DataFrame:
    one = _pages(spark, d).filter("image_width > 0 and image_height > 0").select("page_result_id", "image_width", "image_height", F.posexplode("cells").alias("cell_ord", "cell"))
    ok = one.withColumn("b", F.col("cell.bbox")).filter("size(b) = 4 and b[2] > b[0] and b[3] > b[1]")
    box = G.to_page(F.col("b"), F.col("cell.bbox_units"), F.lit(595.0), F.lit(842.0), F.col("image_width"), F.col("image_height"))
    return ok.withColumn("p", box).select("page_result_id", "cell_ord", *[F.floor(F.col("p")[i] * 8).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


# ---- pages


@query("SELECT page_result_id FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1")
def pages_first_loaded(spark: SparkSession, d: str) -> DataFrame:
    return pages.first_loaded(_pages(spark, d)).select("page_result_id")


@query(
    """WITH f AS (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1)
    SELECT file_id, page_index, page_result_id, run_no, n_runs FROM (SELECT *, count(*) OVER (PARTITION BY file_id, page_index) AS n_runs, row_number() OVER (PARTITION BY file_id, page_index ORDER BY run_no DESC, page_result_id) AS rn FROM f) WHERE rn = 1"""
)
def pages_last_run(spark: SparkSession, d: str) -> DataFrame:
    return pages.last_run(_pages(spark, d)).select("file_id", "page_index", "page_result_id", "run_no", "n_runs")


@query("SELECT page_result_id, length(coalesce(nullif(text, ''), nullif(fallback_text, ''), nullif(md_nohf_text, ''))) AS n_chars, CASE WHEN coalesce(text, '') <> '' THEN 'text' WHEN coalesce(fallback_text, '') <> '' THEN 'fallback_text' WHEN coalesce(md_nohf_text, '') <> '' THEN 'md_nohf_text' END AS primary_from FROM page_results")
def page_primary_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.with_primary_text(_pages(spark, d)).select("page_result_id", F.length("primary_text").alias("n_chars"), "primary_from")


_DOTS_SQL = "regexp_matches(coalesce({c}, ''), '(?:[ \\t\\r\\n]*[.．·•∙‧⋅・･][ \\t\\r\\n]*){{300,}}')"
_PRIMARY = "coalesce(nullif(text, ''), nullif(fallback_text, ''), nullif(md_nohf_text, ''), '')"
_TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[^ \\t\\n\\x0B\\f\\r]+')"
_METRICS_SQL = f"""SELECT {{id}}, raw_len, n_tokens, n_coords, n_hashes, n_hash_tokens, coalesce(top_count, 0) AS top_count, n_distinct FROM (
    SELECT {{id}}, length(coalesce({{c}}, '')) AS raw_len, len(t) AS n_tokens, len(list_filter(t, lambda x: regexp_full_match(x, '[xy]\\s*=?-?[0-9]+(?:\\.[0-9]+)?'))) AS n_coords, len(regexp_extract_all(coalesce({{c}}, ''), '###')) AS n_hashes,
    len(list_filter(t, lambda x: x = '###')) AS n_hash_tokens, list_max(map_values(list_histogram(t))) AS top_count, len(list_distinct(t)) AS n_distinct FROM (SELECT *, {_TOKENS} AS t FROM {{t}}))"""


@query(_METRICS_SQL.format(id="doc_id", c="text", t="documents"))
def document_text_metrics(spark: SparkSession, d: str) -> DataFrame:
    return pages.text_metrics(_docs(spark, d), "text").select("doc_id", "raw_len", "n_tokens", "n_coords", "n_hashes", "n_hash_tokens", "top_count", "n_distinct")


@query(f"SELECT page_result_id, n_tokens >= 8 AND (n_coords >= 4 OR n_hash_tokens >= 3 OR top_count * 100 >= n_tokens * 18 OR n_distinct * 100 <= n_tokens * 38) AS token_artifact FROM ({_METRICS_SQL.format(id='page_result_id', c='text', t='page_results')})")
def page_token_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return pages.token_artifacts(pages.text_metrics(_pages(spark, d), "text")).select("page_result_id", "token_artifact")


@query(
    f"""SELECT page_result_id, array_to_string(list_filter([CASE WHEN needs_retry AND retry_reason IS NULL THEN '{pages.REASONS['filtered']}' END, CASE WHEN coalesce(fallback_text, '') <> '' AND coalesce(text, '') = '' THEN '{pages.REASONS['fallback']}' END,
    CASE WHEN contains(coalesce(text, ''), 'The New York Times') OR contains(coalesce(text, ''), 'January 1, 2020') THEN '{pages.REASONS['phrase']}' END, CASE WHEN {_DOTS_SQL.format(c='text')} OR {_DOTS_SQL.format(c='fallback_text')} THEN '{pages.REASONS['dots']}' END,
    CASE WHEN raw_len >= 160 AND (n_coords >= 6 OR n_hashes >= 6) THEN '{pages.REASONS['pseudotext']}' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM page_results JOIN ({_METRICS_SQL.format(id='page_result_id', c='text', t='page_results')}) USING (page_result_id)"""
)
def page_retry_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pages.retry_reasons(_pages(spark, d)).select("page_result_id", F.array_join("reasons", " | ").alias("reasons"))


@query(
    """WITH dom AS (SELECT file_id, unnest(range(page_count)) AS page_index FROM source_files WHERE page_count > 0), p AS (SELECT DISTINCT file_id, page_index FROM page_results),
    j AS (SELECT coalesce(dom.file_id, p.file_id) AS file_id, coalesce(dom.page_index, p.page_index) AS page_index, dom.file_id IS NOT NULL AS wanted, p.file_id IS NOT NULL AS here FROM dom FULL JOIN p ON dom.file_id = p.file_id AND dom.page_index = p.page_index)
    SELECT file_id, count(*) FILTER (wanted) AS n_expected, count(*) FILTER (wanted AND here) AS n_covered, count(*) FILTER (wanted AND NOT here) AS n_missing, count(*) FILTER (NOT wanted) AS n_beyond,
    sha256(coalesce(string_agg((page_index + 1)::varchar, ',' ORDER BY page_index) FILTER (wanted AND here), '')) AS coverage_hash FROM j GROUP BY 1"""
)
def page_coverage_manifest(spark: SparkSession, d: str) -> DataFrame:
    return pages.coverage_manifest(_files(spark, d), _pages(spark, d))


@query(
    """SELECT page_result_id, CASE WHEN NOT coalesce(needs_retry, false) AND coalesce(text, '') <> '' THEN 'text' WHEN coalesce(source_text, '') <> '' THEN 'source_text' WHEN coalesce(fallback_text, '') <> '' THEN 'fallback_text' ELSE 'image' END AS final_from,
    sha256(coalesce(CASE WHEN NOT coalesce(needs_retry, false) AND coalesce(text, '') <> '' THEN text WHEN coalesce(source_text, '') <> '' THEN source_text WHEN coalesce(fallback_text, '') <> '' THEN fallback_text END, '')) AS sha256 FROM page_results"""
)
def retry_priority_merge(spark: SparkSession, d: str) -> DataFrame:
    return pages.priority_merge(_pages(spark, d)).select("page_result_id", "final_from", F.sha2(X.or_empty(F.col("final_text")), 256).alias("sha256"))


@query(
    f"SELECT page_result_id, trim(coalesce(source_text, '')) = '' AND (trim({_PRIMARY}) = '' OR regexp_matches({_PRIMARY}, '(?i)^\\s*the\\s+quick\\s+brown\\s+fox\\s+jumps\\s+over\\s+the\\s+lazy\\s+dog\\.?\\s*$')) AS blank FROM page_results"
)
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.suppress_blank(_pages(spark, d)).select("page_result_id", "blank")


@query("SELECT file_id, (start_page // 60)::integer AS chunk_no, start_page, least(start_page + 60, page_count) - 1 AS end_page FROM (SELECT file_id, page_count, unnest(range(0, page_count, 60))::integer AS start_page FROM source_files WHERE page_count > 0)")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return pages.chunk_plan(_files(spark, d))


@query("SELECT p.file_id, p.page_index, p.page_index // 60 AS chunk_no, count(*) AS n_rows FROM page_results p JOIN source_files s ON p.file_id = s.file_id AND s.page_count > 0 AND p.page_index // 60 <= (s.page_count - 1) // 60 GROUP BY 1, 2, 3")
def pages_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    return pages.with_chunk(_pages(spark, d), pages.chunk_plan(_files(spark, d))).groupBy("file_id", "page_index", "chunk_no").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT file_id, page_index, (rn // 24)::integer AS batch_no, (rn % 24 * 2)::integer AS local_index FROM (SELECT file_id, page_index, row_number() OVER (PARTITION BY file_id ORDER BY page_index) - 1 AS rn FROM (SELECT DISTINCT file_id, page_index FROM page_results WHERE needs_retry))")
def retry_batches(spark: SparkSession, d: str) -> DataFrame:
    return pages.retry_batches(_pages(spark, d))


_ISSUES_SQL = f"""WITH b AS (SELECT *, {_PRIMARY} AS pt FROM page_results JOIN ({_METRICS_SQL.format(id='page_result_id', c='text', t='page_results')}) USING (page_result_id)),
    i AS (SELECT page_result_id, file_id, page_index + 1 AS page_no, unnest(list_filter([CASE WHEN run_no > 1 THEN 'page_range_retry' END, CASE WHEN raw_len >= 160 AND (n_coords >= 6 OR n_hashes >= 6) THEN 'high_repeated_pseudotext' END, CASE WHEN needs_retry THEN 'retry_still_needed' END,
    CASE WHEN coalesce(fallback_text, '') <> '' AND coalesce(text, '') = '' THEN 'markdown_fallback_only' END, CASE WHEN regexp_matches(pt, '(?i)^\\s*the\\s+quick\\s+brown\\s+fox\\s+jumps\\s+over\\s+the\\s+lazy\\s+dog\\.?\\s*$') THEN 'font_test_pangram' END,
    CASE WHEN regexp_matches(pt, '[\\x{{2e80}}-\\x{{2fff}}\\x{{31c0}}-\\x{{31ef}}\\x{{f900}}-\\x{{faff}}]') THEN 'radical_chars_in_ocr_text' END, CASE WHEN regexp_matches(pt, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'control_chars_in_ocr_text' END,
    CASE WHEN contains(pt, 'The New York Times') OR contains(pt, 'January 1, 2020') THEN 'suspicious_placeholder_text' END, CASE WHEN pt <> '' AND length(trim(pt)) < 12 AND trim(coalesce(source_text, '')) <> '' THEN 'very_low_text_nonblank_source' END,
    CASE WHEN trim(pt) = '' AND trim(coalesce(source_text, '')) = '' THEN 'blank_page_output_cleared' END, CASE WHEN regexp_matches(pt, '\\\\(?:frac|dfrac|tfrac|sqrt|text|textregistered|mathrm|mathbf|mathit|mathsf|operatorname|times|cdot|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega|leq|geq|neq|left|right)\\b|[\\^_]\\s*\\{{') THEN 'latex_residue_in_text' END,
    CASE WHEN len(list_filter(cells, lambda c: lower(c.category) = 'table' AND c.bbox IS NULL)) > 0 THEN 'table_without_cell_rows' END, CASE WHEN trim(pt) = '' AND needs_retry THEN 'image_fallback_page' END], lambda x: x IS NOT NULL)) AS issue FROM b)"""


@query(_ISSUES_SQL + " SELECT page_result_id, file_id, page_no, issue FROM i")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return pages.issues(_pages(spark, d))


@query(_ISSUES_SQL + " SELECT file_id, page_no, string_agg(DISTINCT issue, ' | ' ORDER BY issue) AS issues FROM i GROUP BY 1, 2")
def suspect_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.suspect_pages(_pages(spark, d)).withColumn("issues", F.array_join("issues", " | "))


@query(
    f"""SELECT page_result_id, (raw_len >= 160 AND (n_coords >= 6 OR n_hashes >= 6)) OR contains(coalesce(retry_reason, ''), '{pages.REASONS["pseudotext"]}') AS degraded,
    sha256(CASE WHEN (raw_len >= 160 AND (n_coords >= 6 OR n_hashes >= 6)) OR contains(coalesce(retry_reason, ''), '{pages.REASONS["pseudotext"]}') THEN '' ELSE coalesce(text, '') END) AS sha256
    FROM page_results JOIN ({_METRICS_SQL.format(id='page_result_id', c='text', t='page_results')}) USING (page_result_id)"""
)
def degraded_pages(spark: SparkSession, d: str) -> DataFrame:
    return recovery.degraded(_pages(spark, d)).select("page_result_id", "degraded", F.sha2(X.or_empty(F.col("text")), 256).alias("sha256"))


@query()
def merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each page as those of a retry, merged where they belong together."""
    boxed = cells.block_cells_all(_blocks(spark, d)).filter("box is not null")
    at = boxed.select("file_id", "page_index", "category", F.col("content").alias("text"), F.col("box")[0].cast("double").alias("left"), F.col("box")[1].cast("double").alias("top"), (F.col("box")[2] - F.col("box")[0]).cast("double").alias("width"), (F.col("box")[3] - F.col("box")[1]).cast("double").alias("height"))
    return recovery.merge_retry_blocks(at).groupBy("file_id", "page_index").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_merged").alias("n_before"))


@query(
    _ISSUES_SQL + """, s AS (SELECT file_id, page_no, list_sort(list_distinct(list(issue))) AS issues FROM i GROUP BY 1, 2), g AS (SELECT file_id, list({'page_no': page_no, 'issues': issues} ORDER BY page_no) AS sp FROM s GROUP BY 1),
    d AS (SELECT file_id, unnest(range(page_count)) AS page_index, true AS wanted FROM source_files WHERE page_count > 0), h AS (SELECT DISTINCT file_id, page_index, true AS here FROM page_results),
    c AS (SELECT file_id, count(wanted) AS n_expected, count(*) FILTER (wanted AND here) AS n_covered, count(*) FILTER (wanted AND here IS NULL) AS n_missing FROM d FULL JOIN h USING (file_id, page_index) GROUP BY 1)
    SELECT file_id, to_json({'file_id': file_id, 'n_expected': n_expected, 'n_covered': n_covered, 'n_missing': n_missing, 'suspect_pages': coalesce(sp, [])})::varchar AS report FROM c LEFT JOIN g USING (file_id)"""
)
def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    return writers.quality_reports(pages.suspect_pages(_pages(spark, d)), pages.coverage_manifest(_files(spark, d), _pages(spark, d)))



@query(f"SELECT file_id, count(*) FILTER (NOT coalesce(needs_retry, false) AND {_PRIMARY} <> '') AS completed, count(*) FILTER (NOT coalesce(needs_retry, false) AND {_PRIMARY} = '') AS skipped, count(*) FILTER (coalesce(needs_retry, false)) AS failed FROM page_results GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.status_counts(_pages(spark, d))


@query(
    f"""WITH c AS (SELECT file_id, count(*) FILTER (coalesce(needs_retry, false)) AS failed, count(*) FILTER (NOT coalesce(needs_retry, false) AND {_PRIMARY} <> '') AS completed FROM page_results GROUP BY 1), s AS (SELECT CASE WHEN failed > 0 THEN 'failed' WHEN completed > 0 THEN 'completed' ELSE 'skipped' END AS s FROM c),
    b AS (SELECT count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed FROM s), t AS (SELECT *, CASE WHEN failed > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM b)
    SELECT *, sha256('{{"completed":' || completed || ',"failed":' || failed || ',"skipped":' || skipped || ',"status":"' || status || '"}}') AS checkpoint_sha256 FROM t"""
)
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return writers.batch_summary(pages.status_counts(_pages(spark, d)))


# ---- content of later pages

_LAST_ROWS_SQL = "(SELECT * FROM (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1) QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY run_no DESC, page_result_id) = 1)"
# Compatibility forms and case folding, as far as the tables hold such characters.
_FULL = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
_HALF = "".join(chr(ord(c) - 0xFEE0) for c in _FULL)
_KEY_SQL = "regexp_replace(replace(replace(lower(translate(nfc_normalize({c}), '" + _FULL + "', '" + _HALF + "')), 'ß', 'ss'), '№', 'no'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_OUT_SQL, _SOURCE_SQL = _KEY_SQL.format(c="coalesce(text, '')"), _KEY_SQL.format(c="coalesce(source_text, text, '')")
_OVERLAP_SQL = f"""WITH f AS (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1),
    l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY run_no DESC, page_result_id) = 1),
    k AS (SELECT file_id, page_index, {_OUT_SQL} AS ok, {_SOURCE_SQL} AS sk FROM l),
    g AS (SELECT *, CASE WHEN length(ok) >= 16 THEN list_distinct(list_transform(range(1, length(ok) - 14), lambda i: substr(ok, i, 16))) ELSE [] END AS og, CASE WHEN length(sk) >= 16 THEN list_distinct(list_transform(range(1, length(sk) - 14), lambda i: substr(sk, i, 16))) ELSE [] END AS sg FROM k)
    SELECT a.file_id, a.page_index, b.page_index + 1 AS target_page, len(list_intersect(b.sg, a.og)) AS shared, len(b.sg) AS total FROM g a JOIN g b ON a.file_id = b.file_id AND b.page_index > a.page_index AND b.page_index <= a.page_index + 5"""


@query(_OVERLAP_SQL)
def forward_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.forward_overlaps(overlap.page_keys(pages.last_run(_pages(spark, d))), gated=False).select("file_id", "page_index", "target_page", "shared", "total")


@query(
    f"""WITH o AS ({_OVERLAP_SQL}), z AS (SELECT file_id, page_index, length({_OUT_SQL}) AS ol, length({_SOURCE_SQL}) AS sl FROM (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1) QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY run_no DESC, page_result_id) = 1)
    SELECT o.file_id, o.page_index, count(*) AS n_targets, min(o.target_page) AS first_target FROM o JOIN z a ON o.file_id = a.file_id AND o.page_index = a.page_index JOIN z b ON o.file_id = b.file_id AND o.target_page - 1 = b.page_index
    WHERE a.sl >= 120 AND a.ol * 4 > a.sl * 5 AND b.sl >= 500 AND o.total > 0 AND o.shared * 5 >= o.total * 3 GROUP BY 1, 2"""
)
def leaking_pages(spark: SparkSession, d: str) -> DataFrame:
    return overlap.leaking_pages(overlap.page_keys(pages.last_run(_pages(spark, d)))).select("file_id", "page_index", F.size("targets").cast("bigint").alias("n_targets"), F.col("targets")[0]["target_page"].alias("first_target"))


@query(
    f"""WITH o AS ({_OVERLAP_SQL}), p AS {_LAST_ROWS_SQL}, z AS (SELECT *, {_OUT_SQL} AS ok, {_SOURCE_SQL} AS sk FROM p),
    lk AS (SELECT DISTINCT o.file_id, o.page_index FROM o JOIN z a ON o.file_id = a.file_id AND o.page_index = a.page_index JOIN z b ON o.file_id = b.file_id AND o.target_page - 1 = b.page_index
    WHERE length(a.sk) >= 120 AND length(a.ok) * 4 > length(a.sk) * 5 AND length(b.sk) >= 500 AND o.total > 0 AND o.shared * 5 >= o.total * 3)
    SELECT file_id, page_index, CASE WHEN length({_KEY_SQL.format(c="coalesce(source_text, '')")}) >= 120 THEN 'source_text' ELSE 'image' END AS repaired_from FROM lk JOIN p USING (file_id, page_index)"""
)
def leak_repairs(spark: SparkSession, d: str) -> DataFrame:
    last = pages.last_run(_pages(spark, d))
    keys = overlap.page_keys(last)
    leaking = overlap.leaking_pages(keys)
    retried = last.filter("run_no > 1")
    local = overlap.page_local(overlap.page_keys(retried), leaking)
    retries = retried.select("file_id", "page_index", F.col("text").alias("retry_text")).join(local, ["file_id", "page_index"])
    return overlap.repair(last, retries, leaking).select("file_id", "page_index", "repaired_from")


# ---- lines and tables

# A line without inline marks and tags, entities of the common kinds, case, spacing and marks at its edges.
_LINE_KEY_SQL = (
    "regexp_replace(regexp_replace(lower(trim(translate(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(line), '(?i)</?(?:b|strong|i|em|u|s|del|mark|sup|sub|code|span|small|font)(?:\\s[^<>]*)?>', '', 'g'), "
    "'\\*+([^*]+)\\*+', '\\1', 'g'), '\\s+', ' ', 'g'), '" + _FULL + "', '" + _HALF + "'))), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'), '&(?:nbsp|amp|lt|gt);', ' ', 'g')"
)
_RUNS_SQL = f"""WITH l AS (SELECT page_result_id, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS line FROM (SELECT page_result_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS s FROM page_results)),
    k AS (SELECT *, {_LINE_KEY_SQL} AS key FROM l), g AS (SELECT *, CASE WHEN key = lag(key) OVER w AND key <> '' THEN 0 ELSE 1 END AS st FROM k WINDOW w AS (PARTITION BY page_result_id ORDER BY line_no)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY page_result_id ORDER BY line_no) AS run FROM g)"""


@query(_RUNS_SQL + " SELECT page_result_id, min(line_no) AS first_line, count(*) AS run_length, arg_min(line, line_no) AS line FROM r WHERE key <> '' AND length(trim(line)) <= 240 GROUP BY page_result_id, run HAVING count(*) >= 3")
def repeated_line_runs(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_runs(_pages(spark, d), ["page_result_id"], "text")


@query(
    _RUNS_SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY page_result_id, run) AS run_length, row_number() OVER (PARTITION BY page_result_id, run ORDER BY line_no) AS rn FROM r)
    SELECT page_result_id, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS sha256 FROM n WHERE rn = 1 OR run_length < 3 OR key = '' OR length(trim(line)) > 240 GROUP BY 1"""
)
def collapsed_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.collapse_lines(_pages(spark, d), ["page_result_id"], "text").select("page_result_id", F.sha2("collapsed", 256).alias("sha256"))


@query(
    r"""WITH l AS (SELECT trim(unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'))) AS t FROM page_results),
    c AS (SELECT CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^(?:-{3,}|\*{3,}|_{3,})$') THEN 'rule' WHEN starts_with(t, '```') THEN 'code' WHEN regexp_matches(t, '^#(?:\s|$)') THEN 'heading1' WHEN regexp_matches(t, '^##(?:\s|$)') THEN 'heading2' WHEN regexp_matches(t, '^###(?:\s|$)') THEN 'heading3'
    WHEN regexp_matches(t, '^####(?:\s|$)') THEN 'heading4' WHEN regexp_matches(t, '^#####(?:\s|$)') THEN 'heading5' WHEN regexp_matches(t, '^######(?:\s|$)') THEN 'heading6' WHEN regexp_matches(t, '^\[\^[^\]]+\]:') THEN 'footnote' WHEN starts_with(t, '>') THEN 'quote' WHEN regexp_matches(t, '^(?:[-*+•]|\d+[.)])\s') THEN 'list' WHEN regexp_matches(t, '^\|.*\|$') THEN 'table' ELSE 'normal' END AS line_class FROM l)
    SELECT line_class, count(*) AS n_lines FROM c GROUP BY 1"""
)
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_classes(_pages(spark, d), ["page_result_id"], "text").groupBy("line_class").agg(F.count(F.lit(1)).alias("n_lines"))


_ROWS_SQL = """WITH h AS (SELECT block_uid, regexp_extract_all(block_content, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1) AS rs FROM paddle_worker WHERE contains(block_content, '<t')),
    r AS (SELECT block_uid, generate_subscripts(rs, 1) AS n, unnest(rs) AS row FROM h),
    c AS (SELECT block_uid, n, list_transform(regexp_extract_all(row, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]\\s*>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?is)<[^>]+>', '', 'g'), '[ \\t\\r\\f\\x0B]+', ' ', 'g'))) AS cells FROM r)"""


@query(_ROWS_SQL + " SELECT block_uid, count(*) AS n_rows, sum(len(cells))::bigint AS n_cells, sha256(string_agg(array_to_string(cells, '|'), chr(10) ORDER BY n)) AS sha256 FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0 GROUP BY 1")
def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table_rows(_blocks(spark, d), ["block_uid"], "block_content").filter("source = 'html'")
    ordered = F.array_sort(F.collect_list(F.struct("row_no", F.array_join("cells", "|").alias("r"))))
    return rows.groupBy("block_uid").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("col_count").alias("n_cells"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["r"]), "\n"), 256).alias("sha256"))


@query(_ROWS_SQL + """, f AS (SELECT block_uid, list_filter(cells, lambda x: x <> '') AS ne FROM c), g AS (SELECT * FROM f WHERE len(ne) > 0)
    SELECT block_uid, count(*) AS n_rows, count(*) FILTER (len(ne) >= 2) AS n_usable, count(*) FILTER (len(ne) >= 2 AND regexp_full_match(trim(ne[-1]), '\\[?[0-9]{1,4}\\]?|[ivxlcdmIVXLCDM]{1,8}')) AS n_page_like FROM g GROUP BY 1""")
def contents_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table_rows(_blocks(spark, d), ["block_uid"], "block_content").filter("source = 'html'")
    return tables.contents_tables(rows, ["block_uid"]).select("block_uid", "n_rows", "n_usable", "n_page_like")


@query()
def tables_as_markdown(spark: SparkSession, d: str) -> DataFrame:
    return tables.to_markdown(tables.table_rows(_blocks(spark, d), ["block_uid"], "block_content"), ["block_uid"])


# ---- rebuilt text

_MD = "CASE WHEN category IN ('Page-header', 'Page-footer', 'Picture') THEN NULL WHEN category = 'Title' THEN '# ' || trim(content) WHEN category = 'Section-header' THEN '## ' || trim(content) WHEN category = 'List-item' THEN '- ' || trim(content) WHEN category = 'Caption' THEN '*' || trim(content) || '*' WHEN category = 'Formula' THEN '$$' || chr(10) || trim(content) || chr(10) || '$$' ELSE trim(content) END"


@query(f"SELECT file_id, page_index, sha256(string_agg(md, chr(10) || chr(10) ORDER BY cell_ord)) AS sha256 FROM (SELECT *, {_MD} AS md FROM ({_ORDERED_SQL})) WHERE md <> '' GROUP BY 1, 2")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return rebuild.page_markdown(_blocks(spark, d)).select("file_id", "page_index", F.sha2("markdown", 256).alias("sha256"))


@query(
    f"""WITH own AS (SELECT file_id, page_index, md_nohf_text FROM (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1) QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY run_no DESC, page_result_id) = 1),
    built AS (SELECT file_id, page_index, string_agg(md, chr(10) || chr(10) ORDER BY cell_ord) AS md FROM (SELECT *, {_MD} AS md FROM ({_ORDERED_SQL})) WHERE md <> '' GROUP BY 1, 2),
    m AS (SELECT file_id, page_index, coalesce(nullif(md_nohf_text, ''), nullif(md, '')) AS markdown FROM own FULL JOIN built USING (file_id, page_index))
    SELECT file_id, (page_index // 60)::integer AS part_no, count(*) AS n_pages, sha256(string_agg(trim(markdown, ' '), chr(10) || chr(10) ORDER BY page_index, trim(markdown, ' ')) || chr(10)) AS sha256 FROM m WHERE trim(markdown, ' ') <> '' GROUP BY 1, 2"""
)
def book_markdown(spark: SparkSession, d: str) -> DataFrame:
    merged = rebuild.prefer_page_markdown(pages.last_run(_pages(spark, d)), rebuild.page_markdown(_blocks(spark, d)))
    return rebuild.book_markdown(merged).select("file_id", "part_no", "n_pages", F.sha2("markdown", 256).alias("sha256"))


@query()
def normalized_page_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_result_id", arrow_function("normalize_text")("text").alias("normal"))


@query()
def plain_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_result_id", X.squeeze(X.strip_heading_marks(arrow_function("strip_markdown")("md_nohf_text"))).alias("plain"))


@query()
def formulas_as_text(spark: SparkSession, d: str) -> DataFrame:
    formulas = _blocks(spark, d).filter(cells.block_category(F.col("block_label")) == "Formula")
    return formulas.select("block_uid", arrow_function("linearize_latex")("block_content").alias("linear"), arrow_function("latex_to_unicode")("block_content").alias("unicode"))


# ---- layout


def _layout(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of all pages with boxes in points, repaired, sized and fitted."""
    w, h = F.lit(595.0), F.lit(842.0)
    base = cells.block_cells(_blocks(spark, d)).withColumn("units", F.lit("pdf"))
    made = layout.blocks(base, w, h, w, h).select("file_id", "page_index", "block_uid", "cell_ord", "category", "content", "left", "top", "width", "height")
    repaired = layout.repair_running_text(made, layout.body_sizes(made, h), w)
    return layout.fitted(layout.with_fonts(layout.expand_compressed(repaired, w, h)))


@query()
def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_order(_layout(spark, d)).select("block_uid", "block_no", "category", "repaired", "expanded", F.round("fit_size", 2).alias("fit_size"), "fits")


@query()
def layout_failures(spark: SparkSession, d: str) -> DataFrame:
    return layout.fit_failures(_layout(spark, d))


@query()
def layout_reflowed(spark: SparkSession, d: str) -> DataFrame:
    return layout.reflow_pairs(_layout(spark, d)).select("block_uid", F.round("top", 2).alias("top"), F.round("height", 2).alias("height"))


@query()
def dense_note_pages(spark: SparkSession, d: str) -> DataFrame:
    base = cells.block_cells(_blocks(spark, d)).withColumn("units", F.lit("pdf"))
    return layout.dense_note_pages(layout.blocks(base, F.lit(595.0), F.lit(842.0), F.lit(595.0), F.lit(842.0)), F.lit(842.0))


# ---- finished pages

_LAST_SQL = "(SELECT * FROM (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY file_id, page_index, run_no ORDER BY loaded_at, page_result_id) = 1) QUALIFY row_number() OVER (PARTITION BY file_id, page_index ORDER BY run_no DESC, page_result_id) = 1)"


@query(
    f"""SELECT f.file_id, f.page_index, CASE WHEN p.file_id IS NULL THEN 'missing_image' WHEN trim({_PRIMARY}) <> '' AND NOT coalesce(p.needs_retry, false) AND NOT regexp_matches({_PRIMARY}, '(?i)^\\s*the\\s+quick\\s+brown\\s+fox\\s+jumps\\s+over\\s+the\\s+lazy\\s+dog\\.?\\s*$') THEN 'result' WHEN trim(coalesce(p.source_text, '')) = '' THEN 'blank' ELSE 'unusable_image' END AS kind
    FROM (SELECT file_id, unnest(range(page_count)) AS page_index FROM source_files WHERE page_count > 0) f LEFT JOIN {_LAST_SQL} p ON f.file_id = p.file_id AND f.page_index = p.page_index"""
)
def pages_completed(spark: SparkSession, d: str) -> DataFrame:
    return validate.completed(_files(spark, d), pages.last_run(_pages(spark, d)))


@query("SELECT file_id, expected, actual FROM (SELECT s.file_id, s.page_count::bigint AS expected, count(DISTINCT p.page_index) AS actual FROM source_files s LEFT JOIN page_results p ON s.file_id = p.file_id WHERE s.page_count IS NOT NULL GROUP BY 1, 2) WHERE expected <> actual")
def page_count_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return validate.page_count_mismatches(_files(spark, d), _pages(spark, d))


@query(
    r"""WITH t AS (SELECT page_result_id, coalesce(text, '') AS t FROM page_results), m AS (SELECT page_result_id, list_distinct(regexp_extract_all(t, '[\x{2e80}-\x{2fff}\x{31c0}-\x{31ef}\x{f900}-\x{faff}]')) AS r, len(list_distinct(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]'))) AS c,
    regexp_extract_all(t, '(?s).{0,45}(?:\\(?:frac|dfrac|tfrac|sqrt|text|textregistered|mathrm|mathbf|mathit|mathsf|operatorname|times|cdot|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega|leq|geq|neq|left|right)\b|[\^_]\s*\{).{0,45}') AS x,
    regexp_extract_all(t, '(?m)\*\*[^*\n]+\*\*|__[^_\n]+__|~~[^~\n]+~~|^#{1,6}\s|```|\[[^\]\n]+\]\([^)\n]+\)') AS k FROM t)
    SELECT page_result_id, 'radical_chars' AS rule, array_to_string(list_sort(r), ' ') AS detail FROM m WHERE len(r) > 0 UNION ALL SELECT page_result_id, 'control_chars', c::varchar FROM m WHERE c > 0
    UNION ALL SELECT page_result_id, 'latex_residue', x[1] FROM m WHERE len(x) > 0 UNION ALL SELECT page_result_id, 'suspected_markdown', array_to_string(k[1:5], ' ') FROM m WHERE len(k) > 0"""
)
def page_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate.failures(validate.scan(_pages(spark, d)), ["page_result_id"])


@query()
def inline_segments(spark: SparkSession, d: str) -> DataFrame:
    """The styled segments of every line, one row each."""
    one = lines.explode_lines(_pages(spark, d), ["page_result_id"], "md_nohf_text").filter("line <> ''")
    return one.select("page_result_id", "line_no", F.posexplode(segments("line")).alias("segment_no", "s")).select("page_result_id", "line_no", "segment_no", "s.*")


@query()
def script_runs_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """The runs of one script of every document, one row each."""
    return _docs(spark, d).select("doc_id", F.posexplode(script_runs(F.col("text"))).alias("run_no", "r")).select("doc_id", "run_no", "r.script", F.length("r.text").alias("n_chars"))


# ---- state


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) AS n_chars FROM documents")
def document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return state.content_fingerprints(_docs(spark, d), "doc_id", "text")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_file_id, count(*) AS n_files FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def documents_registered_again(spark: SparkSession, d: str) -> DataFrame:
    """Contents that stand under more than one id."""
    contents = _docs(spark, d).filter("text <> ''").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"))
    return state.registered_again(contents).select("sha256", "first_file_id", "n_files")


@query("SELECT file_id, regexp_replace(regexp_replace(regexp_replace(file_path, '\\\\', '/', 'g'), '/{2,}', '/', 'g'), '^(?:\\./)+', '') AS path, lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) AS suffix FROM source_files")
def file_records(spark: SparkSession, d: str) -> DataFrame:
    return state.file_records(_files(spark, d)).select("file_id", "path", "suffix")


@query("SELECT f.file_id, f.page_index FROM (SELECT file_id, unnest(range(page_count))::int AS page_index FROM source_files WHERE page_count > 0) f WHERE NOT EXISTS (SELECT 1 FROM page_results p WHERE p.file_id = f.file_id AND p.page_index = f.page_index AND p.text <> '')")
def pages_pending(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the files that have no text yet."""
    return state.pending(pages.page_domain(_files(spark, d)), _pages(spark, d).filter("text <> ''"), ["file_id", "page_index"])


@query(
    """SELECT source, count(*) AS n_files, sha256(string_agg(e, chr(10) ORDER BY e)) AS digest FROM (SELECT source, concat_ws(chr(9), regexp_replace(regexp_replace(regexp_replace(file_path, '\\\\', '/', 'g'), '/{2,}', '/', 'g'), '^(?:\\./)+', ''), coalesce(size_bytes::varchar, ''), coalesce(sha256, '')) AS e FROM source_files) GROUP BY 1"""
)
def source_manifests(spark: SparkSession, d: str) -> DataFrame:
    return state.manifest(state.file_records(_files(spark, d)).join(_files(spark, d).select("file_id", "source"), "file_id"), "source")


@query("SELECT lang, count(*) AS n_docs, median(n_chars) AS median_chars FROM documents GROUP BY 1")
def median_length(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.median("n_chars").alias("median_chars"))


# ---- progress


@query("SELECT event_id, max(floor(value)::bigint) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS progress FROM events")
def running_maximum(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, d).select("event_id", F.max(F.floor("value")).over(w).alias("progress"))


@query("SELECT user_id, from_ts, to_ts, epoch(to_ts)::bigint - epoch(from_ts)::bigint AS gap_seconds FROM (SELECT user_id, lag(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts) AS from_ts, date_trunc('second', ts) AS to_ts FROM events) WHERE epoch(to_ts)::bigint - epoch(from_ts)::bigint >= 86400")
def idle_gaps(spark: SparkSession, d: str) -> DataFrame:
    ticks = _events(spark, d).select("user_id", F.date_trunc("second", "ts").alias("ts"))
    return progress.idle_gaps(ticks, "user_id", "ts", 86_400)


# What the lines of the stages say, and from where to where their progress goes.
_STAGE_LINES = [("parse", 0, 65), ("layout", 75, 85), ("render", 85, 90), ("image render", 93, 95)]


@query(
    f"""WITH e AS (SELECT user_id, event_id, ts, event_id % 5 AS kind, event_id % 65 AS done FROM events),
    o AS (SELECT *, CASE kind {' '.join(f"WHEN {i} THEN round_even({low} + {high - low} * done / 64.0::double, 1)" for i, (_, low, high) in enumerate(_STAGE_LINES))} END AS own FROM e)
    SELECT event_id, coalesce(max(own) OVER w, 0.0)::double AS percent, last_value(CASE kind {' '.join(f"WHEN {i} THEN '{name.replace(' ', '_')}'" for i, (name, _, _) in enumerate(_STAGE_LINES))} END IGNORE NULLS) OVER w AS stage
    FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def log_progress(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as the log lines of a run, four stages and noise in turn, with the state after each line."""
    done = (F.col("event_id") % 65).cast("int")
    line = F.lit("still waiting")
    for i, (name, _, _) in enumerate(_STAGE_LINES):
        line = F.when(F.col("event_id") % 5 == i, F.format_string(f"\x1b[32m{name} %d/64\x1b[0m", done)).otherwise(line)
    log = _events(spark, d).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("bigint").alias("seq"), line.alias("line"))
    return progress.running_progress(progress.parse_lines(log)).select(F.col("seq").alias("event_id"), "percent", "stage")
