"""Deeply nested JSON records to related flat tables, in one pass.

A depth-first visitor walks each body once and emits one tagged row per node:
the table it belongs to, its primary key, its parent's key and its own scalar
and leaf members as a JSON payload.  The tagged rows are written once,
partitioned by tag, and each table gets its typed schema when it is read back.

Defined results of odd input: a null, empty or invalid body emits nothing; a
null member emits nothing but keeps its number; an object in place of an array
is member 0; a root given as JSON text is parsed; the root may lie below
wrapper objects; scalars in a container are skipped and keep their number;
repeated bodies under other ids are emitted again; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGGED_SCHEMA = "tag string, record_id bigint, node_path string, parent_path string, ordinal int, depth int, payload string"
_ARROW = pa.schema([("tag", pa.string()), ("record_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("payload", pa.string())])
_CHUNK = 20_000


@dataclass(frozen=True)
class NestedSpec:
    """What to unnest: the root key, and the containers below each kind of node."""

    root: str = "pdf_info"
    root_tag: str = "pages"
    #: containers directly below a root member, and the tag of their members
    top: dict[str, str] = field(default_factory=lambda: {"para_blocks": "blocks", "preproc_blocks": "blocks", "discarded_blocks": "blocks"})
    #: containers below any other node, and the tag of their members
    inner: dict[str, str] = field(default_factory=lambda: {"blocks": "blocks", "lines": "lines", "spans": "spans"})


def _reject_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_strict(text: str | None) -> object:
    """The value of a JSON text, or None where it isn't valid JSON."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_reject_constant)
    except (ValueError, RecursionError):
        return None


def find_root(body: object, root: str) -> object:
    """The member *root* of the outermost object that has one, breadth first; JSON text is parsed."""
    level = [body]
    while level:
        below: list[object] = []
        for x in level:
            if isinstance(x, dict):
                if root in x:
                    found = x[root]
                    for _ in range(3):
                        if not isinstance(found, str):
                            break
                        found = parse_strict(found)
                    return found
                below.extend(v for v in x.values() if isinstance(v, dict | list))
            elif isinstance(x, list):
                below.extend(v for v in x if isinstance(v, dict | list))
        level = below
    return None


def _members(value: object) -> list[tuple[int, dict]]:
    if isinstance(value, dict):
        return [(0, value)]
    if isinstance(value, list):
        return [(i, x) for i, x in enumerate(value) if isinstance(x, dict)]
    return []


def visit(body: object, spec: NestedSpec) -> Iterator[tuple[str, str, str | None, int, int, dict]]:
    """(tag, path, parent path, ordinal, depth, node without its containers), depth first, without recursion."""
    stack: list[tuple[str, str, str | None, int, int, dict]] = [(spec.root_tag, f"{spec.root}[{i}]", None, i, 0, x) for i, x in reversed(_members(find_root(body, spec.root)))]
    while stack:
        tag, path, parent, ordinal, depth, node = stack.pop()
        containers = spec.top if depth == 0 else spec.inner
        yield tag, path, parent, ordinal, depth, {k: v for k, v in node.items() if k not in containers}
        below = [(kind, f"{path}.{name}[{i}]", path, i, depth + 1, x) for name, kind in containers.items() if name in node for i, x in _members(node[name])]
        stack.extend(reversed(below))


def emit_tagged(df: DataFrame, id_col: str = "record_id", body_col: str = "body", spec: NestedSpec | None = None) -> DataFrame:
    """One tagged row per node of every body; a single narrow pass without a shuffle."""
    spec = spec or NestedSpec()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tag, path, parent, ordinal, depth, rest in visit(parse_strict(text), spec):
                    out.append((tag, rid, path, parent, ordinal, depth, json.dumps(rest, ensure_ascii=False)))
                if len(out) >= _CHUNK:
                    yield _to_batch(out)
                    out = []
            if out:
                yield _to_batch(out)

    return df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(body_col).cast("string").alias("body")).mapInArrow(run, TAGGED_SCHEMA)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


#: The typed members of each table; the key columns come before them.
TABLE_SCHEMAS: dict[str, T.StructType] = {
    "pages": T.StructType([T.StructField("page_idx", T.IntegerType()), T.StructField("page_size", T.ArrayType(T.DoubleType()))]),
    "blocks": T.StructType([T.StructField("type", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]),
    "lines": T.StructType([T.StructField("bbox", T.ArrayType(T.DoubleType()))]),
    "spans": T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("text", T.StringType()), T.StructField("latex", T.StringType()), T.StructField("html", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]
    ),
}


def typed_table(tagged: DataFrame, tag: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of one tag with the payload as typed columns, linked to their parents.

    A container that a node holds is named by the path, so a block's origin
    (``para_blocks`` and so on) is given as the column ``container``.
    """
    payload = F.from_json("payload", schema or TABLE_SCHEMAS[tag])
    out = tagged.filter(F.col("tag") == tag).withColumn("_p", payload)
    columns = [F.col("_p").getField(f.name).alias(f"node_{f.name}") for f in (schema or TABLE_SCHEMAS[tag])]
    container = F.regexp_extract("node_path", r"([A-Za-z_]+)\[\d+\]$", 1).alias("container")
    spare = [F.coalesce(F.col("_p.content"), F.col("_p.text"), F.col("_p.latex"), F.col("_p.html")).alias("node_value")] if tag == "spans" and schema is None else []
    return out.select("record_id", "node_path", "parent_path", container, "ordinal", "depth", *columns, *spare)


def write_tagged(tagged: DataFrame, folder: str) -> None:
    """The tagged rows in one write, partitioned by tag, for tables that are read often."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(folder)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The typed tables of a folder written by :func:`write_tagged`; each reads only its own partition."""
    tagged = spark.read.schema(TAGGED_SCHEMA).parquet(folder)
    return {tag: typed_table(tagged, tag) for tag in TABLE_SCHEMAS}


def nodes_below_pages(df: DataFrame) -> DataFrame:
    """Every block, line and span with its parent, as (record_id, node_path, parent_path)."""
    return emit_tagged(df).filter(F.col("tag") != "pages").select("record_id", "node_path", "parent_path")
