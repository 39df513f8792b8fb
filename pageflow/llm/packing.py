"""Filling containers of fixed capacity with documents: harmonic packing.

Lengths fall into reciprocal classes: class *k* holds those in
``(capacity / (k + 1), capacity / k]``, and each of its bins takes *k* of them.
What the histogram of the lengths leaves open is settled before any document is
moved: it has at most ``capacity`` rows, whatever the number of documents, and
from it a list of bin patterns is made.  A pattern starts with the fixed count
of its class and gives its gap to the largest smaller lengths left.  Workers
then place the documents independently: the place of a document among those of
its length, known from counts of hash buckets, decides its bin.

A document larger than the capacity is split: its full parts are bins of their
own, the rest is packed like a document.

Defined results of odd input: null and empty texts have no tokens and no
container (their bin is null); ties in length go by hash and id; repeated rows
are packed each; a null id is packed as any other, after the others.  Extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.tokens import with_tokens
from pageflow.session import checkpointed

#: Documents of one length are counted in so many hash buckets, so that a frequent length is no single task.
BUCKETS = 128


@dataclass(frozen=True)
class Slot:
    """Documents of one length, by rank from *first* on, *uses* to a bin, bins from *base* on."""

    length: int
    first: int
    uses: int
    base: int


def patterns(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """The slots of all lengths, and the number of bins."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    taken = dict.fromkeys(lengths, 0)
    slots: list[Slot] = []
    bins = 0
    while lengths:
        largest = lengths[-1]
        per_class = capacity // largest
        floor = capacity // (per_class + 1)
        use: dict[int, int] = {}
        gap, count = capacity, 0
        while count < per_class:  # the fixed count of the class, largest first
            fit = bisect_right(lengths, gap) - 1
            while fit >= 0 and use.get(lengths[fit], 0) >= left[lengths[fit]]:
                fit -= 1
            if fit < 0 or lengths[fit] <= floor:
                break
            n = lengths[fit]
            k = min(per_class - count, left[n] - use.get(n, 0), gap // n)
            use[n] = use.get(n, 0) + k
            gap -= k * n
            count += k
        while gap:  # the gap, by smaller lengths
            fit = bisect_right(lengths, gap) - 1
            while fit >= 0 and use.get(lengths[fit], 0) >= left[lengths[fit]]:
                fit -= 1
            if fit < 0:
                break
            n = lengths[fit]
            k = min(left[n] - use.get(n, 0), gap // n)
            use[n] = use.get(n, 0) + k
            gap -= k * n
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            slots.append(Slot(n, taken[n], k, bins))
            taken[n] += times * k
            left[n] -= times * k
            if not left[n]:
                lengths.remove(n)
        bins += times
    return slots, bins


def _ranked(items: DataFrame) -> DataFrame:
    """The items with their rank among those of their length, without sorting a length in one task."""
    salted = items.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(BUCKETS)))
    own = Window.partitionBy("length", "bucket").orderBy(F.col("id").asc_nulls_last(), "part")
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return salted.withColumn("_r", F.row_number().over(own) - 1).join(counts.select("length", "bucket", offset.alias("_o")), ["length", "bucket"]).withColumn("rank", F.col("_r") + F.col("_o")).drop("_r", "_o", "bucket")


def pack(lengths: DataFrame, capacity: int) -> DataFrame:
    """(id, part, token_from, length, bin) of every part of the documents of (id, tokens)."""
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = (F.col("tokens") % capacity).cast("int")
    full = lengths.filter(F.col("tokens") > capacity).select("id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part"))
    full = full.select("id", "part", (F.col("part") * F.lit(capacity)).cast("bigint").alias("token_from"), F.lit(capacity).alias("length"), F.concat_ws("-", F.lit("full"), F.col("id"), F.col("part")).alias("bin"))
    split = F.when(F.col("tokens") > capacity, whole).otherwise(0)
    items = lengths.select("id", split.alias("part"), (split * F.lit(capacity)).cast("bigint").alias("token_from"), F.when(F.col("tokens") > capacity, rest).otherwise(F.col("tokens").cast("int")).alias("length"), "tokens")
    none = items.filter("tokens = 0").select("id", "part", "token_from", "length", F.lit(None).cast("string").alias("bin"))
    items = items.filter("length > 0").drop("tokens")
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots, _ = patterns(histogram, capacity)
    grouped: dict[int, list[tuple[int, int, int]]] = {}
    for s in slots:
        grouped.setdefault(s.length, []).append((s.first, s.uses, s.base))
    by = {n: tuple(np.array(c) for c in zip(*sorted(rows), strict=True)) for n, rows in grouped.items()}
    sent = lengths.sparkSession.sparkContext.broadcast(by)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = []
            for n, rank in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                first, uses, base = sent.value[n]
                i = int(np.searchsorted(first, rank, side="right")) - 1
                bins.append(f"bin-{int(base[i] + (rank - first[i]) // uses[i])}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins, pa.string())], names=["id", "part", "token_from", "length", "bin"])

    placed = _ranked(items).select("id", "part", "token_from", "length", "rank").mapInArrow(place, "id bigint, part int, token_from bigint, length int, bin string")
    return placed.unionByName(full).unionByName(none)


def packed(documents: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(container, id, part, token_from, length, bin) for each size of the list of containers, a handful of rows."""
    lengths = checkpointed(with_tokens(documents, id_col, text_col))
    sizes = containers.filter("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("capacity_tokens", "container").collect()
    out: DataFrame | None = None
    for r in sizes:
        one = pack(lengths, int(r.capacity_tokens)).select(F.lit(r.container).alias("container"), F.lit(int(r.capacity_tokens)).alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return documents.sparkSession.createDataFrame([], "container string, capacity int, id bigint, part int, token_from bigint, length int, bin string")
    return out


def bins(rows: DataFrame) -> DataFrame:
    """(container, bin, n_parts, tokens, fill_share) of each container that is used."""
    return rows.filter("bin is not null").groupBy("container", "capacity", "bin").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("length").alias("tokens")).select("container", "bin", "n_parts", "tokens", F.round(F.col("tokens") / F.col("capacity"), 6).alias("fill_share"))


def summary(rows: DataFrame) -> DataFrame:
    """(container, n_bins, n_parts, tokens, mean_fill) of each size."""
    return bins(rows).groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n_parts").alias("n_parts"), F.sum("tokens").alias("tokens"), F.round(F.avg("fill_share"), 6).alias("mean_fill"))
