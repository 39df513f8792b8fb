"""Long exact spans shared between records: seed and extend.

1. *Seed.*  Every field of at least ``min_len`` characters gives winnowed
   anchors: of all hashes of ``k`` characters the smallest of each window of
   ``min_len - k + 1``.  A common span of ``min_len`` characters holds a whole
   window, so both records choose the same anchor in it: no span is missed.
2. *Join.*  Records that are copies of each other in all their fields are one
   class.  Anchors are reduced to one row per (hash, class) before they are
   shuffled, then joined with themselves on the hash.
3. *Extend.*  Each pair of classes is extended both ways on every diagonal on
   which one of its anchors has places; the maximal repeats of ``min_len`` or more
   stay.

Defined results of odd input: null and short fields have no anchors; a span
that a record shares only with itself (its other field included) is no result;
records that are wholly equal share all of their long fields; ids must not be
null (such rows are left out).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.session import checkpointed

MIN_LEN = 200
_FIELD_BITS = 40
_MASK = (1 << _FIELD_BITS) - 1
#: A class of more copies is expanded in parts of about so many.
COPIES = 1000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of every run of *k* characters, built by doubling."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    cur = codes * _M2 + np.uint64(0x1234567)
    cur ^= cur >> np.uint64(32)
    full, done, size, mult = None, 0, 1, int(_M1)
    while True:
        if k & size:  # the runs of this size that start after what is hashed already
            part = cur[done : done + n]
            full = part.copy() if full is None else full * np.uint64(31 * size + 6) + part
            done += size
        if size * 2 > k:
            break
        cur = cur[:-size] * np.uint64(mult) + cur[size:]
        mult = mult * mult % 2**64 | 1
        size *= 2
    full = full * _M3
    return full ^ (full >> np.uint64(31))


def anchors(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the winnowed anchors of a text, each hash once, at its first place."""
    hashes = gram_hashes(text, k)
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    window = min(window, len(hashes))
    least, size = hashes, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if rest := window - size:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    chosen = np.unique(least)
    order = np.argsort(hashes, kind="stable")
    return chosen, order[np.searchsorted(hashes, chosen, sorter=order)]


def _places(s: str, gram: str) -> list[int]:
    out, i = [], s.find(gram)
    while i >= 0:
        out.append(i)
        i = s.find(gram, i + 1)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _runs(s: np.ndarray, t: np.ndarray, d: int, min_len: int) -> Iterator[tuple[int, int]]:
    """(start in s, length) of the runs of *min_len* or more with s[i] == t[i - d]."""
    low, high = max(0, d), min(len(s), len(t) + d)
    same = s[low:high] == t[low - d : high - d]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    for k in np.flatnonzero(stops - starts >= min_len):
        yield int(starts[k]) + low, int(stops[k] - starts[k])


def common_spans(a: Sequence[str | None], b: Sequence[str | None], seeds: Sequence[int], k: int, min_len: int) -> list[tuple[int, int, int, int, int]]:
    """(field of a, start, field of b, start, length) of the maximal repeats of *min_len* or more around the seeds, places in *a*.

    All places of the seeds' grams in both texts only mark diagonals; each
    marked diagonal is extended both ways in one comparison.  So the cost of
    texts with very many equal grams follows their diagonals, of which there are
    as many as characters, and not the pairs of places.
    """
    grams = {a[p >> _FIELD_BITS][p & _MASK : (p & _MASK) + k] for p in seeds}
    out = []
    for f, s in enumerate(a):
        for g, t in enumerate(b):
            if not s or not t:
                continue
            marked = np.zeros(len(s) + len(t), bool)
            for gram in grams:
                in_t = np.array(_places(t, gram), np.int64) if gram in t else ()
                if len(in_t):
                    for i in _places(s, gram):
                        marked[i - in_t + len(t)] = True
            if marked.any():
                x, y = _codes(s), _codes(t)
                for at in np.flatnonzero(marked):
                    d = int(at) - len(t)
                    out += [(f, i, g, i - d, n) for i, n in _runs(x, y, d, min_len)]
    return sorted(out)


class SharedSpans:
    """Shared spans of a table's text fields; every step is a DataFrame built once.  Making one runs a job: the checkpoint of the class members."""

    def __init__(self, df: DataFrame, id_col: str, fields: Sequence[str], min_len: int = MIN_LEN):
        self.min_len, self.k, self.n = min_len, min_len // 2, len(fields)
        self.window = min_len - self.k + 1
        text = [F.when(F.length(F.col(c)) >= min_len, F.col(c)).alias(f"f{i}") for i, c in enumerate(fields)]
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), *text).filter(F.col("id").isNotNull() & F.coalesce(*[F.col(f"f{i}") for i in range(self.n)]).isNotNull())
        parts = [x for i in range(self.n) for x in (F.coalesce(F.length(f"f{i}"), F.lit(-1)), F.coalesce(f"f{i}", F.lit("")))]
        self.rows = rows.withColumns({"c1": F.xxhash64(*parts), "c2": F.hash(*parts)})
        # Narrow rows that every later step reads instead of hashing the texts again; their lineage is cut.
        self.members = checkpointed(self.rows.select("id", "c1", "c2"))

    def classes(self) -> DataFrame:
        """(c1, c2, rep, n): each class of wholly equal records with its first id and its size."""
        return self.members.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def anchor_rows(self) -> DataFrame:
        """(h, c1, c2, place): the anchors, once for each hash and class."""
        k, window, n = self.k, self.window, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [batch.column(2 + i).to_pylist() for i in range(n)]
                hs, where, counts = [], [], np.zeros(batch.num_rows, np.int64)
                for r in range(batch.num_rows):
                    own: tuple[np.ndarray, np.ndarray] | None = None
                    for i in range(n):
                        t = texts[i][r]
                        if t is None or (i and t == texts[0][r]):
                            continue
                        h, p = anchors(t, k, window)
                        p = p | (i << _FIELD_BITS)
                        if own is not None:
                            new = ~np.isin(h, own[0])
                            h, p = np.concatenate((own[0], h[new])), np.concatenate((own[1], p[new]))
                        own = (h, p)
                    if own is not None:
                        hs.append(own[0])
                        where.append(own[1])
                        counts[r] = len(own[0])
                if hs:
                    c1, c2 = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(c1), pa.array(c2), pa.array(np.concatenate(where))], names=["h", "c1", "c2", "place"])

        raw = self.rows.select("c1", "c2", *[f"f{i}" for i in range(n)]).mapInArrow(run, "h bigint, c1 bigint, c2 int, place bigint")
        return raw.groupBy("h", "c1", "c2").agg(F.min("place").alias("place"))

    def candidates(self) -> DataFrame:
        """(a, b, seeds): pairs of classes with an anchor in common, with its places in both.

        Both sides of the join read the same columns, so that Spark shuffles the
        anchors once and uses the exchange again.
        """
        own = self.anchor_rows()
        a, b = (own.select("h", F.struct("c1", "c2").alias(c), F.col("place").alias(f"place_{c}")) for c in "ab")
        return a.join(b, "h").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.collect_list(F.struct("place_a", "place_b")).alias("seeds"))

    def class_spans(self) -> DataFrame:
        """(a, b, field_a, start_a, field_b, start_b, span_length): maximal repeats between different classes.

        ``a`` and ``b`` are the first ids of the classes.  Texts are shuffled
        only for classes that have a candidate.
        """
        reps = self.classes().select(F.struct("c1", "c2").alias("c"), "rep")
        pairs = self.candidates()
        pairs = pairs.join(reps.select(F.col("c").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("c").alias("b"), F.col("rep").alias("rb")), "b")
        ends = pairs.select(F.explode(F.array(F.struct(F.col("ra").alias("id"), F.lit(0).alias("side"), "seeds"), F.struct(F.col("rb").alias("id"), F.lit(1).alias("side"), F.lit(None).cast("array<struct<place_a:bigint,place_b:bigint>>").alias("seeds")))).alias("e"), "ra", "rb").select("e.*", "ra", "rb")
        text = F.struct(*[F.col(f"f{i}") for i in range(self.n)])
        both = self.rows.select("id", text.alias("t")).join(ends, "id").groupBy("ra", "rb").agg(*[F.max(F.when(F.col("side") == s, F.col("t"))).alias(c) for s, c in ((0, "ta"), (1, "tb"))], F.max(F.when(F.col("side") == 0, F.col("seeds"))).alias("seeds"))
        k, min_len, n = self.k, self.min_len, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for ra, rb, ta, tb, seeds in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    a, b = ([t[f"f{i}"] for i in range(n)] for t in (ta, tb))
                    out += [(ra, rb, *s) for s in common_spans(a, b, [x["place_a"] for x in seeds], k, min_len)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "field_a", "start_a", "field_b", "start_b", "span_length"])

        return both.select("ra", "rb", "ta", "tb", "seeds").mapInArrow(run, "a bigint, b bigint, field_a int, start_a int, field_b int, start_b int, span_length int")

    def _members_of(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """*df* with one row for each member of the class *key*, as *out*.

        A class of many copies is cut into salted parts, so that what is made
        of it is spread over tasks.
        """
        parts = F.ceil(F.col("n") / COPIES).cast("int")
        classes = self.classes().withColumn("parts", parts)
        members = self.members.join(classes, ["c1", "c2"]).select(F.col("rep").alias("_rep"), F.col("id").alias(out), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("_part"))
        sizes = classes.select(F.col("rep").alias("_rep"), "parts")
        left = df.withColumn("_rep", F.col(key)).join(sizes, "_rep").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return left.join(members, ["_rep", "_part"]).drop("_rep", "_part")

    def pairs(self) -> DataFrame:
        """(id_a, id_b): all pairs of records that share a span, copies included."""
        across = self._members_of(self._members_of(self.class_spans().select("a", "b").distinct(), "a", "x"), "b", "y").select("x", "y")
        copied = self.classes().filter("n > 1").select(F.col("rep").alias("a"))
        within = self._members_of(self._members_of(copied, "a", "x"), "a", "y").filter("x < y").select("x", "y")
        return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def shared_by_record(self) -> DataFrame:
        """(id, field, n_chars, n_shared): how many characters of each long field stand in other records too."""
        spans = self.class_spans()
        sides = spans.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("field_a").alias("field"), F.col("start_a").alias("start"), "span_length"), F.struct(F.col("b").alias("rep"), F.col("field_b").alias("field"), F.col("start_b").alias("start"), "span_length"))).alias("s")).select("s.*").distinct()
        w = Window.partitionBy("rep", "field").orderBy("start", F.col("stop").desc())
        reach = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        merged = sides.withColumn("stop", F.col("start") + F.col("span_length")).withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest(reach, F.col("start")))).groupBy("rep", "field").agg(F.sum("new").cast("int").alias("merged"))
        long = self.rows.select("id", "c1", "c2", F.posexplode(F.array(*[F.length(f"f{i}") for i in range(self.n)])).alias("field", "n_chars")).filter("n_chars is not null")
        own = long.join(self.classes(), ["c1", "c2"]).join(merged, ["rep", "field"], "left")
        return own.select("id", "field", "n_chars", F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("merged", F.lit(0))).alias("n_shared"))
