"""Repetition inside a single document: repeated shares and robust outliers.

One pass over the texts gives each value its word count, its repeated words
and a transformed statistic vector: the arc sine of the root of the repeated
share, the log odds of the words that are new, and the log of the length.

For each language and source a regularised minimum-covariance-determinant
estimate is made from all its values.  ``STARTS`` first guesses (the medians and
quartile ranges, the same around the low and the high quartiles, and the plain
moments) go through concentration steps: the vectors within the ``CORE`` quantile
of the distances give the next mean and covariance.  After ``TRIAL`` steps each
group keeps the start of least determinant, and steps go on until no group's
determinant falls any more.  Every step is a grouped aggregate with partial sums,
so a source that holds a third of all rows is no single task.  Groups of fewer
than ``LEAST`` values have no estimate of their own.

A value is rejected when its Mahalanobis distance to the estimate of its group, or
to that of all values (for a source in which most values repeat), is beyond the
chi-square limit; no other limit decides.  ``repetitive`` then checks the exact share of
the rejected values; ``recall`` measures what the rejection would lose.

Defined results of odd input: null, empty and wordless values give no row of
statistics; a value shorter than a run has no repetition; repeated rows give
repeated statistics; a null source is a group of its own.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.textlang import IS_HAN, WORDS, language
from pageflow.session import checkpointed

RUN, HAN_RUN = 6, 12
#: The share of a group that the estimate is made from: half, so that no minority of a group can shift it.
CORE = 0.5
#: First guesses, steps before the best is chosen, and the fall of the determinant (as a share) below which a group is done.
STARTS, TRIAL, SETTLED = 4, 2, 1e-2
#: Steps after which the estimate stands in any case; each lowers the determinant, so it only becomes better until then.
MAX_STEPS = 30
#: Estimates (of a dozen numbers each) that are broadcast at most; more are joined by keys with so many salts.
FEW, SALTS = 50_000, 64
#: A group of fewer values uses the estimate of all.
LEAST = 30
#: The 0.975 quantile of chi-square with three degrees of freedom, and the factor that makes the core's covariance consistent.
CHI2, CONSISTENT = 9.348, 2.45
#: Least deviations of the three statistics, which keep the covariance regular.
FLOOR = (0.02, 0.05, 0.05)
_DIMS = ("x1", "x2", "x3")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def repeated_words(words: Sequence[str], run: int) -> int:
    """How many words stand in a run that occurred before in the value, overlaps included."""
    grams = list(zip(*(words[i:] for i in range(run)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen: set[tuple[str, ...]] = set()
    marked = reach = 0
    for i, gram in enumerate(grams):
        if gram in seen:
            marked += i + run - max(reach, i)
            reach = i + run
        else:
            seen.add(gram)
    return marked


def value_statistics(text: str) -> tuple[str, int, int, float, float, float] | None:
    """(language, words, repeated words, the three transformed statistics) of a value."""
    words = WORDS.findall(text.lower())
    if not words:
        return None
    n = len(words)
    han = not text.isascii() and sum(1 for w in words if IS_HAN.match(w)) * 2 > n
    repeated = repeated_words(words, HAN_RUN if han else RUN)
    new = len(set(words))
    return "zh" if han else language(words), n, repeated, math.asin(math.sqrt(repeated / n)), math.log((new + 0.5) / (n - new + 0.5)), math.log(n)


def statistics(df: DataFrame, id_col: str, source_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, lang, source, words, repeated, x1, x2, x3) of every value with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(i, f, s, *st) for k, f in enumerate(fields) for i, s, t in zip(ids, sources, batch.column(2 + k).to_pylist(), strict=True) if t and (st := value_statistics(t))]
            if out:
                c = list(zip(*out, strict=True))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c[k], type=t) for k, t in zip((0, 1, 3, 2, 4, 5, 6, 7, 8), types, strict=True)], names=["id", "field", "lang", "source", "words", "repeated", *_DIMS])

    return df.select(F.col(id_col).cast("bigint"), F.col(source_col).cast("string"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields)]).mapInArrow(run, "id bigint, field string, lang string, source string, words int, repeated int, x1 double, x2 double, x3 double")


def _moments() -> list[Column]:
    return [F.avg(x).alias(f"m_{x}") for x in _DIMS] + [(F.avg(F.col(_DIMS[i]) * F.col(_DIMS[j]))).alias(f"p{i}{j}") for i, j in _PAIRS]


_KEY = ["lang", "source_key"]
#: The key of the estimate of all values.
ALL = "*"


def _with_inverse(model: DataFrame, key: Sequence[str]) -> DataFrame:
    """The model of each group with the determinant and the inverse of its covariance, in closed form."""
    s = {(i, j): F.col(f"s{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    cof = {(i, j): s[(i + 1) % 3, (j + 1) % 3] * s[(i + 2) % 3, (j + 2) % 3] - s[(i + 1) % 3, (j + 2) % 3] * s[(i + 2) % 3, (j + 1) % 3] for i, j in _PAIRS}
    det = s[0, 0] * cof[0, 0] + s[0, 1] * cof[0, 1] + s[0, 2] * cof[0, 2]
    return model.withColumns({f"i{i}{j}": cof[i, j] / det for i, j in _PAIRS}).select(*key, *[f"m_{x}" for x in _DIMS], det.alias("det"), *[f"i{i}{j}" for i, j in _PAIRS])


def _distance(model: str = "") -> Column:
    """The squared Mahalanobis distance to the estimate in the columns, or in the struct *model*."""
    d = [F.col(x) - F.col(f"{model}m_{x}") for x in _DIMS]
    return sum((d[i] * d[j] * F.col(f"{model}i{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _starts(stats: DataFrame) -> DataFrame:
    """(lang, source_key, start, means, covariance): the first guesses of each group."""
    by = stats.groupBy(*_KEY).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(f"q_{x}") for x in _DIMS], *[F.avg(x).alias(f"a_{x}") for x in _DIMS], *[F.coalesce(F.var_samp(x), F.lit(0.0)).alias(f"v_{x}") for x in _DIMS])
    guesses = []
    for at in (1, 0, 2, None):  # around the medians, the low and the high quartiles, and the plain means
        mean = [F.col(f"a_{x}") if at is None else F.col(f"q_{x}")[at] for x in _DIMS]
        spread = [F.col(f"v_{x}") if at is None else ((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349) ** 2 for x in _DIMS]
        guesses.append(F.struct(F.lit(len(guesses)).alias("start"), *[m.alias(f"m_{x}") for m, x in zip(mean, _DIMS, strict=True)], *[(F.greatest(spread[i], F.lit(FLOOR[i] ** 2)) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in _PAIRS]))
    return by.select(*_KEY, F.explode(F.array(*guesses[:STARTS])).alias("g")).select(*_KEY, "g.*")


def _of_group(rows: DataFrame, groups: DataFrame, key: Sequence[str], few: bool) -> DataFrame:
    """The rows with what is known of their group: *few* groups are broadcast, many are joined by salted keys, so that no group is one task."""
    if few:
        return rows.join(F.broadcast(groups), list(key))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*_DIMS), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "_salt"]).drop("_salt")


def _step(stats: DataFrame, model: DataFrame, key: Sequence[str], few: bool) -> DataFrame:
    """One concentration step: the estimate from the core of each group, regularised by the floors."""
    at = _of_group(stats, model, _KEY, few).withColumn("d2", _distance())
    near = _of_group(at, at.groupBy(*key).agg(F.percentile_approx("d2", CORE).alias("limit")), key, few).filter("d2 <= limit")
    m = near.groupBy(*key).agg(*_moments())
    cov = [((F.col(f"p{i}{j}") - F.col(f"m_{_DIMS[i]}") * F.col(f"m_{_DIMS[j]}")) * CONSISTENT + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in _PAIRS]
    return _with_inverse(m.select(*key, *[f"m_{x}" for x in _DIMS], *cov), key)


def mcd(stats: DataFrame) -> DataFrame:
    """(lang, source_key, means, det, inverse covariance): the robust estimate of each group of LEAST values or more, and of all values.

    Runs jobs: the steps go on until every group's determinant has settled.
    """
    sizes = stats.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") >= LEAST)
    every = stats.select(F.lit(ALL).alias("lang"), F.lit(ALL).alias("source_key"), *_DIMS)
    own = checkpointed(_of_group(stats, large, _KEY, large.count() <= FEW).select(*_KEY, *_DIMS).unionByName(every))
    several = [*_KEY, "start"]
    model = checkpointed(_with_inverse(_starts(own), several))
    few = model.count() <= FEW
    for _ in range(TRIAL):
        model = checkpointed(_step(own, model, several, few))
    best = F.min(F.struct("det", "start")).over(Window.partitionBy(*_KEY))
    model = checkpointed(model.withColumn("_best", best["start"]).filter("start = _best").drop("_best", "start"))
    for _ in range(MAX_STEPS // 2):
        after = checkpointed(_step(own, _step(own, model, _KEY, few), _KEY, few))
        before = model.select(*_KEY, F.col("det").alias("before"))
        model = after
        if after.join(before, _KEY).filter(F.col("before") - F.col("det") > SETTLED * F.col("before")).isEmpty():
            break
    return model


def outliers(df: DataFrame, id_col: str, source_col: str, fields: Sequence[str]) -> DataFrame:
    """Every value's statistics with ``distance`` (the larger of the Mahalanobis distances to its group and to all values) and ``rejected`` (beyond the chi-square limit)."""
    stats = checkpointed(statistics(df, id_col, source_col, fields).withColumn("source_key", F.coalesce("source", F.lit(""))))
    model = mcd(stats)
    pooled = model.filter(F.col("lang") == ALL).select(F.struct(*model.columns[2:]).alias("_all"))
    own = model.filter(F.col("lang") != ALL).select(*_KEY, F.struct(*model.columns[2:]).alias("_own"))
    few = own.count() <= FEW
    if few:
        at = stats.join(F.broadcast(own), _KEY, "left")
    else:
        salt = F.pmod(F.xxhash64(*_DIMS), F.lit(SALTS)).cast("int")
        at = stats.withColumn("_salt", salt).join(own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*_KEY, "_salt"], "left")
    at = at.join(F.broadcast(pooled))  # one row for all
    d2 = F.greatest(F.coalesce(_distance("_own."), _distance("_all.")), _distance("_all."), F.lit(0.0))
    return at.withColumn("d2", d2).select("id", "field", "lang", "source", "words", "repeated", F.sqrt("d2").alias("distance"), (F.col("d2") > CHI2).alias("rejected"))


def _shares(share: tuple[int, int]) -> Column:
    return F.col("repeated") * share[1] >= F.col("words") * share[0]


def repetitive(df: DataFrame, id_col: str, source_col: str, fields: Sequence[str], share: tuple[int, int] = (1, 3)) -> DataFrame:
    """(id, field) of the rejected values whose repeated share is at least *share*."""
    return outliers(df, id_col, source_col, fields).filter(F.col("rejected") & _shares(share)).select("id", "field")


def recall(df: DataFrame, id_col: str, source_col: str, fields: Sequence[str], share: tuple[int, int] = (1, 3)) -> DataFrame:
    """(lang, source, n_values, n_rejected, n_repetitive, n_both): what the rejection finds of the values with the share, without the exact check."""
    return outliers(df, id_col, source_col, fields).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("rejected").alias("n_rejected"), F.count_if(_shares(share)).alias("n_repetitive"), F.count_if(F.col("rejected") & _shares(share)).alias("n_both"))
