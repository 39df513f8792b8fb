"""Mixing sources to target weights, by soft membership.

Every document has a membership over the domains of the target table.  A
document with a source has it wholly; for one without, a classifier trained on
labelled rows (a naive Bayes model of hashed words, fitted on a bounded sample,
with all sources outside the table as one class more) gives the posterior.  Of a
posterior the ``LEADING`` largest parts are kept, each in steps of one
``LEVELS``-th; the rest is a membership in no domain.  So the number of distinct
memberships is bounded whatever the number of documents, and the documents of one
membership and bound are one row of the fit.

Projected-gradient least squares then fits nonnegative rates, at most
``max_repeats`` of every domain the document may belong to, whose expected tokens
of each domain meet the targets.  A row's rate is a column; every gradient step is
one aggregate of the small table and one update, its lineage cut every
``STRETCH`` steps, until the targets are met to ``TOLERANCE``.

Rates become whole numbers of uses without a draw for each document: of the
documents of a likeliest domain, in the order of a hash, so many get one use more
that their tokens make up the fraction, and small documents fill the rest.

The largest total is chosen at which every domain with documents can reach its
share.  Domains of the table without documents can't; the shares are then those
among the others, and the report shows both.  ``frontier`` tells what shares could
be had at larger totals.

Defined results of odd input: null and empty texts have no tokens and no use; a
source outside the table is never used; a target that is null, zero or negative,
or without repeats, is a domain that is not used; repeated rows are used each by
their own id; ties go by hash and id.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.tokens import with_tokens
from pageflow.session import checkpointed

#: Bound on the labelled rows that the classifier is fitted on, and its number of hashed words.
SAMPLE, HASHED = 20_000, 1 << 14
#: Documents' worth of the background in each domain's counts; one part of the sample in so many weighs the words, by the best of these weights.
SMOOTHING, CALIBRATION, WEIGHTS = 5.0, 5, (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.02, 0.0)
#: Parts of a posterior that are kept, and the steps in which they are measured.
LEADING, LEVELS = 3, 16
#: The fit ends when the targets are met to this share, after so many gradient steps at the latest; so many go between two checkpoints.
TOLERANCE, ITERATIONS, STRETCH = 1e-6, 96, 8
BUCKETS, FEW = 256, 50_000
#: Rounds in which small documents fill what is left; each leaves less than the smallest document that may be used again.
FILLS = 3
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")


def hashed_words(text: str) -> Counter[int]:
    return Counter(zlib.crc32(w.encode()) % HASHED for w in set(_WORD.findall(text.lower())))


def _scores(model: tuple[np.ndarray, np.ndarray], text: str | None) -> np.ndarray:
    """The log likelihood ratios of a text's words against the background, for each domain."""
    words = list(hashed_words(text or ""))
    return model[1][:, words].sum(axis=1) if words else np.zeros(len(model[0]))


def _posterior(prior: np.ndarray, scores: np.ndarray) -> np.ndarray:
    s = prior + scores
    p = np.exp(s - s.max())
    return p / p.sum()


def fit_classifier(labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log priors, log likelihood ratios) of the domains, from at most about SAMPLE rows of (id, source, text).

    How many documents of a domain hold a word is smoothed towards how many of
    all do, so a word says nothing about a domain that is hardly known.  One part
    in ``CALIBRATION`` of the sample is left out of the counts: on it the ratios
    are weighed, as words that come together count for less than they claim.
    """
    own = labelled.filter(F.col("source").isin(domains))
    rows = own.count()
    sample = own.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(rows / SAMPLE)))) == 0).select("source", "text", (F.pmod(F.xxhash64(F.lit("calibration"), "text"), F.lit(CALIBRATION)) == 0).alias("left_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int]] = Counter()
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[source, -1] += 1
                for w in hashed_words(text or ""):
                    counts[source, w] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["source", "w", "n"])

    n, docs = np.zeros((len(domains), HASHED)), np.zeros(len(domains))
    at = {d: i for i, d in enumerate(domains)}
    for r in sample.filter(~F.col("left_out")).select("source", "text").mapInArrow(run, "source string, w int, n bigint").groupBy("source", "w").agg(F.sum("n").alias("n")).collect():  # at most domains x HASHED rows
        if r.w < 0:
            docs[at[r.source]] += r.n
        else:
            n[at[r.source], r.w] += r.n
    background = (n.sum(axis=0) + 0.5) / (docs.sum() + 1)
    ratio = np.log((n + SMOOTHING * background) / (docs[:, None] + SMOOTHING) / background)
    prior = np.log((docs + 0.1) / (docs + 0.1).sum())
    model = (prior, ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(WEIGHTS))
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = _scores(model, text)
                total += [math.log(max(1e-9, _posterior(prior, w * scores)[at[source]])) for w in WEIGHTS]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(WEIGHTS)), pa.int32()), pa.array(total)], names=["i", "fit"])

    fits = {r.i: r.fit for r in sample.filter("left_out").select("source", "text").mapInArrow(weigh, "i int, fit double").groupBy("i").agg(F.sum("fit").alias("fit")).collect()}
    best = max(fits, key=lambda i: (round(fits[i], 6), -i)) if fits else 0
    return prior, ratio * WEIGHTS[best]


def posteriors(unlabelled: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, post) of the rows of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_posterior(model[0], _scores(model, text)).tolist() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "post"])

    return unlabelled.select("id", "text").mapInArrow(run, "id bigint, post array<double>")


def membership(post: Column, k: int) -> Column:
    """The first *k* parts of a posterior as a membership: its LEADING largest parts in whole steps, the others 0."""
    ranked = F.array_sort(F.transform(post, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    kept = F.transform(F.slice(ranked, 1, LEADING), lambda r: r["i"])
    steps = F.transform(post, lambda p, i: F.when(F.array_contains(kept, i), F.floor(p * LEVELS + 0.5) / LEVELS).otherwise(0.0))
    return F.slice(steps, 1, k)


def fit_rates(groups: DataFrame, targets: list[float]) -> DataFrame:
    """(post, cap, rate) of the rows of (post, cap, tokens): rates by projected-gradient least squares, each step one distributed aggregate."""
    k = len(targets)

    def of_domains(df: DataFrame, weight: Column) -> list[float]:
        return list(df.select(*[F.coalesce(F.sum(weight * F.col("tokens") * F.col("post")[i]), F.lit(0.0)).alias(f"m{i}") for i in range(k)]).first())

    scale = [max(m, 1.0) for m in of_domains(groups, F.lit(1.0))]
    rated = groups.withColumn("rate", F.lit(0.0))
    for step in range(1, ITERATIONS + 1):
        off = [g - t for g, t in zip(of_domains(rated, F.col("rate")), targets, strict=True)]
        if math.sqrt(sum(x * x for x in off)) <= TOLERANCE * max(1.0, sum(targets)):
            break
        slope = sum((F.col("post")[i] * F.lit(off[i] / scale[i]) for i in range(k)), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("rate") - slope)))
        if step % STRETCH == 0:
            rated = checkpointed(rated)
    return rated.select("post", "cap", "rate")


def _whole_uses(rated: DataFrame) -> DataFrame:
    """(id, domain, tokens, uses) of (id, domain, tokens, cap, rate): whole numbers whose tokens meet the rates' of each domain.

    All rows of a domain have the same rate here but for its soft members; the
    tokens owed beyond the whole part are given out by hash order, in buckets, so
    that no domain is sorted in one task.
    """
    base = F.floor(F.col("rate") + 1e-9)
    rows = rated.withColumns({"base": base.cast("int"), "owed": F.greatest(F.lit(0.0), F.col("rate") - base) * F.col("tokens"), "order": F.xxhash64("id")}).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    due = rows.groupBy("domain").agg(F.sum("owed").alias("due"))
    can = (F.col("owed") > 0) & (F.col("tokens") > 0)
    sums = rows.filter(can).groupBy("domain", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("domain").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("before", before).join(due, "domain").select("domain", "bucket", "before", (F.col("before") + F.col("t")).alias("after"), "due")
    placed = rows.join(offsets, ["domain", "bucket"], "left")
    # Only the bucket in which the tokens owed run out is looked at row by row.
    split = can & (F.col("before") < F.col("due")) & (F.col("after") > F.col("due"))
    inside = placed.filter(split).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("domain", "bucket").orderBy("order", "id")))
    inside = inside.withColumn("extra", (F.col("upto") <= F.col("due")).cast("int"))
    outside = placed.filter(~F.coalesce(split, F.lit(False))).withColumn("extra", F.coalesce((can & (F.col("after") <= F.col("due"))).cast("int"), F.lit(0)))
    columns = ["id", "domain", "tokens", "cap", "owed", "order", (F.col("base") + F.col("extra")).alias("uses"), F.col("extra").alias("given")]
    given = checkpointed(inside.select(*columns).unionByName(outside.select(*columns)))
    for _ in range(FILLS):
        given = checkpointed(_filled(given))
    return given.select("id", "domain", "tokens", F.col("uses").cast("int").alias("uses"))


def _filled(given: DataFrame) -> DataFrame:
    """One more use for the smallest documents below their bound, as far as the tokens still owed to a domain go, by the histogram of their tokens."""
    left = given.groupBy("domain").agg((F.sum("owed") - F.sum(F.col("given") * F.col("tokens"))).alias("left"))
    free = given.filter((F.col("uses") < F.col("cap")) & (F.col("tokens") > 0)).join(left, "domain").filter(F.col("tokens") <= F.col("left"))
    sizes = free.groupBy("domain", "tokens").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    below = F.coalesce(F.sum(F.col("n") * F.col("tokens")).over(Window.partitionBy("domain").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = sizes.withColumn("below", below).filter("below < left").select("domain", "tokens", F.least("n", F.floor((F.col("left") - F.col("below")) / F.col("tokens"))).alias("quota")).filter("quota > 0")
    due = given.filter(F.col("uses") < F.col("cap")).join(quota, ["domain", "tokens"]).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    counts = due.groupBy("domain", "tokens", "bucket").agg(F.count(F.lit(1)).alias("here"))
    ahead = F.coalesce(F.sum("here").over(Window.partitionBy("domain", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = due.join(counts.withColumn("ahead", ahead), ["domain", "tokens", "bucket"])
    # Buckets wholly within the quota need no order; only the one in which it ends is ranked.
    whole = at.filter(F.col("ahead") + F.col("here") <= F.col("quota"))
    last = at.filter((F.col("ahead") < F.col("quota")) & (F.col("ahead") + F.col("here") > F.col("quota")))
    rank = F.row_number().over(Window.partitionBy("domain", "tokens", "bucket").orderBy("order", "id"))
    last = last.withColumn("r", rank).filter(F.col("ahead") + F.col("r") <= F.col("quota"))
    ranked = whole.select("id", "domain").unionByName(last.select("id", "domain")).withColumn("more", F.lit(1))
    more = F.coalesce("more", F.lit(0))
    return given.join(ranked, ["id", "domain"], "left").select("id", "domain", "tokens", "cap", "owed", "order", (F.col("uses") + more).alias("uses"), (F.col("given") + more).alias("given"))


def _wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """(share, repeats) of the sources that can be used: a fixed table of a dozen rows."""
    rows = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
    return {r.source: (r.share, r.cap) for r in rows if r.source and r.share and r.share > 0 and r.cap and r.cap > 0}


def classified(texts: DataFrame, domains: list[str]) -> DataFrame:
    """(id, post) of the rows of (id, source, text) without a source; the last part of a posterior is for all other sources."""
    known = texts.filter(F.col("source").isNotNull()).withColumn("source", F.when(F.col("source").isin(domains), F.col("source")).otherwise(""))
    return posteriors(texts.filter("source is null"), fit_classifier(known, [*domains, ""]))


def held_out(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 5) -> DataFrame:
    """(source, n_docs, n_right, mean_posterior): the classifier on one *part*-th of the labelled rows, fitted without them."""
    names = sorted(_wanted(targets))
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), "source", F.col(text_col).cast("string").alias("text")).filter(F.col("source").isNotNull() & (F.col("text") != ""))
    out = F.pmod(F.xxhash64("text"), F.lit(part)) == 0  # copies of a text fall on one side
    fitted = texts.filter(~out).unionByName(texts.filter(out).withColumn("source", F.lit(None).cast("string")))
    post = classified(fitted, names).join(texts.filter(out).select("id", "source"), "id")
    classes = F.array(*map(F.lit, [*names, ""]))
    own = F.array_position(classes, F.when(F.col("source").isin(names), F.col("source")).otherwise("")).cast("int")
    right = F.array_position("post", F.array_max("post")).cast("int") == own
    return post.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(right).alias("n_right"), F.round(F.avg(F.element_at("post", own)), 6).alias("mean_posterior"))


def mixed(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, domain, tokens, uses, membership) of every document.

    ``domain`` is the likeliest one, if any; ``membership`` maps the domains to
    the document's parts in them.  Runs jobs while the frame is built: sums of the
    domains, the classifier's counts and the steps of the fit.
    """
    wanted = _wanted(targets)
    counted = checkpointed(with_tokens(documents, id_col, text_col, "source"))
    mass = {r.source: r.t for r in counted.filter(F.col("source").isin(sorted(wanted))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()} if wanted else {}
    usable = [d for d in sorted(wanted) if mass.get(d, 0) > 0]
    if not usable:
        return counted.select("id", "source", F.lit(None).cast("string").alias("domain"), "tokens", F.lit(0).alias("uses"), F.lit(None).cast("map<string,double>").alias("membership"))
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), "source", F.col(text_col).cast("string").alias("text"))
    names = F.array(*map(F.lit, usable))
    whole = F.transform(names, lambda d: F.when(F.col("source") == d, 1.0).otherwise(0.0))
    known = counted.filter(F.col("source").isNotNull()).withColumn("post", whole)
    soft = classified(texts, usable).select("id", membership(F.col("post"), len(usable)).alias("post"))
    unknown = counted.filter(F.col("source").isNull()).join(soft, "id")
    caps = F.zip_with("post", F.array(*[F.lit(float(wanted[d][1])) for d in usable]), lambda p, c: F.when(p > 0, c))
    best = F.array_max("post")
    members = known.unionByName(unknown.select(known.columns)).withColumns({"cap": F.coalesce(F.array_min(caps), F.lit(0.0)), "domain": F.when(best > 0, F.element_at(names, F.array_position("post", best).cast("int")))})
    members = checkpointed(members)
    shares_sum = sum(wanted[d][0] for d in usable)
    total = min(mass[d] * wanted[d][1] / (wanted[d][0] / shares_sum) for d in usable)
    groups = checkpointed(members.filter("cap > 0").groupBy("post", "cap").agg(F.sum("tokens").cast("double").alias("tokens")))
    rates = fit_rates(groups, [total * wanted[d][0] / shares_sum for d in usable])
    rates = checkpointed(rates)
    # Memberships are bounded by LEADING and LEVELS; so many are broadcast, more are joined by salted keys, so that no source is one task.
    if rates.count() <= FEW:
        rated = members.filter("cap > 0").join(F.broadcast(rates), ["post", "cap"])
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
        rated = members.filter("cap > 0").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).join(salted, ["post", "cap", "_salt"])
    rated = rated.select("id", "domain", "tokens", "cap", "rate")
    uses = _whole_uses(rated)
    all_rows = members.select("id", "source", "domain", "tokens", F.map_from_arrays(names, "post").alias("membership"))
    return all_rows.join(uses.select("id", "uses"), "id", "left").select("id", "source", "domain", "tokens", F.when(F.col("tokens") > 0, F.coalesce("uses", F.lit(0))).otherwise(0).alias("uses"), "membership")


def shares(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_used, most_uses, tokens_used, expected_tokens, actual_share, expected_share, reachable_share) of the table's sources.

    ``tokens_used`` are those of the documents of the source, ``expected_tokens``
    those of all documents by their memberships; the shares are of their sums.
    """
    used = F.col("uses") * F.col("tokens")
    own = rows.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("uses") > 0).alias("n_used"), F.sum(used).alias("tokens_used"), F.max("uses").alias("most_uses"))
    soft = rows.filter("uses > 0").select(F.explode("membership").alias("source", "part"), used.alias("t")).groupBy("source").agg(F.sum(F.col("t") * F.col("part")).alias("expected_tokens"))
    zero = F.lit(0)
    both = targets.select("source", "target_share", "max_repeats").join(own, "source", "left").join(soft, "source", "left")
    both = both.fillna({"n_docs": 0, "n_used": 0, "most_uses": 0, "tokens_used": 0, "expected_tokens": 0.0})
    every = Window.partitionBy()  # the table's dozen rows
    there = F.sum(F.when(F.col("expected_tokens") > 0, F.col("target_share"))).over(every)

    def share(c: str) -> Column:
        return F.round(F.coalesce(F.col(c) / F.nullif(F.sum(c).over(every), zero), zero), 8)

    reachable = F.round(F.when(F.col("expected_tokens") > 0, F.col("target_share") / there).otherwise(0.0), 8)
    return both.select("source", "target_share", "max_repeats", "n_docs", "n_used", "most_uses", "tokens_used", F.round("expected_tokens", 3).alias("expected_tokens"), share("tokens_used").alias("actual_share"), share("expected_tokens").alias("expected_share"), reachable.alias("reachable_share"))


def frontier(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", factors: tuple[int, ...] = (1, 2, 5, 10, 20, 50)) -> DataFrame:
    """(factor, source, wanted_tokens, reachable_tokens, reachable_share): what each source can give at so many times the largest total at which all shares are met."""
    good = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    tokens = with_tokens(documents, id_col, text_col, "source").groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    every = Window.partitionBy()
    have = good.join(tokens, "source").withColumn("share", F.col("share") / F.sum("share").over(every)).withColumn("most", F.col("tokens") * F.col("cap"))
    at = have.withColumn("total", F.min(F.col("most") / F.col("share")).over(every)).select("*", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    wanted = F.col("factor") * F.col("total") * F.col("share")
    got = F.least(wanted, F.col("most"))
    return at.select("factor", "source", F.round(wanted, 1).alias("wanted_tokens"), F.round(got, 1).alias("reachable_tokens"), F.round(got / F.sum(got).over(Window.partitionBy("factor")), 8).alias("reachable_share"))
